"""Polygons (lists of corners), segments and grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.functions.grid import GridSpec
from geopulse.functions.tables import written

Polygon = list[tuple[float, float]]


def edges_of(polygon: Polygon) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(polygon, polygon[1:] + polygon[:1], strict=True) if a != b]


def in_polygon(x: Column, y: Column, polygon: Polygon) -> Column:
    """Half-open ray casting: an odd number of edges is crossed to the right."""
    crossings = F.lit(0)
    for x1, y1, x2, y2 in edges_of(polygon):
        if y1 != y2:
            crossed = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + crossed.cast("int")
    return crossings % 2 == 1


def points_in_polygon(points: DataFrame, polygon: Polygon) -> DataFrame:
    xs, ys = zip(*polygon, strict=True)
    box = F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))
    return points.where(box & in_polygon(F.col("x"), F.col("y"), polygon))


def clip(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Parameters (t1, t2) of the part of a segment inside a box; t1 >= t2 where there is none."""
    low, high = F.lit(0.0), F.lit(1.0)
    for a, b, lo, hi in ((x1, x2, box[0], box[2]), (y1, y2, box[1], box[3])):
        d = b - a
        t1, t2 = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        outside = (d == 0) & ((a < lo) | (a >= hi))
        low = F.when(outside, 2.0).otherwise(F.greatest(low, F.coalesce(F.least(t1, t2), F.lit(0.0))))
        high = F.least(high, F.coalesce(F.greatest(t1, t2), F.lit(1.0)))
    return low, high


def segment_cells(segments: DataFrame, grid: GridSpec) -> DataFrame:
    """(segment_id, gx, gy, t1, t2): the parts of segments (x1, y1, x2, y2) in the lattice's cells."""
    span = lambda a, b, size, off: F.explode(F.sequence(F.floor((F.least(a, b) - off) / size), F.floor((F.greatest(a, b) - off) / size)))
    s = segments.select("*", span("x1", "x2", grid.xsize, grid.xoffset).alias("gx")).select("*", span("y1", "y2", grid.ysize, grid.yoffset).alias("gy"))
    x, y = grid.xoffset + F.col("gx") * grid.xsize, grid.yoffset + F.col("gy") * grid.ysize
    t1, t2 = clip(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), (x, y, x + grid.xsize, y + grid.ysize))
    return s.select("segment_id", "gx", "gy", t1.alias("t1"), t2.alias("t2")).where("t1 < t2")


def segment_main_cell(segments: DataFrame, grid: GridSpec) -> DataFrame:
    """(segment_id, gx, gy): the cell with the longest part; of ties the one that comes first."""
    w = W.partitionBy("segment_id").orderBy(F.desc(F.round(F.col("t2") - F.col("t1"), 9)), "t1", "gx", "gy")
    return segment_cells(segments, grid).select("*", F.row_number().over(w).alias("k")).where("k = 1").select("segment_id", "gx", "gy")


def project(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """(event_id, segment_id, t, distance): the nearest segment within the radius, the first id of ties.

    Segments are put into every bucket that they come near to; a point looks in its own bucket only.
    """
    lo = lambda a, b: F.floor((F.least(a, b) - radius) / radius)
    hi = lambda a, b: F.floor((F.greatest(a, b) + radius) / radius)
    s = segments.select("*", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2"))).alias("bx")).select("*", F.explode(F.sequence(lo("y1", "y2"), hi("y1", "y2"))).alias("by"))
    p = points.select("event_id", "x", "y", F.floor(F.col("x") / radius).alias("bx"), F.floor(F.col("y") / radius).alias("by"))
    both = p.join(s, ["bx", "by"])
    t = F.expr("greatest(0D, least(1D, coalesce(try_divide((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1), (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0D)))")
    both = both.withColumn("t", t).withColumn("d2", F.expr("pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)"))
    best = F.min(F.struct(F.round("d2", 9).alias("r"), "segment_id", "t", "d2")).alias("m")
    near = both.where(F.col("d2") <= radius * radius).groupBy("event_id").agg(best)
    return near.select("event_id", "m.segment_id", "m.t", F.sqrt("m.d2").alias("distance"))


def mask_by_points(points: DataFrame, grid: GridSpec) -> DataFrame:
    """(gx, gy) of the cells that hold a point, edges included on all sides."""
    fx, fy = (F.col("x") - grid.xoffset) / grid.xsize, (F.col("y") - grid.yoffset) / grid.ysize
    xs = F.explode(F.when(fx == F.floor(fx), F.array(F.floor(fx) - 1, F.floor(fx))).otherwise(F.array(F.floor(fx))))
    ys = F.explode(F.when(fy == F.floor(fy), F.array(F.floor(fy) - 1, F.floor(fy))).otherwise(F.array(F.floor(fy))))
    cells = points.select("x", "y", xs.alias("gx")).select("gx", ys.alias("gy"))
    return cells.where(grid.inside()).distinct()


def grid_over_points(points: DataFrame, grid: GridSpec) -> GridSpec:
    """The smallest grid on the lattice of ``grid`` that holds all points; without points it has no cells."""
    ends = points.agg(*(f(c(v)).alias(f"{n}_{v}") for v, c in (("x", grid.gx), ("y", grid.gy)) for n, f in (("low", F.min), ("high", F.max)))).head()
    if ends.low_x is None or ends.low_y is None:
        return grid.moved(grid.xoffset, grid.yoffset, 0, 0)
    x, y = grid.xoffset + ends.low_x * grid.xsize, grid.yoffset + ends.low_y * grid.ysize
    return grid.moved(x, y, ends.high_x - ends.low_x + 1, ends.high_y - ends.low_y + 1)


def mask_by_polygon(cells: DataFrame, grid: GridSpec, polygon: Polygon) -> DataFrame:
    """cells that the polygon meets: a corner of one in the other, or an edge through the cell.

    The cells are written: Spark would push the test below the aggregate that makes cells of events, and run it for each event.
    """
    cells = written(cells)
    x0, y0 = grid.xoffset + F.col("gx") * grid.xsize, grid.yoffset + F.col("gy") * grid.ysize
    x1, y1 = x0 + grid.xsize, y0 + grid.ysize
    meets = in_polygon(x0, y0, polygon) | in_polygon(x1, y0, polygon) | in_polygon(x0, y1, polygon) | in_polygon(x1, y1, polygon)
    for a, b, c, d in edges_of(polygon):
        meets = meets | ((x0 <= a) & (a <= x1) & (y0 <= b) & (b <= y1))
        t1, t2 = clip(F.lit(a), F.lit(b), F.lit(c), F.lit(d), (x0, y0, x1, y1))
        meets = meets | (t1 <= t2)
    return cells.where(meets)


def cells_by_area(cells: DataFrame, grid: GridSpec, polygon: Polygon) -> DataFrame:
    """cells that share more than a border with the polygon: an edge runs through their inside, or their centre lies in it. They are written, as for ``mask_by_polygon``."""
    cells = written(cells)
    x0, y0 = grid.xoffset + F.col("gx") * grid.xsize, grid.yoffset + F.col("gy") * grid.ysize
    x1, y1 = x0 + grid.xsize, y0 + grid.ysize
    shares = in_polygon(x0 + grid.xsize / 2, y0 + grid.ysize / 2, polygon)
    for a, b, c, d in edges_of(polygon):
        t1, t2 = clip(F.lit(a), F.lit(b), F.lit(c), F.lit(d), (x0, y0, x1, y1))
        along = (F.lit(a == c) & (x0 == a)) | (F.lit(b == d) & (y0 == b))  # on the cell's border
        shares = shares | ((t1 < t2) & ~along)
    return cells.where(shares)


def segments_meeting(segments: DataFrame, polygon: Polygon) -> DataFrame:
    """The segments (x1, y1, x2, y2) that have a point in the polygon or on its border."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    meets = in_polygon(x1, y1, polygon) | in_polygon(x2, y2, polygon)
    for a, b, c, d in edges_of(polygon):
        a, b, c, d = (F.lit(float(v)) for v in (a, b, c, d))
        boxes = (F.greatest(x1, x2) >= F.least(a, c)) & (F.least(x1, x2) <= F.greatest(a, c)) & (F.greatest(y1, y2) >= F.least(b, d)) & (F.least(y1, y2) <= F.greatest(b, d))
        apart = side(x1, y1, x2, y2, a, b) * side(x1, y1, x2, y2, c, d) <= 0
        meets = meets | (boxes & apart & (side(a, b, c, d, x1, y1) * side(a, b, c, d, x2, y2) <= 0))
    return segments.where(meets)


def crop_surface(surface: DataFrame, grid: GridSpec, polygon: Polygon) -> DataFrame:
    """The surface with only those cells valid that share area with the polygon."""
    inside = cells_by_area(surface.select("gx", "gy"), grid, polygon).withColumn("inside", F.lit(True))
    joined = surface.join(inside, ["gx", "gy"], "left")
    return joined.withColumn("valid", F.col("valid") & F.coalesce("inside", F.lit(False))).drop("inside")


def snap_to_centres(points: DataFrame, size: float, xoffset: float = 0.0, yoffset: float = 0.0) -> DataFrame:
    snap = lambda c, off: (F.floor((F.col(c) - off) / size) + 0.5) * size + off
    return points.withColumns({"x": snap("x", xoffset), "y": snap("y", yoffset)})
