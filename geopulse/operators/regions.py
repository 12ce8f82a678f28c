"""Regions as tables: polygons of any number of rings, holes among them, and the places that lie in them.

Rings are rows (region_id, ring_id, seq, x, y), in any number of regions; the last corner needn't repeat the first.
A place lies in a region if it is on one of its edges, or if an odd number of edges pass to its right, so a ring
inside another is a hole, and a ring inside that an island.

A place meets the regions whose box holds it, in cells as wide as the box (a level for each power of two). Of such a
region it meets the edges of its own slab: an edge lies in the slabs, of its own height or up to twice as high, that it
passes through (two at most), so neither a long edge nor a region of very many edges makes more than two rows of an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.functions.grid import GridSpec
from geopulse.functions.tables import written
from geopulse.operators.scan import power

LEAST = 2.0**-20


def ring_edges(rings: DataFrame) -> DataFrame:
    """(region_id, x1, y1, x2, y2): the edges of all rings, without those of no length; corners with a null are left out."""
    own = W.partitionBy("region_id", "ring_id").orderBy("seq")
    corner = F.struct("x", "y")
    after = F.coalesce(F.lead(corner).over(own), F.first(corner).over(own))
    corners = rings.where("region_id is not null and ring_id is not null and x is not null and y is not null")
    edges = corners.select("region_id", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), after.alias("n"))
    edges = edges.select("region_id", "x1", "y1", F.col("n.x").cast("double").alias("x2"), F.col("n.y").cast("double").alias("y2"))
    return edges.where("x1 <> x2 or y1 <> y2")


def part(c: Column | str, level: Column | str) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / F.pow(F.lit(2.0), level)).cast("long")


def in_boxes(places: DataFrame, boxes: DataFrame) -> DataFrame:
    """places(x, y, ...) with the columns of each box (xmin, ymin, xmax, ymax, ...) that holds them."""
    sized = boxes.withColumn("level", power(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")), LEAST))
    # One for each power of two that occurs: a few dozen, whatever the boxes are.
    levels = [r.level for r in sized.select("level").distinct().collect()]
    span = lambda a, b: F.explode(F.sequence(part(a, "level"), part(b, "level")))
    spread = sized.select("*", span("xmin", "xmax").alias("bx")).select("*", span("ymin", "ymax").alias("by"))
    at = F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")
    own = places.select("*", F.explode(at).alias("level")).withColumns({"bx": part("x", "level"), "by": part("y", "level")})
    inside = F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))
    return own.join(spread, ["level", "bx", "by"]).where(inside).drop("level", "bx", "by")


def crossed() -> Column:
    """Does the edge pass the place (x, y) on its right? Half-open, so that a corner counts once."""
    return F.expr("(y1 > y) <> (y2 > y) and coalesce(x < try_divide((x2 - x1) * (y - y1), y2 - y1) + x1, false)")


def on_edge() -> Column:
    return F.expr("(x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) and x between least(x1, x2) and greatest(x1, x2) and y between least(y1, y2) and greatest(y1, y2)")


def places_in_regions(places: DataFrame, rings: DataFrame, key: list[str], repeated: bool = True) -> DataFrame:
    """The key columns and region_id, once for each place (x, y, identified by the key) and each region in which it lies.

    Places without coordinates lie nowhere; repeated rows count once, and repeated keys should have equal coordinates. A caller that
    knows that no key is repeated saves a shuffle by ``repeated=False``. Edges are written, so that Spark knows
    their size and sends small tables of them to all tasks; with large ones, regions that hold very many places are
    split by adaptive execution.
    """
    edges = ring_edges(rings).withColumn("slab_level", power(F.abs(F.col("y2") - F.col("y1")), LEAST))
    edges = written(edges)
    boxes = edges.groupBy("region_id").agg(
        *(f(g(f"{c}1", f"{c}2")).alias(f"{c}{name}") for c in "xy" for f, g, name in ((F.min, F.least, "min"), (F.max, F.greatest, "max"))),
        F.collect_set("slab_level").alias("slab_levels"),  # a few dozen at most
    )
    places = places.select(*key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    met = in_boxes(places.distinct() if repeated else places, written(boxes))
    met = met.select(*key, "x", "y", "region_id", F.explode("slab_levels").alias("slab_level")).withColumn("slab", part("y", "slab_level"))
    span = F.sequence(part(F.least("y1", "y2"), "slab_level"), part(F.greatest("y1", "y2"), "slab_level"))
    near = met.join(edges.select("*", F.explode(span).alias("slab")), ["region_id", "slab_level", "slab"])
    sums = near.select(*key, "region_id", crossed().cast("int").alias("crossing"), on_edge().alias("edge"))
    sums = sums.groupBy(*key, "region_id").agg(F.sum("crossing").alias("crossings"), F.max("edge").alias("edge"))
    return sums.where("edge or crossings % 2 = 1").select(*key, "region_id")


def points_in_regions(points: DataFrame, rings: DataFrame) -> DataFrame:
    """The points (with event_id) that lie in any of the regions."""
    return points.join(places_in_regions(points, rings, ["event_id"]).select("event_id"), "event_id", "left_semi")


def grid_over_regions(rings: DataFrame, grid: GridSpec) -> GridSpec:
    """The smallest grid on the lattice of ``grid`` that holds all corners; without any it has no cells."""
    from geopulse.operators.geometry import grid_over_points

    return grid_over_points(rings.dropna(subset=["x", "y"]), grid)


def cells_meeting(rings: DataFrame, grid: GridSpec) -> DataFrame:
    """(gx, gy) of the grid's cells, borders included, that have a place in common with a region.

    Either an edge passes through the cell, and edges are followed from column to column, so that a long one makes a row for each cell that
    it meets only; or the cell lies within a region as a whole, and so does its centre.
    """
    edges = ring_edges(rings)
    to_cells = lambda c, off, size: (F.col(c) - off) / size
    e = edges.select(*(to_cells(f"{c}{k}", off, size).alias(f"{c}{k}") for c, off, size in (("x", grid.xoffset, grid.xsize), ("y", grid.yoffset, grid.ysize)) for k in (1, 2)))
    first = lambda v: F.greatest(F.ceil(v) - 1, F.lit(0))
    last = lambda v, n: F.least(F.floor(v), F.lit(n - 1))
    span = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)))
    columns = e.select("*", span(first(F.least("x1", "x2")), last(F.greatest("x1", "x2"), grid.xextent)).alias("gx"))
    # The edge's heights where it enters and leaves the column; a column that it touches only gives one height.
    part_of = lambda at: F.when(F.col("x1") == F.col("x2"), F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(at - F.col("x1"), F.col("x2") - F.col("x1")))))
    height = lambda t, whole: F.coalesce(F.when(t == 1, F.col("y2")).otherwise(F.col("y1") + t * (F.col("y2") - F.col("y1"))), F.col(whole))
    a, b = height(part_of(F.col("gx")), "y1"), height(part_of(F.col("gx") + 1), "y2")
    columns = columns.select("gx", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    touched = columns.select("gx", span(first(F.col("low")), last(F.col("high"), grid.yextent)).alias("gy"))
    cells = grid.cells(rings.sparkSession)
    inner = places_in_regions(cells.select("gx", "gy", grid.centre_x().alias("x"), grid.centre_y().alias("y")), rings, ["gx", "gy"], repeated=False)
    return touched.select(F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy")).unionByName(inner.select("gx", "gy")).distinct()
