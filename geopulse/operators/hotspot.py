"""Risk surfaces of point events: counts, retrospective, prospective and kernel-density hotspots.

Every predictor spreads each event over the cells that it can reach and adds up by cell: one
partial aggregate, no join between events and cells.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.functions import kernels
from geopulse.functions.grid import GridSpec, dense, near_cells
from geopulse.functions.tables import written
from geopulse.operators.points import micros


def surface(cells: DataFrame, values: DataFrame) -> DataFrame:
    """A dense surface (gx, gy, risk, valid)."""
    return dense(cells, values, risk=0.0).select("gx", "gy", "risk", F.lit(True).alias("valid"))


def count_grid(points: DataFrame, grid: GridSpec) -> DataFrame:
    """Number of events in each cell."""
    counts = grid.with_cells(points).where(grid.inside()).groupBy("gx", "gy").agg(F.count("*").cast("double").alias("risk"))
    return surface(grid.cells(points.sparkSession), counts)


def squared_distance(grid: GridSpec) -> Column:
    dx, dy = grid.centre_x() - F.col("x"), grid.centre_y() - F.col("y")
    return dx * dx + dy * dy


def retro_grid(points: DataFrame, grid: GridSpec, weight=kernels.quartic, bandwidth: float = 200.0, **options) -> DataFrame:
    """Sum of the weight between cell centre and events (0 beyond the bandwidth)."""
    near = near_cells(points.select("x", "y"), grid, radius=bandwidth)
    w = weight(squared_distance(grid), bandwidth, **options)
    return surface(grid.cells(points.sparkSession), near.groupBy("gx", "gy").agg(F.sum(w).alias("risk")))


def retro_at(points: DataFrame, at: DataFrame, bandwidth: float = 200.0, weight=kernels.quartic, **options) -> DataFrame:
    """Continuous retrospective risk at the places at(place_id, px, py): places meet the events of near buckets."""
    size = bandwidth
    bucket = lambda c: F.floor(F.col(c) / size)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    events = points.select("x", "y", bucket("x").alias("bx"), bucket("y").alias("by"))
    places = at.select("*", F.explode(around).alias("ox")).select("*", F.explode(around).alias("oy"))
    places = places.select("place_id", "px", "py", (bucket("px") + F.col("ox")).alias("bx"), (bucket("py") + F.col("oy")).alias("by"))
    d2 = (F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2
    found = places.join(events, ["bx", "by"], "left").groupBy("place_id", "px", "py")
    return found.agg(F.coalesce(F.sum(weight(d2, bandwidth, **options)), F.lit(0.0)).alias("risk"))


def sub_cells(grid: GridSpec, samples: int) -> tuple[GridSpec, Column, Column]:
    """The grid of samples x samples places in each cell, and the cell of such a place."""
    fine = GridSpec(grid.xsize / samples, grid.ysize / samples, grid.xoffset, grid.yoffset, grid.xextent * samples, grid.yextent * samples)
    return fine, F.floor(F.col("gx") / samples).cast("long"), F.floor(F.col("gy") / samples).cast("long")


def cell_means(values: DataFrame, grid: GridSpec, samples: int) -> DataFrame:
    """Means over the sub-grid's places: values has (gx, gy, risk) of the places with any risk."""
    _, cx, cy = sub_cells(grid, samples)
    sums = values.select(cx.alias("gx"), cy.alias("gy"), "risk").groupBy("gx", "gy").agg((F.sum("risk") / (samples * samples)).alias("risk"))
    return surface(grid.cells(values.sparkSession), sums)


def retro_subgrid(points: DataFrame, grid: GridSpec, samples: int = 2, bandwidth: float = 200.0, weight=kernels.quartic, **options) -> DataFrame:
    """Cell means of the continuous retrospective risk over a regular sub-grid of places."""
    fine, _, _ = sub_cells(grid, samples)
    near = near_cells(points.select("x", "y"), fine, radius=bandwidth)
    values = near.groupBy("gx", "gy").agg(F.sum(weight(squared_distance(fine), bandwidth, **options)).alias("risk"))
    return cell_means(values, grid, samples)


def prospective_grid(
    points: DataFrame, grid: GridSpec, predict: str, unit_micros: int, distance: str = "same", space: int = 8, time: int = 8
) -> DataFrame:
    """Classic prospective weights between cells; ages in whole units before ``predict``."""
    own = grid.with_cells(points).select(F.col("gx").alias("ex"), F.col("gy").alias("ey"), F.floor((micros(F.lit(predict).cast("timestamp_ntz")) - micros("ts")) / unit_micros).cast("double").alias("age"))
    # Events of one cell and age weigh the same: add them up before they are spread.
    own = own.where((F.col("age") >= 0) & (F.col("age") < time)).groupBy("ex", "ey", "age").agg(F.count("*").alias("n"))
    reach = math.ceil(space) - 1
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    spread = own.select("*", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
    w = kernels.classic(kernels.cell_distance(distance, F.col("dx"), F.col("dy")), F.col("age"), space, time)
    cells = spread.select((F.col("ex") + F.col("dx")).alias("gx"), (F.col("ey") + F.col("dy")).alias("gy"), (w * F.col("n")).alias("w"))
    return surface(grid.cells(points.sparkSession), cells.where(grid.inside()).groupBy("gx", "gy").agg(F.sum("w").alias("risk")))


def prospective_subgrid(
    points: DataFrame, grid: GridSpec, predict: str, unit_micros: int, samples: int = 2, space: float = 8.0, time: float = 8.0
) -> DataFrame:
    """Continuous prospective risk (distance in cells, ages in fractions of a unit), as means over a sub-grid."""
    fine, _, _ = sub_cells(grid, samples)
    age = (micros(F.lit(predict).cast("timestamp_ntz")) - micros("ts")) / unit_micros
    aged = points.select("x", "y", age.alias("age")).where((F.col("age") >= 0) & (F.col("age") < time))
    near = near_cells(aged, fine, radius=space * grid.xsize)
    w = kernels.classic(F.sqrt(squared_distance(fine)) / grid.xsize, F.col("age"), space, time)
    return cell_means(near.groupBy("gx", "gy").agg(F.sum(w).alias("risk")), grid, samples)


def gaussian_kde(
    points: DataFrame, grid: GridSpec, bandwidth: float | None = None, weight: Column | None = None, samples: int = 1
) -> DataFrame:
    """Gaussian kernel density at places of the cells (the centre, or the means of a sub-grid).

    bandwidth None: Scott's rule with the sample covariance; else a fixed bandwidth in both directions.
    weight: an expression of the point's columns. The density has unbounded support, so every event is
    spread over the whole grid; its moments are one aggregate row.
    """
    weighted = points.withColumn("w", F.lit(1.0) if weight is None else F.abs(weight))
    m = weighted.agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.var_samp("x").alias("sxx"), F.var_samp("y").alias("syy"), F.covar_samp("x", "y").alias("sxy"))
    if bandwidth is None:
        h = F.pow(F.col("n").cast("double"), F.lit(-1 / 6))
    else:
        h = F.lit(float(bandwidth))
        m = m.withColumns({"sxx": F.lit(1.0), "syy": F.lit(1.0), "sxy": F.lit(0.0)})
    m = m.withColumn("h", h).withColumn("det", F.expr("sxx * syy - sxy * sxy"))
    fine, _, _ = sub_cells(grid, samples)
    near = near_cells(weighted.select("x", "y", "w"), fine).join(F.broadcast(m))
    near = near.withColumns({"dx": fine.centre_x() - F.col("x"), "dy": fine.centre_y() - F.col("y")})
    q = F.expr("(dx * dx * syy - 2 * dx * dy * sxy + dy * dy * sxx) / det / (2 * h * h)")
    density = F.col("w") * F.exp(-q) / (F.col("sw") * F.sqrt("det") * (2 * math.pi) * F.col("h") * F.col("h"))
    return cell_means(near.groupBy("gx", "gy").agg(F.sum(density).alias("risk")), grid, samples)


def time_weighted_kde(points: DataFrame, grid: GridSpec, end: str, unit_micros: int, kernel: str, scale: float, bandwidth: float | None = None) -> DataFrame:
    """KDE of the events before ``end``, weighted by a kernel of their age."""
    age = (micros(F.lit(end).cast("timestamp_ntz")) - micros("ts")) / unit_micros
    past = points.withColumn("age", age).where("age > 0")
    w = {"constant": kernels.constant_time, "exp": lambda t: kernels.exponential_time(t, scale), "quad": lambda t: kernels.quadratic_time(t, scale)}[kernel](F.col("age"))
    return gaussian_kde(past, grid, bandwidth, w)


NEIGHBOURHOOD = 4  # 3 x 3 cells should hold so many times k points
WIDTH = 3
PAIRS = 1 << 20


def kth_of_block(probes: pa.Table, others: pa.Table, at: list[str], fine: list[str], deepest: int, k: int) -> pa.Table:
    """The probes with d2 of their k-th nearest point, the place itself being one point less, among the others in the cells of their level around theirs."""
    if not probes.num_rows:
        return pa.Table.from_arrays([pa.array([], t) for t in [pa.float64()] * len(at) + [pa.int64()] * len(fine) + [pa.int32(), pa.float64()]], [*at, *fine, "level", "d2"])
    others = others.rename_columns([c.removeprefix("to_") for c in others.column_names])
    shift = deepest - probes.column("level")[0].as_py()
    mine, theirs = (np.stack([t.column(f).to_numpy() >> shift for f in fine], axis=1) for t in (probes, others))
    low, extent = theirs.min(axis=0) - 1, np.ptp(theirs, axis=0) + 3
    # Cells in one number; the last dimension's cells beside one another are one run of places.
    number = lambda c: np.ravel_multi_index(tuple((c - low).T), tuple(extent))
    order = np.argsort(number(theirs), kind="stable")
    held, xs, m = number(theirs)[order], [others.column(c).to_numpy()[order] for c in at], others.column("m").to_numpy()[order]
    asked = [probes.column(c).to_numpy() for c in at]
    steps = [number(low + 1 + np.array(s + (0,))) - number(low + 1) for s in itertools.product((-1, 0, 1), repeat=len(at) - 1)] if len(at) > 1 else [0]
    own = number(mine)
    by = np.argsort(own, kind="stable")
    cells, first = np.unique(own[by], return_index=True)
    d2 = np.empty(len(own))
    starts = np.stack([np.searchsorted(held, cells + s - 1) for s in steps], axis=1)
    ends = np.stack([np.searchsorted(held, cells + s + 1, "right") for s in steps], axis=1)
    for c, rows in enumerate(np.split(by, first[1:])):
        near = np.concatenate([np.arange(a, b) for a, b in zip(starts[c], ends[c], strict=True)])
        weight, once = m[near], bool((m[near] == 1).all())
        step = max(1, PAIRS // len(near))
        for lo in range(0, len(rows), step):
            part = rows[lo : lo + step]
            far = sum((q[part, None] - x[near]) ** 2 for q, x in zip(asked, xs, strict=True))
            if once and len(near) > k:
                d2[part] = np.partition(far, k, axis=1)[:, k]
                continue
            sort = np.argsort(far, axis=1, kind="stable")
            upto = weight[sort].cumsum(axis=1) - 1
            at_k = np.minimum((upto < k).sum(axis=1), len(near) - 1)
            d2[part] = np.take_along_axis(far, np.take_along_axis(sort, at_k[:, None], 1), 1)[:, 0]
    return pa.Table.from_arrays([*(probes.column(c).combine_chunks() for c in at), *(pa.array(probes.column(f).to_numpy(), pa.int64()) for f in fine), probes.column("level").cast(pa.int32()).combine_chunks(), pa.array(d2)], [*at, *fine, "level", "d2"])


def knn_distance(points: DataFrame, k: int = 15, dims: Sequence[str] = ("x", "y")) -> DataFrame:
    """(event_id, distance) to the k-th nearest other point (the farthest if there are fewer).

    Points at one place are one row with a count. Cells are halved from the whole extent on; each
    finest cell takes the level at which the cell and those beside it hold enough points, so dense and sparse
    places meet about as many others. A distance within one cell's size is exact; the other
    places meet once more at a level whose cells are as large as the distance found. Levels are
    found from counts of cells; the driver sees the extent only, as joins are sorted: written tables are small as files, but not as rows to broadcast.
    """
    at, fine, cell, other, block = ([f"{p}{i}" for i in range(len(dims))] for p in ("at", "f", "c", "o", "b"))
    points = points.select("event_id", *(F.col(c).cast("double").alias(a) for c, a in zip(dims, at, strict=True)))
    places = written(points.groupBy(*at).agg(F.count("*").alias("m")))
    box = places.agg(F.sum("m").alias("n"), F.count("*").alias("places"), *(f(c).alias(f"{name}_{c}") for c in at for name, f in (("low", F.min), ("high", F.max)))).head()
    k = min(k, (box.n or 0) - 1)
    if k < 1:
        return points.select("event_id", F.lit(0.0).alias("distance")).where("false")
    side = max(box[f"high_{c}"] - box[f"low_{c}"] for c in at) or 1.0
    deepest = min(26, math.ceil(math.log(max(1.0, box.places / k), 2 ** len(at))) + 4)
    most = (1 << deepest) - 1
    number = lambda c: F.least(F.floor((F.col(c) - box[f"low_{c}"]) / side * (1 << deepest)), F.lit(most))
    numbered = written(places.select(*at, "m", *(number(c).alias(f) for c, f in zip(at, fine, strict=True))))
    cells = written(numbered.groupBy(*fine).agg(F.sum("m").alias("n")))
    offsets = list(itertools.product((-1, 0, 1), repeat=len(at)))
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(o) for v, o in zip(x, other, strict=True))) for x in offsets)))
    own = [F.call_function("shiftright", f, (F.lit(deepest) - F.col("level")).cast("int")).alias(c) for f, c in zip(fine, cell, strict=True)]
    up = cells.select(*fine, "n", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level")).select(*fine, "n", "level", *own)
    beside = lambda df: df.select("*", around.alias("o")).withColumns({c: F.col(c) + F.col(f"o.{o}") for c, o in zip(cell, other, strict=True)}).drop("o")
    held = beside(up.groupBy("level", *cell).agg(F.sum("n").alias("n"))).groupBy("level", *cell).agg(F.sum("n").alias("held"))
    enough = held.where((F.col("held") > NEIGHBOURHOOD * k) | (F.col("level") == 0)).select("level", *cell)
    chosen = written(up.join(enough.hint("merge"), ["level", *cell]).groupBy(*fine).agg(F.max("level").alias("level")))

    def meet(probes: DataFrame) -> DataFrame:
        """probes(place, fine cell, level) with d2: the k-th least over the cells around, each place as often as it has points.

        Blocks of ``1 << WIDTH`` cells in each direction meet all places of their cells and of those beside them as arrays, so no row stands for a pair.
        """
        probes = probes.select(*at, "level", *own, *fine)
        in_block = [F.shiftright(c, WIDTH).alias(b) for c, b in zip(cell, block, strict=True)]
        needed = beside(probes.select("level", *cell, *in_block).distinct()).distinct()
        levels = up.join(needed.hint("merge"), ["level", *cell]).select(*fine, "level", *block)
        others = numbered.join(levels.hint("merge"), fine).select(*(F.col(c).alias(f"to_{c}") for c in ("level", *block, *fine, *at, "m")))
        key = ["level", *block]
        probes = probes.select(*at, *fine, *key[:1], *in_block)
        schema = ", ".join([*(f"{c} double" for c in at), *(f"{f} long" for f in fine), "level int", "d2 double"])
        return probes.groupBy(*key).cogroup(others.groupBy(*(f"to_{c}" for c in key))).applyInArrow(lambda asked, all_: kth_of_block(asked, all_, at, fine, deepest, k), schema)

    first = written(meet(numbered.join(chosen.hint("merge"), fine)).withColumn("done", (F.col("level") == 0) | (F.sqrt("d2") <= side * F.pow(F.lit(2.0), -F.col("level")))))
    wider = F.greatest(F.lit(0), F.least(F.col("level") - 1, F.floor(F.log2(side / F.sqrt("d2")) - 1e-9))).cast("int")
    rest = meet(first.where("not done").withColumn("level", wider))
    found = first.where("done").select(*at, "d2").unionAll(rest.select(*at, "d2"))
    return points.join(found.hint("merge"), at).select("event_id", F.sqrt("d2").alias("distance"))


def nearest_neighbour_kde(points: DataFrame, grid: GridSpec, k: int = 15) -> DataFrame:
    """KDE whose bandwidth at each event is its normalised k-th neighbour distance (0 becomes 1)."""
    m = points.agg(F.count("*").alias("n"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy"))
    scaled = points.join(F.broadcast(m)).select("event_id", (F.col("x") / F.col("sx")).alias("x"), (F.col("y") / F.col("sy")).alias("y"))
    h = knn_distance(scaled, k).select("event_id", F.when(F.col("distance") == 0, 1.0).otherwise(F.col("distance")).alias("h"))
    near = near_cells(points.select("event_id", "x", "y").join(h.hint("merge"), "event_id"), grid).join(F.broadcast(m))
    near = near.withColumns({"dx": (grid.centre_x() - F.col("x")) / F.col("sx"), "dy": (grid.centre_y() - F.col("y")) / F.col("sy")})
    density = F.expr("exp(-(dx * dx + dy * dy) / (2 * h * h)) / (h * h)") / (F.col("n") * F.col("sx") * F.col("sy") * (2 * math.pi))
    return surface(grid.cells(points.sparkSession), near.groupBy("gx", "gy").agg(F.sum(density).alias("risk")))


RADII, ANGLES = 10, 100


def edge_correction(valid: DataFrame, grid: GridSpec, bandwidth: float) -> DataFrame:
    """(gx, gy, factor): the share of a normal cloud about each valid cell's centre that falls into valid cells.

    The cloud has ``RADII`` rings of equal weight with ``ANGLES`` places each.
    """
    cells = valid.where("valid").select("gx", "gy")
    share = (F.col("i") + 0.5) / RADII
    radius = bandwidth * F.sqrt(-2 * F.ln(1 - share))
    angle = F.col("a") * (2 * math.pi / ANGLES)
    cloud = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(RADII - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(ANGLES - 1))).alias("a"))
    at = cloud.select(F.col("gx").alias("cx"), F.col("gy").alias("cy"), grid.gx(grid.centre_x() + radius * F.cos(angle)).alias("gx"), grid.gy(grid.centre_y() + radius * F.sin(angle)).alias("gy"))
    # Places of one cell that fall into the same cell are added up before they meet the mask.
    counts = at.groupBy("cx", "cy", "gx", "gy").agg(F.count("*").alias("n")).join(cells, ["gx", "gy"])
    return counts.groupBy(F.col("cx").alias("gx"), F.col("cy").alias("gy")).agg((F.sum("n") / (RADII * ANGLES)).alias("factor"))


def edge_corrected_kde(points: DataFrame, valid: DataFrame, grid: GridSpec, bandwidth: float) -> DataFrame:
    """Fixed-bandwidth KDE at the valid cells' centres over the share of the kernel that lies in valid cells."""
    density = gaussian_kde(points, grid, bandwidth).select("gx", "gy", "risk")
    joined = density.join(edge_correction(valid, grid, bandwidth), ["gx", "gy"])
    return joined.select("gx", "gy", (F.col("risk") / F.col("factor")).alias("risk"), F.lit(True).alias("valid"))
