"""Gaussian densities with a full covariance in any number of dimensions, their edge correction, and the score against them.

f(q) = sum of w_i / h_i**n * exp(-(q - x_i)' S^-1 (q - x_i) / (2 h_i**2)), over (sum of w) * sqrt(det S) * (2 pi)**(n/2).
With the Cholesky factor S = L L' and z = L^-1 x, that is a mixture of round Gaussians of width h_i at the
z_i, over det L, and ``mixtures.density_at`` meets places and Gaussians by buckets of their reach.
The factor is one row, found by aggregates and a few column expressions. A covariance that isn't positive, but for rounding, raises.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.functions.grid import GridSpec
from geopulse.functions.tables import written
from geopulse.operators import mixtures
from geopulse.operators.regions import places_in_regions

RADII, ANGLES = 10, 100
SINGULAR = 1e-13  # of a variance: what is left of it there is rounding
Covariance = list[list[float]]


def moments(points: DataFrame, dims: list[str], covariance: Covariance | None = None) -> DataFrame:
    """One row: n and the covariance s00, s10, s11, ... (that of the sample where none is given)."""
    pairs = [(i, j) for i in range(len(dims)) for j in range(i + 1)]
    own = [(F.covar_samp(dims[i], dims[j]) if covariance is None else F.lit(float(covariance[i][j]))).alias(f"s{i}{j}") for i, j in pairs]
    if covariance is None:
        return points.agg(F.count("*").alias("n"), *own)
    return points.agg(F.count("*").alias("n")).select("n", *own)


def cholesky(row: DataFrame, n_dims: int) -> DataFrame:
    """The row of ``moments`` with the lower triangle l00, l10, l11, ... and root_det, its determinant."""
    for j in range(n_dims):
        rest = lambda i, j=j: F.col(f"s{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        positive = F.when(rest(j) > F.col(f"s{j}{j}") * SINGULAR, F.sqrt(rest(j))).otherwise(F.raise_error(F.lit("the covariance is not positive")).cast("double"))
        row = row.withColumn(f"l{j}{j}", positive)
        row = row.withColumns({f"l{i}{j}": rest(i) / F.col(f"l{j}{j}") for i in range(j + 1, n_dims)})
    return row.withColumn("root_det", math.prod((F.col(f"l{i}{i}") for i in range(1, n_dims)), start=F.col("l00")))


def whitened(df: DataFrame, dims: list[str], name: str) -> DataFrame:
    """df, joined with the factor, with the coordinates name0, name1, ... = L^-1 x."""
    for i, c in enumerate(dims):
        rest = F.col(c).cast("double") - sum((F.col(f"l{i}{k}") * F.col(f"{name}{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"{name}{i}", rest / F.col(f"l{i}{i}"))
    return df


def width(bandwidth: str | float | Column, n_dims: int) -> Column:
    """h by Scott's or Silverman's rule from the number n of points, one number, or a column of the points."""
    if not isinstance(bandwidth, str):
        return bandwidth if isinstance(bandwidth, Column) else F.lit(float(bandwidth))
    factors = {"scott": F.lit(1.0), "silverman": F.lit((n_dims + 2) / 4)}
    if bandwidth not in factors:
        raise ValueError(f"no rule named {bandwidth}")
    return F.pow(F.col("n") * factors[bandwidth], F.lit(-1 / (n_dims + 4)))


def density(
    points: DataFrame, places: DataFrame, dims: list[str], key: list[str], bandwidth: str | float | Column = "scott",
    weight: Column | None = None, covariance: Covariance | None = None, reach: float = mixtures.REACH,
) -> DataFrame:
    """places' key columns with the density there. Weights count by their size; points with a null coordinate are left out.

    What lies beyond ``reach`` widths of a point is taken for 0; 39 is where doubles end.
    """
    h2 = width(bandwidth, len(dims)) ** 2
    known = points.dropna(subset=dims)
    factor = written(cholesky(moments(known, dims, covariance), len(dims)))
    shapes = whitened(known.withColumn("w", F.lit(1.0) if weight is None else F.abs(weight)).join(F.broadcast(factor)), dims, "m")
    mix = shapes.withColumn("h2", h2)
    mix = written(mix.select(*(f"m{i}" for i in range(len(dims))), *(F.col("h2").alias(f"v{i}") for i in range(len(dims))), "w"))
    total = mix.agg(F.sum("w").alias("total"))
    asked = whitened(places.join(F.broadcast(factor)), dims, "z").select(*key, *(f"z{i}" for i in range(len(dims))))
    found = mixtures.density_at(mix, asked, [f"z{i}" for i in range(len(dims))], key, reach=reach)
    scale = factor.join(F.broadcast(total)).select((F.col("total") * F.col("root_det")).alias("scale"))
    return found.join(F.broadcast(scale)).select(*key, (F.col("density") / F.col("scale")).alias("density"))


def cloud(places: DataFrame, key: list[str], factor: DataFrame, bandwidth: str | float) -> DataFrame:
    """The key, i, a and x, y: for each place (x, y) a normal cloud of ``RADII`` rings of equal weight with ``ANGLES`` places each.

    The cloud is stretched by the symmetric root of the covariance, which for two dimensions is (S + d I) / t with d the root
    of the determinant and t the root of trace + 2 d.
    """
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = F.sqrt(F.col("s00") + F.col("s11") + 2 * F.col("root_det"))
    root = factor.select(((F.col("s00") + F.col("root_det")) / t).alias("r00"), (F.col("s10") / t).alias("r10"), ((F.col("s11") + F.col("root_det")) / t).alias("r11"), width(bandwidth, 2).alias("h"))
    spread = places.select(*key, "x", "y", steps(RADII).alias("i")).select("*", steps(ANGLES).alias("a")).join(F.broadcast(root))
    radius = F.col("h") * F.sqrt(-2 * F.ln(1 - (F.col("i") + 0.5) / RADII))
    angle = F.col("a") * (2 * math.pi / ANGLES)
    u, v = radius * F.cos(angle), radius * F.sin(angle)
    return spread.select(*key, "i", "a", (F.col("x") + F.col("r00") * u + F.col("r10") * v).alias("x"), (F.col("y") + F.col("r10") * u + F.col("r11") * v).alias("y"))


def region_factors(points: DataFrame, places: DataFrame, key: list[str], rings: DataFrame, bandwidth: str | float = "scott", covariance: Covariance | None = None) -> DataFrame:
    """The key, region_id and factor: for each place and each region in which it lies, the share of its cloud that lies there too.

    The cloud has the shape of the points' kernel (``density``); dividing a density by the factor corrects it for the region's edge.
    """
    factor = written(cholesky(moments(points, ["x", "y"], covariance), 2))
    inside = written(places_in_regions(places, rings, key))
    around = cloud(places.dropDuplicates(key).join(inside, key, "left_semi"), key, factor, bandwidth)
    hits = places_in_regions(around, rings, [*key, "i", "a"], repeated=False).groupBy(*key, "region_id").agg(F.count("*").alias("hits"))
    return inside.join(hits, [*key, "region_id"], "left").select(*key, "region_id", (F.coalesce("hits", F.lit(0)) / (RADII * ANGLES)).alias("factor"))


def mask_factors(points: DataFrame, places: DataFrame, key: list[str], valid: DataFrame, grid: GridSpec, bandwidth: str | float = "scott", covariance: Covariance | None = None) -> DataFrame:
    """The key and factor: the share of each place's cloud that falls into the valid cells (gx, gy)."""
    factor = written(cholesky(moments(points, ["x", "y"], covariance), 2))
    around = grid.with_cells(cloud(places, key, factor, bandwidth))
    # Places of one cloud that fall into the same cell are added up before they meet the mask.
    counts = around.groupBy(*key, "gx", "gy").agg(F.count("*").alias("_n"))
    hits = counts.join(valid.select("gx", "gy"), ["gx", "gy"]).groupBy(*key).agg(F.sum("_n").alias("hits"))
    return places.select(*key).join(hits, key, "left").select(*key, (F.coalesce("hits", F.lit(0)) / (RADII * ANGLES)).alias("factor"))


def corrected_surface(points: DataFrame, valid: DataFrame, grid: GridSpec, bandwidth: str | float = "scott", covariance: Covariance | None = None, samples: int = 5) -> DataFrame:
    """The valid cells (gx, gy) with the mean, over samples x samples places of each, of the density corrected for the mask's edge.

    Clouds lie alike about the places of all cells. So those of one cell are counted by the cells they fall into, at most ``RADII`` *
    ``ANGLES`` * samples**2 rows, and each valid cell takes that table over.
    """
    steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    at = lambda cell, sub, size, off: (F.col(cell) + (F.col(sub) + 0.5) / samples) * size + off
    key = ["px", "py", "sx", "sy"]

    def places_of(cells: DataFrame) -> DataFrame:
        each = cells.select(F.col("gx").alias("px"), F.col("gy").alias("py"), steps().alias("sx")).select("*", steps().alias("sy"))
        return each.select(*key, at("px", "sx", grid.xsize, grid.xoffset).alias("x"), at("py", "sy", grid.ysize, grid.yoffset).alias("y"))

    dense = density(points, places_of(valid), ["x", "y"], key, bandwidth, covariance=covariance)
    factor = written(cholesky(moments(points, ["x", "y"], covariance), 2))
    one = places_of(points.sparkSession.range(1).select(F.lit(0).cast("long").alias("gx"), F.lit(0).cast("long").alias("gy")))
    offsets = grid.with_cells(cloud(one, key, factor, bandwidth)).groupBy("sx", "sy", F.col("gx").alias("ox"), F.col("gy").alias("oy")).agg(F.count("*").alias("k"))
    reached = valid.select(F.col("gx").alias("px"), F.col("gy").alias("py")).join(F.broadcast(written(offsets)))
    hits = reached.select(*key, (F.col("px") + F.col("ox")).alias("gx"), (F.col("py") + F.col("oy")).alias("gy"), "k").join(valid.select("gx", "gy"), ["gx", "gy"])
    shares = hits.groupBy(*key).agg((F.sum("k") / (RADII * ANGLES)).alias("factor"))
    return dense.join(shares, key).groupBy(F.col("px").alias("gx"), F.col("py").alias("gy")).agg(F.avg(F.try_divide("density", "factor")).alias("risk"))


def score(surface: DataFrame, points: DataFrame, grid: GridSpec, bandwidth: str | float = "scott", covariance: Covariance | None = None, samples: int = 5) -> DataFrame:
    """One row, score: the squared error, times the cell area, of a normalised surface's valid cells against the normalised,
    edge-corrected density of the points; by Scott's rule with the points' covariance, or with a bandwidth and covariance of one's own.
    Fewer than three points raise."""
    if len(points.select("x").head(3)) < 3:
        raise ValueError("a density needs at least three points")
    truth = corrected_surface(points, surface.where("valid"), grid, bandwidth, covariance, samples)
    truth = truth.select("gx", "gy", (F.col("risk") / F.sum("risk").over(W.partitionBy())).alias("q"))  # a row for each cell of the grid
    joined = surface.where("valid").join(truth, ["gx", "gy"])
    return joined.agg((F.sum((F.col("risk") - F.col("q")) ** 2) * (grid.xsize * grid.ysize)).alias("score"))
