"""Operations on risk surfaces (gx, gy, risk, valid)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.functions.grid import GridSpec

def whole():
    """All rows in one window: a surface has a bounded number of cells."""
    return W.partitionBy()


def risk_at(points: DataFrame, surface: DataFrame, grid: GridSpec) -> DataFrame:
    """points with the risk of their cell, 0 outside."""
    joined = grid.with_cells(points).join(surface.select("gx", "gy", "risk"), ["gx", "gy"], "left")
    return joined.withColumn("risk", F.coalesce("risk", F.lit(0.0)))


def mask_with(surface: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells without a row (gx, gy) in the mask of valid cells become invalid."""
    hit = mask.select("gx", "gy").distinct().withColumn("in_mask", F.lit(True))
    joined = surface.join(hit, ["gx", "gy"], "left")
    return joined.withColumn("valid", F.col("valid") & F.coalesce("in_mask", F.lit(False))).drop("in_mask")


def total(surface: DataFrame, name: str = "total") -> DataFrame:
    return surface.where("valid").agg(F.sum("risk").alias(name))


def renormalise(surface: DataFrame) -> DataFrame:
    """Divide by the sum over valid cells; a sum that isn't positive is an error."""
    joined = surface.join(F.broadcast(total(surface)))
    part = F.when(F.col("total") > 0, F.col("risk") / F.col("total")).otherwise(F.raise_error(F.lit("the surface has no positive risk")))
    return joined.withColumn("risk", part).drop("total")


def zero_to_constant(surface: DataFrame) -> DataFrame:
    """All 1 where the total isn't positive."""
    joined = surface.join(F.broadcast(total(surface)))
    return joined.withColumn("risk", F.when(F.coalesce("total", F.lit(0.0)) > 0, F.col("risk")).otherwise(1.0)).drop("total")


def percentile(surface: DataFrame) -> DataFrame:
    """The fraction of valid cells with at most the cell's risk."""
    return surface.where("valid").select("gx", "gy", F.cume_dist().over(whole().orderBy("risk")).alias("percentile"))


def new_extent(surface: DataFrame, grid: GridSpec, to: GridSpec) -> DataFrame:
    """The surface on another window of the same lattice: new cells have no risk, the mask is dropped."""
    dx, dy = (to.xoffset - grid.xoffset) / grid.xsize, (to.yoffset - grid.yoffset) / grid.ysize
    if dx != round(dx) or dy != round(dy):
        raise ValueError("the offset must move by whole cells")
    moved = surface.select((F.col("gx") - round(dx)).alias("gx"), (F.col("gy") - round(dy)).alias("gy"), "risk")
    cells = to.cells(surface.sparkSession).join(moved, ["gx", "gy"], "left")
    return cells.select("gx", "gy", F.coalesce("risk", F.lit(0.0)).alias("risk"), F.lit(True).alias("valid"))


def break_ties(surface: DataFrame, seed: int = 0) -> DataFrame:
    """Add noise below a hundredth of the least gap, at most 1e-9, where there are ties."""
    order = whole().orderBy("risk")
    gaps = surface.where("valid").select(F.col("risk"), (F.col("risk") - F.lag("risk").over(order)).alias("gap"))
    noise = gaps.agg(F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("least"), F.count(F.when(F.col("gap") == 0, 1)).alias("ties"))
    scale = F.when(F.col("ties") > 0, F.least(F.lit(1e-9), F.coalesce(F.col("least"), F.lit(1e-7)) / 100)).otherwise(0.0)
    return surface.join(F.broadcast(noise)).withColumn("risk", F.col("risk") + scale * F.xxhash64("gx", "gy", F.lit(seed)) / 2.0**63).drop("least", "ties")


def cell_edges(surface: DataFrame, grid: GridSpec) -> DataFrame:
    """Corners of each cell."""
    x, y = grid.xoffset + F.col("gx") * grid.xsize, grid.yoffset + F.col("gy") * grid.ysize
    return surface.select("*", x.alias("x0"), y.alias("y0"), (x + grid.xsize).alias("x1"), (y + grid.ysize).alias("y1"))


def slice_top(surface: DataFrame, fraction: Column | float) -> DataFrame:
    """surface with ``rank`` (1 is the greatest risk) and ``selected``: exactly floor(n * fraction) valid cells; of ties the last in row order."""
    w = whole().orderBy(F.desc("risk"), F.desc("gy"), F.desc("gx"))
    ranked = surface.where("valid").select("*", F.row_number().over(w).alias("rank"), F.count("*").over(whole()).alias("n_cells"))
    return ranked.withColumn("selected", F.col("rank") <= F.floor(F.col("n_cells") * fraction))
