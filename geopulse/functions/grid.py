"""Regular grids: cell expressions and dense cell tables."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridSpec:
    """A grid of xextent x yextent cells from (xoffset, yoffset)."""

    xsize: float
    ysize: float
    xoffset: float = 0.0
    yoffset: float = 0.0
    xextent: int = 1
    yextent: int = 1

    @staticmethod
    def over_region(region: tuple[float, float, float, float], xsize: float, ysize: float | None = None, rounding: str = "ceil") -> GridSpec:
        """The grid of a region (xmin, ymin, xmax, ymax); a part of a cell counts as one ("ceil"), or by half-even rounding ("rint")."""
        ysize = xsize if ysize is None else ysize
        whole = math.ceil if rounding == "ceil" else round
        xmin, ymin, xmax, ymax = region
        return GridSpec(xsize, ysize, xmin, ymin, whole((xmax - xmin) / xsize), whole((ymax - ymin) / ysize))

    def gx(self, x: Column | str = "x") -> Column:
        return F.floor((_col(x) - self.xoffset) / self.xsize).cast("long")

    def gy(self, y: Column | str = "y") -> Column:
        return F.floor((_col(y) - self.yoffset) / self.ysize).cast("long")

    def centre_x(self, gx: Column | str = "gx") -> Column:
        return (_col(gx) + 0.5) * self.xsize + self.xoffset

    def centre_y(self, gy: Column | str = "gy") -> Column:
        return (_col(gy) + 0.5) * self.ysize + self.yoffset

    def inside(self, gx: Column | str = "gx", gy: Column | str = "gy") -> Column:
        return _col(gx).between(0, self.xextent - 1) & _col(gy).between(0, self.yextent - 1)

    def with_cells(self, points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
        """points with the cell (gx, gy) of each."""
        return points.withColumns({"gx": self.gx(x), "gy": self.gy(y)})

    def cells(self, spark: SparkSession) -> DataFrame:
        """All cells (gx, gy), made on the executors."""
        n = self.xextent * self.yextent
        return spark.range(n).select((F.col("id") % self.xextent).alias("gx"), F.floor(F.col("id") / self.xextent).alias("gy"))

    def region(self) -> tuple[float, float, float, float]:
        return self.xoffset, self.yoffset, self.xoffset + self.xsize * self.xextent, self.yoffset + self.ysize * self.yextent

    def cell_box(self, gx: int, gy: int) -> tuple[float, float, float, float]:
        x, y = self.xoffset + gx * self.xsize, self.yoffset + gy * self.ysize
        return x, y, x + self.xsize, y + self.ysize

    def moved(self, xoffset: float, yoffset: float, xextent: int, yextent: int) -> GridSpec:
        return replace(self, xoffset=xoffset, yoffset=yoffset, xextent=xextent, yextent=yextent)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def near_cells(points: DataFrame, grid: GridSpec, x: str = "x", y: str = "y", radius: float | None = None) -> DataFrame:
    """Each point with every grid cell whose centre may lie within ``radius`` (all cells where it is None).

    The cells are generated for each point, so what follows is an ordinary partial aggregate by cell:
    no join, and a shuffle of at most the grid's cells for each task.
    """
    if radius is None:
        xs, ys = F.sequence(F.lit(0), F.lit(grid.xextent - 1)), F.sequence(F.lit(0), F.lit(grid.yextent - 1))
    else:
        low = lambda v, off, size: F.greatest(F.lit(0), F.ceil((v - radius - off) / size - 0.5).cast("int"))
        high = lambda v, off, size, n: F.least(F.lit(n - 1), F.floor((v + radius - off) / size - 0.5).cast("int"))
        span = lambda a, b: F.when(a <= b, F.sequence(a, b))
        xs = span(low(F.col(x), grid.xoffset, grid.xsize), high(F.col(x), grid.xoffset, grid.xsize, grid.xextent))
        ys = span(low(F.col(y), grid.yoffset, grid.ysize), high(F.col(y), grid.yoffset, grid.ysize, grid.yextent))
    spread = points.select("*", F.explode(xs).alias("gx")).select("*", F.explode(ys).alias("gy"))
    return spread.withColumns({"gx": F.col("gx").cast("long"), "gy": F.col("gy").cast("long")})


def dense(cells: DataFrame, values: DataFrame, **defaults) -> DataFrame:
    """All cells with the values of those that have any, and defaults elsewhere."""
    joined = cells.join(values, ["gx", "gy"], "left")
    return joined.fillna(defaults)
