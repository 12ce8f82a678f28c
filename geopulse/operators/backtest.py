"""Rolling back-tests: predict at each period's start, score on the period."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.functions.grid import GridSpec
from geopulse.functions.tables import written
from geopulse.operators import evaluate, hotspot, surface
from geopulse.operators.points import between


def periods(first: str, stop_before: str, days: float) -> list[tuple[str, str]]:
    """Adjoining [start, end) while end is not after ``stop_before``."""
    start, stop, step, out = datetime.fromisoformat(first), datetime.fromisoformat(stop_before), timedelta(days=days), []
    while start + step <= stop:
        out.append((start.isoformat(sep=" "), (start + step).isoformat(sep=" ")))
        start += step
    return out


def prediction_dates(assess_start: str, assess_end: str, every_days: float, score_days: float) -> list[tuple[str, str]]:
    """(date, end of scoring): from the first midnight on every ``every_days``, while the scoring ends by ``assess_end``."""
    at, stop, out = datetime.fromisoformat(assess_start[:10]), datetime.fromisoformat(assess_end), []
    while at + timedelta(days=score_days) <= stop:
        out.append((at.isoformat(sep=" "), (at + timedelta(days=score_days)).isoformat(sep=" ")))
        at += timedelta(days=every_days)
    return out


Predictor = Callable[[DataFrame, GridSpec, str], DataFrame]

PREDICTORS: dict[str, Predictor] = {
    "naive": lambda p, g, t: hotspot.count_grid(p, g),
    "retro": lambda p, g, t: hotspot.retro_grid(p, g),
    "prospective": lambda p, g, t: hotspot.prospective_grid(p, g, t, 86_400_000_000),
    "kde": lambda p, g, t: hotspot.gaussian_kde(p, g),
    "retro_cts": lambda p, g, t: hotspot.retro_subgrid(p, g),
    "prospective_cts": lambda p, g, t: hotspot.prospective_subgrid(p, g, t, 86_400_000_000),
    "kde_exp": lambda p, g, t: hotspot.time_weighted_kde(p, g, t, 86_400_000_000, "exp", 7.0),
    "kde_knn": lambda p, g, t: hotspot.nearest_neighbour_kde(p, g),
}


def predict(predictor: str | Predictor, points: DataFrame, grid: GridSpec, at: str, mask: DataFrame | None = None) -> DataFrame:
    """The surface of the events before ``at``: zeros to a constant, masked, renormalised."""
    s = surface.zero_to_constant((PREDICTORS[predictor] if isinstance(predictor, str) else predictor)(between(points, end=at), grid, at))
    return surface.renormalise(s if mask is None else surface.mask_with(s, mask))


def backtest(points: DataFrame, grid: GridSpec, predictors: list[str], ranges: list[tuple[str, str]], coverages: list[int], mask: DataFrame | None = None) -> DataFrame:
    """(predictor, start, end, coverage, hits, total, rate) as one plan over all predictors and periods."""
    out = None
    for name in predictors:
        for start, end in ranges:
            hits = evaluate.hit_counts(predict(name, points, grid, start, mask), between(points, start, end), grid, coverages)
            rate = F.when(F.col("total") == 0, -1.0).otherwise(F.try_divide("hits", "total"))
            row = hits.select(F.lit(name).alias("predictor"), F.lit(start).alias("start"), F.lit(end).alias("end"), "coverage", "hits", "total", rate.alias("rate"))
            out = row if out is None else out.unionAll(row)
    return out


def naive_backtest(points: DataFrame, grid: GridSpec, ranges: list[tuple[str, str]], coverages: list[int]) -> DataFrame:
    """The count-grid back-test of all periods in one scan: counts by (period, cell) before and in each period."""
    spark = points.sparkSession
    r = spark.createDataFrame(ranges, "start string, end string").select("start", "end", F.col("start").cast("timestamp_ntz").alias("a"), F.col("end").cast("timestamp_ntz").alias("b"))
    cells = grid.with_cells(points).select("gx", "gy", "ts")
    # As many rows as there are periods are broadcast; counts leave a task once for each period and cell.
    seen = cells.join(F.broadcast(r), F.col("ts") < F.col("b")).groupBy("start", "end", "gx", "gy").agg(
        F.sum((F.col("ts") < F.col("a")).cast("long")).alias("risk"), F.sum((F.col("ts") >= F.col("a")).cast("long")).alias("count")
    )
    total = seen.groupBy("start").agg(F.sum("count").alias("total"))
    grid_cells = grid.cells(spark).join(F.broadcast(r.select("start", "end"))).join(seen.drop("end"), ["start", "gx", "gy"], "left").fillna(0, ["risk", "count"])
    w = W.partitionBy("start").orderBy(F.desc("risk"), F.desc("gy"), F.desc("gx"))
    ranked = grid_cells.select("*", F.row_number().over(w).alias("rank"))
    levels = ranked.select("*", F.explode(F.array(*map(F.lit, coverages))).alias("coverage"))
    inside = F.col("rank") <= F.floor(F.lit(grid.xextent * grid.yextent) * (F.col("coverage") / 100))
    hits = levels.groupBy("start", "end", "coverage").agg(F.sum(F.when(inside, F.col("count")).otherwise(0)).alias("hits"))
    return hits.join(total, "start", "left").fillna(0, ["total"])


def wide(results: DataFrame, value: str, coverages: list[int]) -> DataFrame:
    """One row for each predictor and period, a column for each coverage ("10%")."""
    out = results.groupBy("predictor", "start", "end", "total").pivot("coverage", coverages).agg(F.first(value))
    return out.withColumnsRenamed({str(c): f"{c}%" for c in coverages})


def write_hit_counts(results: DataFrame, path: str, coverages: list[int]) -> None:
    """CSV files: Predictor, Start time, End time, Number events, then the coverages."""
    names = {"predictor": "Predictor", "start": "Start time", "end": "End time", "total": "Number events"}
    wide(results, "hits", coverages).withColumnsRenamed(names).write.option("header", True).csv(path)


def write_hit_rates(results: DataFrame, path: str, coverages: list[int] | None = None) -> None:
    """CSV files: Predictor, Start time, End time, then the rates of the coverages (1 to 100 where they aren't given)."""
    names = {"predictor": "Predictor", "start": "Start time", "end": "End time"}
    wide(results, "rate", coverages or list(range(1, 101))).drop("total").withColumnsRenamed(names).write.option("header", True).csv(path)


def write_comparison(results: DataFrame, path: str, keys: list[str], score: str = "score") -> None:
    """CSV files: a column for each part of the prediction's and the comparison's keys, then Score."""
    results.select(*keys, F.col(score).alias("Score")).write.option("header", True).csv(path)


def read_hit_counts(spark: SparkSession, path: str, coverages: list[int]) -> DataFrame:
    """The long form of such files: predictor, start, end, coverage, hits, total."""
    rows = spark.read.option("header", True).csv(path)
    missing = {"Predictor", "Start time", "End time", "Number events"} - set(rows.columns)
    if missing:
        raise ValueError(f"not a file of hit counts: {sorted(missing)}")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("coverage"), F.col(f"`{c}%`").cast("long").alias("hits")) for c in coverages)))
    return rows.select(F.col("Predictor").alias("predictor"), F.col("Start time").alias("start"), F.col("End time").alias("end"), F.col("Number events").cast("long").alias("total"), pairs.alias("p")).select("predictor", "start", "end", "total", "p.*")
