"""Streaming counts of events by cell and time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.functions.grid import GridSpec


def windowed_cell_counts(points: DataFrame, grid: GridSpec, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, gx, gy, count) of a stream (ts, x, y); state of closed windows is dropped behind the watermark."""
    timed = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = grid.with_cells(timed).where(grid.inside()).groupBy(F.window("ts", window).alias("w"), "gx", "gy").agg(F.count("*").alias("count"))
    return counts.select(F.col("w.start").alias("start"), "gx", "gy", "count")
