"""The point table (event_id, ts, x, y, category): filters, time arithmetic, projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as points."""
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        "ts",
        (F.col("value") * 10).alias("x"),
        (k * 30.0 + F.col("user_id") % 30).alias("y"),
        F.col("event_type").alias("category"),
    )


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def events_before(points: DataFrame, cutoff: str | None) -> DataFrame:
    """Up to and at the cutoff; all if it is None."""
    return points if cutoff is None else points.where(F.col("ts") <= F.lit(cutoff).cast("timestamp_ntz"))


def between(points: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """start <= ts < end."""
    if start is not None:
        points = points.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return points if end is None else points.where(F.col("ts") < F.lit(end).cast("timestamp_ntz"))


def training(points: DataFrame, start: str, end: str, types: list[str]) -> DataFrame:
    """start <= ts <= end and one of the types."""
    t = F.col("ts")
    return points.where((t >= F.lit(start).cast("timestamp_ntz")) & (t <= F.lit(end).cast("timestamp_ntz")) & F.col("category").isin(types))


def assessment(points: DataFrame, start: str, end: str, types: list[str]) -> DataFrame:
    """start < ts <= end and one of the types."""
    return training(points, start, end, types).where(F.col("ts") > F.lit(start).cast("timestamp_ntz"))


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"),
    )


def time_deltas(points: DataFrame, unit_micros: int = 60_000_000) -> DataFrame:
    """(event_id, t, x, y): t is the time since the first event in units."""
    first = points.agg(F.min(micros("ts")).alias("t0"))
    return points.join(F.broadcast(first)).select("event_id", ((micros("ts") - F.col("t0")) / unit_micros).alias("t"), "x", "y")


def bin_timestamps(points: DataFrame, offset: str, length_micros: int) -> DataFrame:
    """ts moved down to its bin's start; bins go from the offset in both directions."""
    start = micros(F.lit(offset).cast("timestamp_ntz"))
    binned = start + F.floor((micros("ts") - start) / length_micros) * length_micros
    return points.withColumn("ts", F.timestamp_micros(binned).cast("timestamp_ntz"))


def counts_by_type(points: DataFrame) -> DataFrame:
    """category, n and its code in the sorted order of types."""
    counts = points.groupBy("category").agg(F.count("*").alias("n"))
    earlier = counts.select(F.col("category").alias("other"))
    # As many rows as there are types.
    return counts.join(F.broadcast(earlier), earlier.other < counts.category, "left").groupBy("category", "n").agg(F.count("other").alias("code"))


def split_counts(points: DataFrame, train_start: str, train_end: str, assess_start: str, assess_end: str) -> DataFrame:
    """One row: the points of the training time, both ends included, and of the assessed time, without its begin."""
    at = lambda t: F.lit(t).cast("timestamp_ntz")
    train = F.col("ts").between(at(train_start), at(train_end))
    assess = (F.col("ts") > at(assess_start)) & (F.col("ts") <= at(assess_end))
    return points.agg(F.count_if(train).alias("train_count"), F.count_if(assess).alias("assess_count"))


def default_split(points: DataFrame) -> DataFrame:
    """start, middle and end of a default train/assess split: to the minute, at most a year of training."""
    minute = F.lit(60_000_000)
    down = lambda c: F.floor(c / minute) * minute
    ends = points.agg(F.min(micros("ts")).alias("a"), F.max(micros("ts")).alias("b")).select(down(F.col("a")).alias("a"), down(F.col("b")).alias("b"))
    middle = F.least(down((F.col("a") + F.col("b")) / 2), F.col("a") + 365 * 86_400_000_000)
    stamp = lambda c: F.timestamp_micros(c.cast("long")).cast("timestamp_ntz")
    return ends.select(stamp(F.col("a")).alias("train_start"), stamp(middle).alias("train_end"), stamp(F.col("b")).alias("assess_end"))


def project_lonlat(points: DataFrame) -> DataFrame:
    """Degrees to metres by the series of the mean latitude."""
    mean = points.agg((F.avg("y") * (math.pi / 180)).alias("phi"))
    joined = points.join(F.broadcast(mean))
    phi = F.col("phi")
    return joined.select(
        "event_id",
        "ts",
        (F.col("x") * (111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi))).alias("x"),
        (F.col("y") * (111132.92 - 559.82 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi))).alias("y"),
    )


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def translate(points: DataFrame, dx: float, dy: float) -> DataFrame:
    return points.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
