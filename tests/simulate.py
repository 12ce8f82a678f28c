"""Simulated point processes; every draw is a hash of its row number and the seed, so a run can be repeated."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) of the keys."""
    return F.xxhash64(*keys, F.lit(seed)) / F.lit(2.0**64) + 0.5


def random_uniform(spark: SparkSession, region: tuple[float, float, float, float], start: str, seconds: float, n: int, seed: int = 0) -> DataFrame:
    """(event_id, ts, x, y): n events, uniform in the region and the time."""
    xmin, ymin, xmax, ymax = region
    t = F.unix_micros(F.lit(start).cast("timestamp_ntz").cast("timestamp")) + (uniform(seed, "id") * seconds * 1_000_000).cast("long")
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        F.timestamp_micros(t).cast("timestamp_ntz").alias("ts"),
        (xmin + uniform(seed + 1, "id") * (xmax - xmin)).alias("x"),
        (ymin + uniform(seed + 2, "id") * (ymax - ymin)).alias("y"),
    )


def thin(candidates: DataFrame, intensity: Column, most: float, seed: int = 0) -> DataFrame:
    """Rejection: each candidate stays with probability intensity / most."""
    return candidates.where(uniform(seed + 3, "event_id") * most < intensity)


def normal_offsets(rows: DataFrame, sd: float, seed: int, *keys: str) -> DataFrame:
    """x and y moved by normal draws."""
    r = F.sqrt(-2 * F.ln(1 - uniform(seed, *keys))) * sd
    a = uniform(seed + 1, *keys) * (2 * math.pi)
    return rows.withColumns({"x": F.col("x") + r * F.cos(a), "y": F.col("y") + r * F.sin(a)})


def self_exciting(background: DataFrame, theta: float, omega: float, sd: float, seconds: float, generations: int = 20, seed: int = 0) -> DataFrame:
    """(event_id, t, x, y, generation): background(event_id, t, x, y) with geometric numbers of children of mean theta, exponential
    delays of rate omega and normal offsets; children after ``seconds`` are left out."""
    out = level = background.select("event_id", "t", "x", "y", F.lit(0).alias("generation"))
    q = theta / (1 + theta)
    for g in range(1, generations + 1):
        n = F.floor(F.ln(1 - uniform(seed + 7 * g, "event_id")) / math.log(q)).cast("int")
        children = level.where(n > 0).select("*", F.explode(F.sequence(F.lit(1), n)).alias("k"))
        delay = -F.ln(1 - uniform(seed + 7 * g + 1, "event_id", "k")) / omega
        children = normal_offsets(children, sd, seed + 7 * g + 2, "event_id", "k")
        level = children.select(F.xxhash64("event_id", "k", F.lit(g)).alias("event_id"), (F.col("t") + delay).alias("t"), "x", "y", F.lit(g).alias("generation")).where(F.col("t") < seconds)
        out = out.unionAll(level)
    return out
