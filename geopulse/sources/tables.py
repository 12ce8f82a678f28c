"""Readers of event files; malformed rows are counted, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.functions.tables import running

# Column names (type, x, y, time) of the known layouts, and their time formats.
LAYOUTS = {
    "snapshot": (" PRIMARY DESCRIPTION", "X COORDINATE", "Y COORDINATE", "DATE  OF OCCURRENCE"),
    "all": ("Primary Type", "X Coordinate", "Y Coordinate", "Date"),
    "gen": ("CRIME", "X", "Y", "TIMESTAMP"),
}
LAYOUTS["all_other"] = LAYOUTS["all"]
TIMES = {"snapshot": "M/d/yyyy h:m:s a", "all": "M/d/yyyy h:m:s a", "gen": "M/d/yyyy h:m:s a", "all_other": "M/d/yy H:m"}
FEET_TO_METRES = 1200 / 3937  # US survey feet


def csv_events(spark: SparkSession, path: str, types: set[str], layout: str = "snapshot", metres: bool = True) -> DataFrame:
    """(ts, x, y, category) of a CSV in one of the layouts; rows without a place are left out, and a time that can't be read is an error."""
    rows = spark.read.option("header", True).csv(path)
    kind, x, y, t = LAYOUTS[layout]
    missing = {kind, x, y, t} - set(rows.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    scale = FEET_TO_METRES if metres else 1.0
    place = lambda c: F.col(f"`{c}`").try_cast("double") * scale
    stamp = F.try_to_timestamp(F.col(f"`{t}`"), F.lit(TIMES[layout])).cast("timestamp_ntz")
    stamp = F.coalesce(stamp, F.raise_error(F.concat(F.lit("unreadable time: "), F.coalesce(F.col(f"`{t}`"), F.lit("none")))).cast("timestamp_ntz"))
    out = rows.select(stamp.alias("ts"), place(x).alias("x"), place(y).alias("y"), F.trim(F.col(f"`{kind}`")).alias("category"))
    return out.where(F.col("category").isin(list(types)) & F.col("x").isNotNull() & F.col("y").isNotNull())


def monthly_csv(spark: SparkSession, path: str, types: set[str]) -> DataFrame:
    """(ts, x, y, category) of a CSV of months and degrees; no types means all of them."""
    rows = spark.read.option("header", True).csv(path)
    out = rows.select(F.try_to_timestamp("Month", F.lit("yyyy-MM")).cast("timestamp_ntz").alias("ts"), F.col("Longitude").try_cast("double").alias("x"), F.col("Latitude").try_cast("double").alias("y"), F.col("`Crime type`").alias("category"))
    return (out.where(F.col("category").isin(list(types))) if types else out).where("x is not null and y is not null")


def configured_csv(spark: SparkSession, path: str, time: int, x: int, y: int, time_format: str | None = None, scale: float = 1.0, types: tuple[int, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(events, problems) of a CSV by column numbers: problems counts the rows that are empty or can't be read, by kind."""
    rows = spark.read.option("header", True).csv(path)
    col = lambda i: F.col(f"`{rows.columns[i]}`")
    stamp: Column = F.try_to_timestamp(col(time), F.lit(time_format)) if time_format else F.try_to_timestamp(col(time))
    out = rows.select(
        stamp.cast("timestamp_ntz").alias("ts"), (col(x).try_cast("double") * scale).alias("x"), (col(y).try_cast("double") * scale).alias("y"),
        *(col(i).alias(f"type{k + 1}") for k, i in enumerate(types)),
        (F.coalesce(F.trim(col(time)), F.lit("")) == "").alias("no_time"), ((F.coalesce(F.trim(col(x)), F.lit("")) == "") | (F.coalesce(F.trim(col(y)), F.lit("")) == "")).alias("no_place"),
    )
    bad = F.when(F.col("no_time") | F.col("no_place"), "empty").when(F.col("ts").isNull() | F.col("x").isNull() | F.col("y").isNull(), "unreadable")
    problems = out.withColumn("problem", bad).where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))
    return out.where(bad.isNull()).drop("no_time", "no_place"), problems


def scan_files(spark: SparkSession, stem: str, time_end: float) -> DataFrame:
    """(id, x, y, age): the events of ``stem``.geo (id x y) and ``stem``.cas (id count t), each as often as its count."""
    parts = lambda p: F.split(F.trim("value"), r"\s+")
    geo = spark.read.text(f"{stem}.geo").where(F.trim("value") != "").select(parts("g").alias("p")).select(F.col("p")[0].alias("id"), F.col("p")[1].cast("double").alias("x"), F.col("p")[2].cast("double").alias("y"))
    cas = spark.read.text(f"{stem}.cas").where(F.trim("value") != "").select(parts("c").alias("p")).select(F.col("p")[0].alias("id"), F.col("p")[1].cast("int").alias("n"), F.col("p")[2].cast("double").alias("t"))
    each = cas.select("id", "t", F.explode(F.sequence(F.lit(1), "n")).alias("k"))
    return each.join(geo, "id").select("id", "x", "y", (time_end - F.col("t")).alias("age"))


def write_scan_files(points: DataFrame, stem: str) -> None:
    """Such files of (x, y, t): places numbered from 1 in order, and counts for each place and time."""
    places = running(points.select("x", "y").distinct(), ["x", "y"], "id")
    places.select(F.concat_ws(" ", "id", "x", "y").alias("value")).write.text(f"{stem}.geo")
    counts = points.join(places, ["x", "y"]).groupBy("id", "t").agg(F.count("*").alias("n"))
    counts.select(F.concat_ws(" ", "id", "n", "t").alias("value")).write.text(f"{stem}.cas")


def geojson_features(events: DataFrame) -> DataFrame:
    """One GeoJSON feature for each event, geometry null without a place."""
    point = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("category", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")).alias("properties"), point.alias("geometry"))
    return events.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))
