"""Written tables, and ranks and running sums over all rows without one task that holds them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


_scratches: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those that ``outlive`` it."""
    _scratches.append([])
    try:
        yield
    finally:
        for table in _scratches.pop():
            forget(table)


def outlive(*tables: DataFrame) -> None:
    """The tables stay when the innermost scratch ends, and go with the one around it, if there is any."""
    if _scratches:
        _scratches[-1] = [t for t in _scratches[-1] if all(t is not x for x in tables)]
        if len(_scratches) > 1:
            _scratches[-2].extend(tables)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by Parquet in the cluster's shared folder (below the warehouse where none is set, on one machine only)."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    path = f"{base}/written/{uuid4()}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    if _scratches:
        _scratches[-1].append(out)
    return out


def forget(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, order: list[Column | str], name: str, value: Column | str | None = None) -> DataFrame:
    """df with the running sum of value (of 1 where it is None: the rank from 1) over all rows in the order, which should be total.

    Rows are dealt by ranges of the order and written; sums run within a range, and the ranges' totals, one
    row for each, are summed for themselves.
    """
    value = F.lit(1) if value is None else F.col(value) if isinstance(value, str) else value
    parts = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_own"))
    before = totals.select("_part", (F.sum("_own").over(W.partitionBy().orderBy("_part")) - F.col("_own")).alias("_before"))
    run = parts.withColumn(name, F.sum(value).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    return run.join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
