"""Semi-join reduction by a bitmap of bounded size.

A table is cut down to the rows whose key may be in a set, before it is joined with it. The
bitmap has some ``SLOTS_PER_KEY`` bits for each key and ``MAX_BITS`` at most, so its size is
bounded whatever the data; where the set is so large that most bits are set, fewer rows are
left out, and the join that follows still gives the same result. The bitmap is the value of a
scalar subquery, so it stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS_PER_KEY = 16
MAX_BITS = 25  # 4 MB


def maybe_in(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of df whose column may be among the values of the only column of keys."""
    return df.where(membership(keys)(F.col(column)))


def membership(keys: DataFrame) -> Callable[[Column], Column]:
    """The test whether a column may be among the values of the only column of keys, which should be a written table."""
    bits = min(MAX_BITS, max(16, (SLOTS_PER_KEY * keys.count()).bit_length()))
    slot = lambda key: F.xxhash64(key).bitwiseAND((1 << bits) - 1)
    mask = F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))")
    words = keys.select(slot(F.col(keys.columns[0])).alias("s")).groupBy(F.shiftright("s", 6).alias("word")).agg(mask.alias("bits"))
    blank = keys.sparkSession.range(1 << (bits - 6), numPartitions=1).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    dense = words.unionAll(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = dense.agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("bitmap")).scalar()

    def test(key: Column) -> Column:
        s = slot(key)
        at = F.get(bitmap, F.shiftright(s, 6).cast("int"))
        return F.call_function("shiftright", at, s.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return test
