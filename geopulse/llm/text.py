"""Helpers shared by the text operators.

Texts reach Python as UTF-8 bytes. ``bytes.split()`` without arguments splits at exactly
the six characters x20 and x09-x0D, so its parts are the words ``[^\\x20\\x09-\\x0D]+``;
``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import suppress
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
MULT = np.uint64(0x9E3779B97F4A7C15)
MULT2 = np.uint64(0xC2B2AE3D27D4EB4F)

Rows = Iterator[tuple]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; where it isn't set, one in the warehouse, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return folder


ROWS_PER_FILE = 50_000


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut the lineage by a table written to the shared folder and read again.

    A written table is smaller than a checkpoint of rows, and carries no claim on how it is partitioned.
    rows: about how many rows it has at most, so that small tables don't get a file for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // ROWS_PER_FILE))
    path = f"{shared_folder(spark)}/tables/{uuid4()}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete a table of ``checkpointed`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffles and broadcasts that nothing refers to any more.

    The cleaner acts on what the JVM has collected; between the rounds of a long operator this bounds both
    the disk and the driver's memory.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in bytes, so that long texts don't pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return what is freed to the machine: a Python worker serves many tasks one after the other, and what it holds counts beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Rows], schema: str, flush: int = 4096) -> DataFrame:
    """``mapInArrow`` for a generator over row tuples: fn(rows) yields output tuples."""
    bounded_batches(df.sparkSession)
    names, types = arrow_schema(df.sparkSession, schema)

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        out: list[tuple] = []
        size = 0
        for row in fn(rows()):
            out.append(row)
            size += sum(len(v) if isinstance(v, (bytes, str)) else 8 * len(v) if isinstance(v, (np.ndarray, list)) else 8 for v in row)
            if len(out) >= flush or size >= BATCH_BYTES:
                yield pack(out, names, types)
                out, size = [], 0
        if out:
            yield pack(out, names, types)
        out = []
        give_back()

    return df.mapInArrow(run, schema)


def struct_udf(spark: SparkSession, fn: Callable, schema: str) -> Callable:
    """An Arrow UDF of one binary column: fn(bytes or None) gives the tuple of the struct's fields."""
    bounded_batches(spark)
    names, types = arrow_schema(spark, schema)

    def run(texts: pa.Array) -> pa.Array:
        columns = zip(*map(fn, texts.to_pylist()), strict=True) if len(texts) else [[] for _ in names]
        found = pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)
        give_back()
        return found

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema)


def pack(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    """A record batch of row tuples."""
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def arrow_schema(spark: SparkSession, ddl: str) -> tuple[list[str], list[pa.DataType]]:
    """Names and Arrow types of a DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(ddl).fields
    return [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]


class WordHash(dict):
    """Cache of 64-bit word hashes, emptied when it gets large."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def hash_words(words: list[bytes], cache: WordHash) -> np.ndarray:
    """64-bit hashes of the words, in order."""
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(32))) * MULT
    h = (h ^ (h >> np.uint64(29))) * MULT2
    return h ^ (h >> np.uint64(32))


def rolling(h: np.ndarray, n: int, base: np.uint64 = MULT) -> np.ndarray:
    """Rabin-Karp hashes (modulo 2**64, then mixed) of every window of n values.

    Windows of powers of two are combined by doubling, then the window of n from them.
    """
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, done, cur, width = None, 0, h, 1
    with np.errstate(over="ignore"):
        power = int(base)
        left = n
        while left:
            if left & 1:
                out = cur if out is None else out[: len(cur) - done] * np.uint64(power) + cur[done:] if len(cur) > done else out[:0]
                done += width
            left >>= 1
            if left:
                cur = cur[:-width] * np.uint64(power) + cur[width:] if len(cur) > width else cur[:0]
                power = power * power & 0xFFFFFFFFFFFFFFFF
                width *= 2
        return mix(out[: len(h) - n + 1])


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return h.view(np.int64)


def doc_bytes(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, the text as UTF-8 bytes (null stays null), then further columns."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *extra)


assert sys.byteorder == "little"
