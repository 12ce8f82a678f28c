"""Target-distribution importance resampling with hashed word runs.

Features are all runs of 1 to ``LONGEST`` consecutive words; a feature's bucket is the CRC of its
bytes modulo ``BUCKETS``. A vectorised byte automaton finds them in the Arrow buffer of a whole
batch of texts: a lookup table gives each byte's class (and its lower case), words begin and end
where the class differs from the byte before, and one table-driven CRC register for each word
start advances over the bytes of its run, all starts at once; at each word's end its register is
the CRC of the run so far. Words of more than ``STEPS`` bytes, which are few, are advanced one by
one by zlib from the register that they have.

The first scan adds up bucket counts of the documents and of the target texts (a row for each
bucket and task at most, added up by Spark), which give each bucket's gain; the second adds up the
gains of each document's features. Gumbel noise from a hash of the seed and the document's id turns
the highest scores into a draw without replacement with weights exp(weight / 1000). Ranks over all
rows run by ranges of the score (``functions.tables.running``), never in one task; what comes to
the driver and is broadcast has ``BUCKETS`` rows.

Defined results: a null text has no words; a document without words has weight 0; documents with
fewer than ``min_words`` words are never drawn, but counted and returned; a null doc_id hashes as an
empty one; repeated rows are documents of their own (of equal ones, either is drawn first); ties of
the score go to the smaller doc_id, nulls first; empty tables and empty targets are counted as 0;
further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.functions.tables import running
from geopulse.llm.text import arrow_schema, bounded_batches, checkpointed

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
STEPS = 48
SLICE = 1 << 20  # bytes of a batch that are worked off at once, where texts allow

SPACE = 0x20
FULL = np.uint32(0xFFFFFFFF)


def lower_table() -> np.ndarray:
    """Each byte in lower case (A-Z only), 0 where it is no part of a word: digits, letters and all bytes from 0x80 are."""
    byte = np.arange(256, dtype=np.uint8)
    low = np.where((byte >= 0x41) & (byte <= 0x5A), byte + 32, byte)
    word = ((low >= 0x30) & (low <= 0x39)) | ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    return np.where(word, low, 0).astype(np.uint8)


def crc_table() -> np.ndarray:
    """Steps of the reflected CRC-32 by the register's low byte."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> 1), step >> 1)
    return step.astype(np.uint32)


LOWER, CRC = lower_table(), crc_table()


def advance(register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    """The registers after one more byte each."""
    return CRC[(register ^ byte) & np.uint32(0xFF)] ^ (register >> np.uint32(8))


def over_words(register: np.ndarray, low: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The registers after the words low[begin : begin + length]; words in ascending order of length."""
    register = register.copy()
    first = np.searchsorted(length, np.arange(1, STEPS + 1))  # of the words that have a byte k
    for k in range(min(STEPS, int(length[-1]) if len(length) else 0)):
        live = slice(int(first[k]), None)
        register[live] = advance(register[live], low[begin[live] + k])
    for i in range(np.searchsorted(length, STEPS, side="right"), len(length)):
        rest = low[begin[i] + STEPS : begin[i] + length[i]].tobytes()
        register[i] = zlib.crc32(rest, int(register[i] ^ FULL)) ^ 0xFFFFFFFF
    return register


def word_runs(
    data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST, upto: int | None = None
) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each run length the texts' numbers and the buckets of all runs.

    Text i is data[offsets[i] : offsets[i + 1]]. Only words and runs that begin before ``upto`` count.
    """
    texts = len(offsets) - 1
    low = LOWER[data[offsets[0] : offsets[-1]]]
    upto = len(low) if upto is None else upto - offsets[0]
    offsets = offsets - offsets[0]
    word = low > 0
    # A word begins where the class changes or a text begins, and ends likewise.
    cut = np.zeros(len(low) + 1, bool)
    cut[offsets] = True
    begin = np.flatnonzero(word & (cut[:-1] | ~np.concatenate([[False], word[:-1]])))
    length = np.flatnonzero(word & (cut[1:] | ~np.concatenate([word[1:], [False]]))) + 1 - begin
    text = np.repeat(np.arange(texts), np.diff(np.searchsorted(begin, offsets)))
    own = int(np.searchsorted(begin, upto))
    register, found = np.full(len(begin), FULL), []
    for n in range(longest):
        # The runs that go on with word start + n of the same text.
        start = np.flatnonzero(text[n:][:own] == text[: max(len(text) - n, 0)][:own])
        state = advance(register[start], np.uint32(SPACE)) if n else register[start]
        order = np.argsort(length[start + n], kind="stable")
        after = np.empty(len(start), np.uint32)
        after[order] = over_words(state[order], low, begin[start + n][order], length[start + n][order])
        register[start] = after
        found.append((text[start], ((after ^ FULL) % np.uint32(buckets)).astype(np.int64)))
    return np.bincount(text[:own], minlength=texts), found


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8), offsets.astype(np.int64)


def word_end(data: np.ndarray, at: int, end: int, n: int) -> int:
    """Where the n-th word ends that ends after ``at``, or the text's end."""
    width = 4096
    while True:
        word = LOWER[data[at : min(at + width, end)]] > 0
        ends = np.flatnonzero(word[:-1] & ~word[1:])
        if len(ends) >= n:
            return at + int(ends[n - 1]) + 1
        if at + width >= end:
            return end
        width *= 4


def slices(data: np.ndarray, offsets: np.ndarray, longest: int = LONGEST):
    """(first text, offsets, end of the runs' beginnings) of stretches of about SLICE bytes.

    Longer texts come in parts that end with a word, each with the words after it that its last runs need.
    """
    i = 0
    while i < len(offsets) - 1:
        k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        at, end = int(offsets[i]), int(offsets[k])
        if k > i + 1 or end - at <= 2 * SLICE:
            yield i, offsets[i : k + 1], end
        else:
            while at < end:
                upto = word_end(data, at + SLICE, end, 1) if end - at > 2 * SLICE else end
                yield i, np.array([at, word_end(data, upto, end, longest - 1) if longest > 1 else upto]), upto
                at = upto
        i = k


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n) of all features of the column ``text``."""
    bounded_batches(texts.sparkSession)
    schema = "bucket long, n long"
    names, types = arrow_schema(texts.sparkSession, schema)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = buffers(batch.column(0))
            for _, part, upto in slices(data, offsets, longest):
                for _, bucket in word_runs(data, part, buckets, longest, upto)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, types[0]), pa.array(total[at], types[1])], names)

    found = texts.select(F.col("text").cast("string")).mapInArrow(run, schema)
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Gain of each bucket in thousandths of a nat, floors with 1 added to each count."""
    both = [np.zeros(buckets, np.float64), np.zeros(buckets, np.float64)]
    for counts, texts in zip(both, (docs, target), strict=True):
        for row in bucket_counts(texts, buckets, longest).collect():
            counts[row.bucket] = row.n
    s, t = both
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(gain)
    field = docs.schema["doc_id"]
    schema = f"doc_id {field.dataType.simpleString()}, n_words long, n_features long, weight long"

    def run(batches):
        for batch in batches:
            ids, texts = batch.columns
            data, offsets = buffers(texts)
            out = [np.zeros(len(ids), np.int64) for _ in range(3)]
            for first, part, upto in slices(data, offsets, longest):
                n, at = len(part) - 1, slice(first, first + len(part) - 1)
                words, runs = word_runs(data, part, buckets, longest, upto)
                out[0][at] += words
                for text, bucket in runs:
                    out[1][at] += np.bincount(text, minlength=n)
                    # Sums of doubles are exact here: far below 2 ** 53.
                    out[2][at] += np.bincount(text, weights=shared.value[bucket], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, longest: int = LONGEST
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null where not drawn) of each row of docs."""
    scored = weighted(docs, gains(docs, target, buckets, longest), buckets, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    # Written once, as ranges are sampled first; some 40 bytes a row.
    rows = checkpointed(scored.withColumn("able", F.col("n_words") >= min_words))
    # Those that can be drawn come first, so their running numbers are the ranks.
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_first("doc_id"), F.col("n_features"), F.col("weight")]
    drawn = rows.agg(F.floor(F.count_if("able") * percent / 100).alias("n")).scalar()
    place = F.when(F.col("able") & (F.col("place") <= drawn), F.col("place"))
    return running(rows, order, "place").select("doc_id", "n_words", "n_features", "weight", "score", place.alias("rank"))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; docs must have unique ids."""
    drawn = resampled(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_id"))
    return docs.join(drawn, docs.doc_id.eqNullSafe(drawn["_id"]), "left_semi")


def op13_importance(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest: doc_id, n_features, weight, score, rank."""
    return resampled(docs, benchmark.select("text")).select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
