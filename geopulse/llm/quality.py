"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text gets a few integer measures (permille). Per language and source, a log-linear
histogram of each measure is kept: values below 64 have a bucket of their own, larger ones
share buckets of 1/32 relative width. Such a histogram is a quantile sketch that merges by
adding counts, so it is an ordinary partial aggregation: one row for each (language, source,
measure, bucket) leaves a task, however large a group is, and the result does not depend on
the order of merging. Groups with few rows use the merged sketch of their language, and then
that of the whole corpus. A text is rejected if a measure lies above the fence
``q50 + spread * (q75 - q50) + slack`` of its group. For the digest, texts are measured once;
sketches and verdicts read the written measures.

Defined results: a null text has no words (and fails the base rule); null languages and
sources form groups of their own; repeated rows count as often as they occur; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.llm.text import checkpointed, struct_udf

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Measure: slack above the median, in permille; below it no value is an outlier.
MEASURES = {"symbol_pm": 60, "punct_pm": 150, "upper_pm": 300, "dup_line_pm": 500, "repeat_pm": 300}
SPREAD = 6
MIN_ROWS = 100

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long,"
    " n_punct long, n_upper long"
)


def text_stats(text: bytes | None) -> tuple[int, int, int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_punct, n_upper."""
    text = text or b""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    punct = len(text) - len(text.translate(None, PUNCTUATION))
    upper = len(text) - len(text.translate(None, UPPER))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
        _, window, count = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        often = np.zeros(n + 2, bool)
        often[2:n] = count[window] > 1
        repeated = int((often[2:] | often[1:-1] | often[:-2]).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), punct, upper


def measured(docs: DataFrame) -> DataFrame:
    """The rows as a struct ``row``, their counts, and the measures in permille."""
    stats = struct_udf(docs.sparkSession, text_stats, STATS)
    pm = lambda a, b: F.expr(f"{a} * 1000 div greatest({b}, 1)")
    return (
        docs.select(F.struct("*").alias("row"), "lang", "source", stats(F.col("text").cast("binary")).alias("s"))
        .select("row", "lang", "source", "s.*")
        .select(
            "*",
            pm("n_symbols", "word_chars").alias("symbol_pm"),
            pm("n_punct", "word_chars").alias("punct_pm"),
            pm("n_upper", "word_chars").alias("upper_pm"),
            pm("n_dup_lines", "n_lines").alias("dup_line_pm"),
            pm("n_repeat_words", "n_words").alias("repeat_pm"),
            F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
        )
    )


def bucket(v: Column) -> Column:
    """Bucket of a value of at least 0: exact below 64, then 32 buckets for each power of two."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return e.cast("long") * 64 + F.call_function("shiftright", v, e)


def bucket_top(b: Column) -> Column:
    """The largest value of a bucket."""
    e = F.floor(b / 64).cast("int")
    return F.call_function("shiftleft", (b - F.floor(b / 64) * 64).cast("long") + 1, e) - 1


def sketches(stats: DataFrame, measures: list[str], keys: list[str]) -> DataFrame:
    """The mergeable histogram: keys, measure, bucket, n."""
    # One array of structs for each row, exploded and added up within the task before any shuffle.
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in measures)))
    return stats.select(*keys, each.alias("m")).groupBy(*keys, "m.measure", "m.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles of each group: keys, measure, rows and a column for each of ``probs``.

    A quantile is the top of the first bucket whose running count reaches it; the number of
    buckets of a group is bounded by the values' number of bits, not by its rows.
    """
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    by = [*keys, "measure"]
    run = merged.select(
        "*", F.sum("n").over(W.partitionBy(*by).orderBy("bucket")).alias("upto"), F.sum("n").over(W.partitionBy(*by)).alias("rows")
    )
    first = {k: F.min(F.when(F.col("upto") * 1000 >= F.col("rows") * round(1000 * p), F.col("bucket"))) for k, p in probs.items()}
    return run.groupBy(*by).agg(F.max("rows").alias("rows"), *(bucket_top(v).alias(k) for k, v in first.items()))


def adaptive_thresholds(
    stats: DataFrame, measures: dict[str, int] = MEASURES, spread: int = SPREAD, min_rows: int = MIN_ROWS
) -> DataFrame:
    """One row for each (lang, source): the fence of every measure."""
    sketch = sketches(stats, list(measures), ["lang", "source"])
    probs = {"q50": 0.5, "q75": 0.75}
    levels = [quantiles(sketch, keys, probs) for keys in (["lang", "source"], ["lang"], [])]
    fence = F.col("q50") + spread * (F.col("q75") - F.col("q50"))
    own, lang, corpus = (x.select(*[c for c in ("lang", "source") if c in x.columns], "measure", "rows", fence.alias("fence")) for x in levels)
    joined = (
        own.alias("a")
        .join(lang.alias("b"), F.expr("a.lang <=> b.lang and a.measure = b.measure"), "left")
        .join(corpus.alias("c"), F.expr("a.measure = c.measure"), "left")
        .select(
            "a.lang", "a.source", "a.measure",
            F.when(F.col("a.rows") >= min_rows, F.col("a.fence")).when(F.col("b.rows") >= min_rows, F.col("b.fence")).otherwise(F.col("c.fence")).alias("fence"),
        )
    )
    return joined.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("measure") == m, F.col("fence") + slack)).alias(f"max_{m}") for m, slack in measures.items())
    )


def verdicts(stats: DataFrame, measures: dict[str, int] = MEASURES, spread: int = SPREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """The measured texts with the fences of their group and ``kept``."""
    fences = adaptive_thresholds(stats, measures, spread, min_rows).withColumnsRenamed({"lang": "g_lang", "source": "g_source"})
    within = reduce(lambda a, b: a & b, (F.col(m) <= F.coalesce(F.col(f"max_{m}"), F.lit(2**62)) for m in measures))
    # The fences are one row for each group: Spark broadcasts them if they are small and splits a hot group otherwise.
    joined = stats.join(fences, F.expr("lang <=> g_lang and source <=> g_source"), "left").drop("g_lang", "g_source")
    return joined.select("*", (~F.col("base_failed") & within).alias("kept"))


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The documents that pass, with all their own columns and no others. Texts are measured twice rather than written once more."""
    return verdicts(measured(docs), **options).where("kept").select("row.*")


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, counts, base_failed, kept, then the measures and the fences."""
    stats = measured(docs.select("doc_id", "lang", "source", "text")).withColumn("row", F.struct("row.doc_id"))
    return verdicts(checkpointed(stats)).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *MEASURES, *(f"max_{m}" for m in MEASURES),
    )
