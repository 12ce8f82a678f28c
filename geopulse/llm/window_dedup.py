"""Substring dedup of words: Rabin-Karp hashes of every window of a fixed number of words.

Windows that share their least q-gram are counted together in Spark (see ``repeats``), windows
that begin earlier elsewhere are repeated, and repeated windows merge into maximal removal
intervals. The first place of each word sequence (least doc_id, then the hash of doc_id and
text, then start) stays.

Defined results: a null text has no words; texts shorter than a window lose nothing; rows
without doc_id come before all others; rows that share a doc_id, or have none, are documents of
their own where their texts differ, and one document where their texts are equal too; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.repeats import removed_units, repeated_windows, runs, with_spans
from geopulse.llm.text import WordHash, hash_words, map_rows

WINDOW = 20
Q = 5
RESULT = "doc_id long, text binary, n_words long, n_removed long, intervals array<struct<start: long, end: long>>"


def word_units(cache: WordHash):
    return lambda text: hash_words((text or b"").split(), cache)


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, q: int = Q) -> DataFrame:
    """doc_id, the kept words joined by one space, n_words, n_removed, and the removed word intervals."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"), "doc_id")
    found = with_spans(keyed, spans=repeated_windows(keyed, word_units(WordHash()), window, q, (1,), first_only=True))

    def cut(rows):
        for _, text, doc_id, spans in rows:
            words = (text or b"").split()
            gone = removed_units(len(words), spans, window)
            kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x] if spans else words
            yield doc_id, b" ".join(kept), len(words), int(gone.sum()), [{"start": a, "end": b} for a, b in runs(gone)]

    return map_rows(found, cut, RESULT)


def op5_substring_dedup(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeated_windows(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
