"""Suffix dedup of bytes: bucket-pointer refinement of window starts.

All 400-byte strings that occur twice are removed, at all their places. Suffixes are not
sorted one by one: starts whose window has the same least q-gram are one bucket, and a bucket
is refined by the identifiers of what follows at later offsets - first of the whole group, then
of parts of ``STEPS`` starts, then of single starts; starts that are alone in their bucket, or
already known to be repeated, are not refined further (see ``repeats``).

The buckets grow in two rounds: first for strings of ``SHORT`` bytes, then for those of
``WINDOW`` bytes. The second round takes up the first one's results: a start goes on only if the
short strings at all later offsets within the window are in buckets with others. A bucket's
identifier at one offset is reused for every longer string that holds it, as all are differences
of the same prefix sums. What the first round finds is returned too, as ``n_repeated``.

Defined results: a null text is empty; texts shorter than a window lose nothing; rows without
doc_id are judged like others; a row that occurs twice is repeated (its strings occur elsewhere);
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.repeats import mix, removed_units, repeated_windows, runs, with_spans
from geopulse.llm.text import map_rows

WINDOW = 400
SHORT = 160
Q = 32
STEPS = (16, 1)
RESULT = "doc_id long, text binary, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, n_repeated long"


def byte_units():
    values = mix(np.arange(1, 257, dtype=np.uint64) << np.uint64(20))
    return lambda text: values[np.frombuffer(text or b"", np.uint8)]


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, short: int = SHORT, q: int = Q, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """doc_id, the bytes that are left, n_bytes, n_removed, the removed spans, and how many bytes repeated short strings cover."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"), "doc_id")
    shorter = repeated_windows(keyed, byte_units(), short, q, steps, first_only=False)
    longer = repeated_windows(keyed, byte_units(), window, q, steps, first_only=False, shorter=(shorter, short))

    def cut(rows):
        for _, text, doc_id, shorts, spans in rows:
            text = text or b""
            gone = removed_units(len(text), spans, window)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if spans else text
            repeated = int(removed_units(len(text), shorts, short).sum()) if shorts else 0
            yield doc_id, kept, len(text), int(gone.sum()), [{"start": a, "end": b} for a, b in runs(gone)], repeated

    return map_rows(with_spans(keyed, shorts=shorter, spans=longer), cut, RESULT)


def op7_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated."""
    return remove_repeated_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), "n_repeated"
    )
