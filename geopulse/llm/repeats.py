"""Repeated windows of a fixed length, found by refining buckets in Spark.

A text is a sequence of 64-bit unit values (of words or bytes). Hashes of any slice come from
prefix sums of a Rabin-Karp polynomial modulo 2**64. Windows are treated in groups of
consecutive starts, each under a bucket that equal windows must share:

* first, the windows whose least q-gram is the same occurrence, under that q-gram's hash;
* then parts of a group, of ``step`` starts aligned to that q-gram, under the hash of what all
  windows of the part have in common;
* at last single windows, under their own hash.

A group whose whole slice occurs again is decided at once; a group with another one in its
bucket is left open, and only open groups go on to the next step. A task sends each slice
once, however often it met it, so a passage in a third of all documents makes a row for each
task and not for each document.

Positions are kept in one long: start * 2**24 + number of starts * 2**12 + (q-gram - start).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.llm.reduction import maybe_in, membership
from geopulse.llm.text import MULT, bounded_batches, checkpointed, drop_table, mix, release, signed

SEGMENT = 1 << 19
FLUSH = 1 << 20
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))
OTHER = np.uint64(0xA0761D6478BD642F)
ROWS = "b long, f long, doc long, pos long, n long"
ORDERED_ROWS = f"{ROWS}, id long"
NULL_DOC = -(2**63)


POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT ** i and MULT ** -i modulo 2**64 for i up to n, kept for each power of two n."""
    if n not in POWERS:
        with np.errstate(over="ignore"):
            POWERS[n] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)]), dtype=np.uint64) for x in (MULT, INVERSE))
    return POWERS[n]


class Slices:
    """Hashes of slices of a sequence of units."""

    def __init__(self, units: np.ndarray):
        self.n = len(units)
        size = 1 << max(10, self.n.bit_length())
        self.up, down = powers(size)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(units * down[1 : self.n + 1], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.up[end]

    def grams(self, q: int) -> np.ndarray:
        """Hashes of all q-grams."""
        return mix((self.sums[q:] - self.sums[:-q]) * self.up[q : self.n + 1])


def least_positions(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the least gram (the first of equals) in each run of ``width``: minima from both sides of blocks."""
    n = len(grams)
    low = np.uint64((1 << 20) - 1)
    key = (grams & ~low) | np.arange(n, dtype=np.uint64)
    full = -(-n // width) * width
    padded = np.full(full, np.uint64(2**64 - 1))
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[: n - width + 1], before[width - 1 : n])
    return (least & low).astype(np.int64)


def segments(units: np.ndarray, window: int):
    """(offset, slices) of stretches with bounded memory that hold each window once."""
    for offset in range(0, max(1, len(units) - window + 1), SEGMENT):
        yield offset, Slices(units[offset : offset + SEGMENT + window - 1])


def packed(start: np.ndarray, count: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (start << 24) | (count << 12) | at


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 24, (pos >> 12) & 4095, pos & 4095


def first_groups(units: np.ndarray, window: int, q: int, allowed: np.ndarray | None = None):
    """(b, f, pos) of the groups of all windows, or of those with allowed starts."""
    if len(units) < window or allowed is not None and not allowed.any():
        return
    for offset, s in segments(units, window):
        grams = s.grams(q)
        at = least_positions(grams, window - q + 1)
        if allowed is None:
            change = np.flatnonzero(np.diff(at)) + 1
            lo = np.concatenate([[0], change])
            hi = np.concatenate([change, [len(at)]]) - 1
        else:
            group = np.where(allowed[offset : offset + len(at)], at, -1)
            change = np.flatnonzero(np.diff(group)) + 1
            lo = np.concatenate([[0], change])
            hi = np.concatenate([change, [len(at)]]) - 1
            lo, hi = lo[group[lo] >= 0], hi[group[lo] >= 0]
        yield signed(grams[at[lo]]), signed(mix(s.raw(lo, hi + window))), packed(lo + offset, hi - lo + 1, at[lo] - lo)


def refined_groups(units: np.ndarray, window: int, step: int, pos: np.ndarray):
    """(b, f, pos) of the parts of open groups."""
    start, count, at = unpacked(pos)
    inside = start + count - 1 + window <= len(units)  # of another row, if hashes are equal
    start, count, at = start[inside], count[inside], at[inside]
    for offset, s in segments(units, window):
        own = (start >= offset) & (start < offset + SEGMENT)
        lo = start[own] - offset
        hi, anchor = lo + count[own] - 1, lo + at[own]
        # Parts begin at anchor - k * step; those that meet lo..hi.
        high, low = (anchor - lo + step - 1) // step, (anchor - hi + step - 1) // step
        n = high - low + 1
        if not n.sum():
            continue
        each = np.repeat(np.arange(len(n)), n)
        k = high[each] - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        r = anchor[each] - k * step
        a, z = np.maximum(r, lo[each]), np.minimum(r + step - 1, hi[each])
        real = a <= z
        r, a, z, each = r[real], a[real], z[real], each[real]
        yield signed(mix(s.raw(r + step - 1, r + window))), signed(mix(s.raw(a, z + window) ^ OTHER)), packed(a + offset, z - a + 1, np.clip(anchor[each] - a, 0, 4095))


def once_per_task(found, first_only: bool):
    """Record batches of ROWS (with id if first_only) of (doc, id), (b, f, pos), each slice of a stretch of rows once.

    n: rows of the slice (1, or 2 for more); 0 for those that are decided: not the first, and so repeated.
    """
    docs, parts, size = [], [], 0

    def flush():
        of = np.repeat(np.arange(len(docs)), [len(x[0]) for x in parts])
        doc, row = (np.array(x, np.int64)[of] for x in zip(*docs, strict=True))
        b, f, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, doc, row, f, b))
        b, f, pos, doc, row = b[order], f[order], pos[order], doc[order], row[order]
        new = np.ones(len(b), bool)
        new[1:] = (b[1:] != b[:-1]) | (f[1:] != f[:-1])
        head = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        n = np.where(new, np.minimum(np.diff(np.append(head, len(b))), 2)[of], 0)
        if first_only:
            # A row at the first one's very place is another copy of the same document row.
            same = ~new & (doc == doc[head][of]) & (pos == pos[head][of])
            n = np.where(same, 1, np.minimum(n, 1))
        b = np.where(n == 0, signed(mix(doc.view(np.uint64) + pos.view(np.uint64))), b)
        columns = {"b": b, "f": f, "doc": doc, "pos": pos, "n": n} | ({"id": row} if first_only else {})
        for i in range(0, len(b), 1 << 17):
            cut = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(x[cut].astype(np.int64)) for x in columns.values()], list(columns))

    for doc, (b, f, pos) in found:
        docs.append(doc)
        parts.append((b, f, pos))
        size += len(b)
        if size >= FLUSH:
            yield from flush()
            docs, parts, size = [], [], 0
    if size:
        yield from flush()


def decided(rows: DataFrame, first_only: bool) -> DataFrame:
    """doc, pos, removed, open: the rows that are repeated, and those that share a bucket with others.

    first_only: the first place of a slice (least id, then doc, then start) isn't removed. A bucket may hold very many
    slices, so what is known of buckets comes from an aggregate with partial sums; buckets of one row go before any
    row is shuffled.
    """
    rows = checkpointed(rows)
    buckets = rows.where("n > 0").groupBy("b").agg(F.min("f").alias("least"), F.max("f").alias("most"), F.sum("n").alias("n"))
    shared = checkpointed(buckets.where("least <> most or n > 1").select(F.col("b").alias("bucket"), F.expr("least <> most").alias("mixed")))
    some = maybe_in(rows.where("n > 0"), "b", shared.select("bucket"))
    # Not more rows of a slice come here than tasks have sent.
    by_slice = W.partitionBy("b", "f")
    seen = some.select(
        "b", "doc", "pos",
        F.rank().over(by_slice.orderBy(*(["id"] if first_only else []), "doc", "pos")).alias("rank"),
        F.sum("n").over(by_slice).alias("times"),
    )
    again = F.expr("rank > 1" if first_only else "times > 1")
    seen = seen.join(shared, F.expr("b = bucket")).select("doc", "pos", again.alias("removed"), F.expr("rank = 1 and mixed").alias("open")).where("removed or open")
    out = checkpointed(seen.unionAll(rows.where("n = 0").select("doc", "pos", F.lit(True).alias("removed"), F.lit(False).alias("open"))))
    drop_table(rows)
    drop_table(shared)
    return out


def repeated_starts(units_n: int, spans: list[int], window: int) -> np.ndarray:
    """Which starts of windows the spans name."""
    edge = np.zeros(max(0, units_n - window + 1) + 1, np.int64)
    start, count, _ = unpacked(np.array(spans, np.int64))
    inside = start + count <= len(edge) - 1
    np.add.at(edge, start[inside], 1)
    np.add.at(edge, (start + count)[inside], -1)
    return np.cumsum(edge[:-1]) > 0


def longer_starts(units_n: int, spans: list[int], shorter: int, window: int) -> np.ndarray:
    """Starts of windows all of whose shorter windows are repeated: only those can be repeated themselves."""
    alone = np.concatenate([[0], np.cumsum(~repeated_starts(units_n, spans, shorter))])
    n = units_n - window + 1
    return alone[window - shorter + 1 : window - shorter + 1 + n] == alone[:n] if n > 0 else np.zeros(0, bool)


def repeated_windows(
    docs: DataFrame, units, window: int, q: int, steps: tuple[int, ...], first_only: bool, shorter: tuple[DataFrame, int] | None = None
) -> DataFrame:
    """doc (key of a document) and spans: the repeated windows' ranges, for each of docs(key, text, ...) that has any.

    units(text) gives the sequence of unit values. first_only: the places are in order of docs.doc_id, those without one
    first. shorter: the result for a shorter window and that window; only starts are looked at whose shorter windows,
    at all later offsets within the window, are repeated.
    """
    bounded_batches(docs.sparkSession)

    def first(batches):
        def found():
            for batch in batches:
                for doc, row, text, *known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    u = units(text)
                    allowed = longer_starts(len(u), known[0], short, window) if known else None
                    for x in first_groups(u, window, q, allowed):
                        yield (doc, row), x

        return once_per_task(found(), first_only)

    def finer(step):
        def run(batches):
            def found():
                for batch in batches:
                    for doc, row, text, pos in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                        for x in refined_groups(units(text), window, step, np.array(pos, np.int64)):
                            yield (doc, row), x

            return once_per_task(found(), first_only)

        return run

    schema = ORDERED_ROWS if first_only else ROWS
    texts = docs.select("key", (F.coalesce("doc_id", F.lit(NULL_DOC)) if first_only else F.lit(0).cast("long")).alias("id"), "text")
    if shorter:
        known, short = shorter
        some = maybe_in(texts, "key", known.select("doc"))
        rows = some.join(known, some.key == known.doc).select("key", "id", "text", "spans")
    else:
        rows = texts
    levels = [decided(rows.mapInArrow(first, schema), first_only)]
    for step in steps:
        # Starts of one document only: as many as it has, at most.
        todo = levels[-1].where("open").groupBy("doc").agg(F.collect_set("pos").alias("todo"))
        some = maybe_in(texts, "key", levels[-1].where("open").select("doc"))
        rows = some.join(todo, some.key == todo.doc).select("key", "id", "text", "todo").mapInArrow(finer(step), schema)
        levels.append(decided(rows, first_only))
    removed = reduce(DataFrame.unionAll, (x.where("removed").select("doc", "pos") for x in levels))
    spans = checkpointed(removed.groupBy("doc").agg(F.collect_set("pos").alias("spans")))
    for x in levels:
        drop_table(x)
    release(docs.sparkSession)
    return spans


def with_spans(docs: DataFrame, **spans: DataFrame) -> DataFrame:
    """docs with a column of ranges for each result of ``repeated_windows``; texts without any are not shuffled."""
    keys = reduce(DataFrame.unionAll, (x.select("doc") for x in spans.values()))
    may = membership(keys)(F.col("key"))
    some, other = docs.where(may), docs.where(~may)
    for name, x in spans.items():
        some = some.join(x.select(F.col("doc").alias("key"), F.col("spans").alias(name)), "key", "left")
        other = other.withColumn(name, F.lit(None).cast("array<long>"))
    return some.unionAll(other)


def removed_units(n: int, spans: list[int] | None, window: int) -> np.ndarray:
    """Which of n units the windows cover."""
    edge = np.zeros(n + 1, np.int64)
    if spans:
        start, count, _ = unpacked(np.array(spans, np.int64))
        inside = start + count - 1 + window <= n
        start, count = start[inside], count[inside]
        np.add.at(edge, start, 1)
        np.add.at(edge, start + count - 1 + window, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True as (start, end)."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True))
