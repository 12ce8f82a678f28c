"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in lower case (A-Z) with runs of white space as one space, in code points.
Each benchmark item is covered by overlapping segments of about ``SEGMENT`` characters; a
segment of m characters has an edit budget of e. By the q-gram lemma, a text region within e
edits of it shares at least m - q + 1 - q * e of its q-grams with it, on diagonals that fit in
one of the overlapping bands of 2 * (e + 1) diagonals. So a document's q-grams are looked up
among the benchmark's, windows with too few hits are left out, hits are counted in bands, and
each band that meets the bound is verified by a banded alignment. Benchmarks and texts may be made from
templates: equal segments of items are one, texts are searched in parts that end where their own
hashes are least, so that repeated text has equal parts, and equal parts, and equal regions of a part, are
searched once. The first region with the least edits counts.

The documents are read once for each block of the benchmark. A block has a bounded size, comes
through the driver, is broadcast, and goes before the next one comes; so neither the driver nor the executors hold more
than one block. There is no shuffle.

Defined results: null and empty texts match nothing, and empty items match nothing; items with
fewer than 2 * q characters are searched for as whole words without edits; repeated documents are reported each, as often as they occur; repeated items
are reported under each id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.text import MULT, checkpointed, map_rows, mix, struct_udf

Q = 10
SEGMENT = 100
EDIT_RATE = 0.08
BLOCK_CHARS = 8 << 20
TABLE_BITS = 22
PART = 1024  # characters of a part of a text: so many to twice as many
PARTS_KEPT = 256
REGIONS_KEPT = 1 << 17
HITS = 1 << 20  # hits that are spread over segments at once
MATCHES = "doc_id long, item_id long, start long, end long, edits long, matched_chars long"


Found = tuple[int, int, int]  # edits, start, end


def normal(text: bytes | None) -> np.ndarray:
    """Code points in lower case with single spaces."""
    return np.frombuffer(b" ".join((text or b"").lower().split()).decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)


def as_text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "replace")


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    n = len(points) - q + 1
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= MULT
        h += points[k : k + n]
    return mix(h)


class Index:
    """The q-grams of one block of the benchmark, and its short items. Equal segments, of templates, are one."""

    def __init__(self, items: list[tuple[int, bytes]], q: int, segment: int, edit_rate: float):
        self.q, self.made = q, {}
        parts: dict[bytes, list[int]] = {}  # code points of a segment: the items that have it
        short: dict[str, list[int]] = {}
        for item, text in items:
            points = normal(text)
            if len(points) < 2 * q:
                if len(points):
                    short.setdefault(f" {as_text(points)} ", []).append(item)
                continue
            step = segment // 2
            last = max(0, len(points) - segment)
            starts = [*range(0, last, step), last] if len(points) > segment + step else [0]
            for s in starts:
                part = points[s : s + segment] if len(starts) > 1 else points
                parts.setdefault(part.tobytes(), []).append(item)
        self.segments, self.items = [np.frombuffer(x, np.uint32) for x in parts], list(parts.values())
        self.budgets = np.array([min(int(edit_rate * len(p)), (len(p) - q) // q) for p in self.segments], np.int64)
        self.bounds = np.array([len(p) for p in self.segments], np.int64) - q + 1 - q * self.budgets
        hashes = [grams(p, q) for p in self.segments]
        h = np.concatenate([np.empty(0, np.uint64), *hashes])
        order = np.argsort(h, kind="stable")
        self.segment = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])[order]
        self.place = np.concatenate([np.empty(0, np.int64), *(np.arange(len(x)) for x in hashes)])[order]
        self.hashes, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.short = ahocorasick.Automaton()
        for k, (pattern, ids) in enumerate(short.items()):
            self.short.add_word(pattern, (k, len(pattern) - 2, ids))
        if short:
            self.short.make_automaton()
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - TABLE_BITS)] = True
        self.bound = int(min(self.bounds, default=1))
        self.longest = max((len(p) + int(e) for p, e in zip(self.segments, self.budgets, strict=True)), default=0)
        # A band's region begins this much before its part of the text, and ends this much after it.
        self.margin = self.longest + 4 * int(max(self.budgets, default=0)) + 4

    def masks(self, s: int) -> dict[int, int]:
        """Where each character stands in a segment, as bits."""
        if s not in self.made:
            bits: dict[int, int] = {}
            for i, c in enumerate(self.segments[s].tolist()):
                bits[c] = bits.get(c, 0) | 1 << i
            self.made[s] = bits
        return self.made[s]

    def search(self, text: bytes | None) -> list[tuple[int, int, int, int, int]]:
        """(item, start, end, edits, matched characters) for each item found; offsets in the normal form."""
        points = normal(text)
        best: dict[int, Found] = {}
        for s, found in self.regions(points):
            if s not in best or found < best[s]:
                best[s] = found
        merged: dict[int, tuple[int, int, int, int]] = {}
        for s, (edits, start, end) in sorted(best.items()):
            for item in self.items[s]:
                a = merged.get(item, (start, end, 0, 0))
                merged[item] = (min(a[0], start), max(a[1], end), a[2] + edits, a[3] + len(self.segments[s]))
        return [(item, *x) for item, x in merged.items()] + self.search_short(points)

    def finds(self, text: bytes | None) -> bool:
        """Whether any item is found."""
        points = normal(text)
        return next(self.regions(points), None) is not None or bool(self.search_short(points))

    def search_short(self, points: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """Items of fewer than 2 * q characters: the first place of each as whole words, without edits."""
        if not len(self.short):
            return []
        found: dict[int, tuple[int, int, int, int]] = {}
        seen: set[int] = set()
        for end, (k, n, ids) in self.short.iter(f" {as_text(points)} "):
            if k not in seen:
                seen.add(k)
                found.update(dict.fromkeys(ids, (end - 1 - n, end - 1, 0, n)))
        return [(item, *x) for item, x in found.items()]

    def regions(self, points: np.ndarray) -> Iterator[tuple[int, Found]]:
        """The segments found in each part of the text, with the region of least edits in that part.

        Parts end where the text's own hashes say, so parts of repeated text are equal; equal parts are searched once.
        """
        h = grams(points, self.q)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - TABLE_BITS)])
        if len(at) < self.bound:
            return
        known = np.searchsorted(self.hashes, h[at])
        known[known == len(self.hashes)] = 0
        real = self.hashes[known] == h[at]
        at, known = at[real], known[real]
        # A region has at least ``bound`` hits within ``longest`` characters: leave lonely hits out.
        k = self.bound - 1
        if len(at) <= k:
            return
        near = at[k:] - at[: len(at) - k] <= self.longest
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(near), 1)
        np.add.at(cover, np.flatnonzero(near) + k + 1, -1)
        dense = np.cumsum(cover[:-1]) > 0
        at, known = at[dense], known[dense]
        searched: dict[bytes, list[tuple[int, Found]]] = {}
        aligned_before: dict[tuple[int, bytes], Found | None] = {}
        low = 0
        while len(at) and low < len(points):
            high = low + PART + int(np.argmin(h[low + PART : low + 2 * PART])) if low + 2 * PART < len(h) else len(points)
            # The part with the margins that its bands' regions reach into.
            a, z = max(0, low - self.margin), min(len(points), high + self.margin)
            inside = slice(*np.searchsorted(at, (a, z - self.q + 1)))
            if np.searchsorted(at, low) < np.searchsorted(at, high):
                key = xxhash.xxh3_128_digest(points[a:z].tobytes()) + bytes((a == 0, z == len(points)))
                if key not in searched:
                    if len(searched) >= PARTS_KEPT:
                        searched.clear()
                    searched[key] = list(self.part_regions(points[a:z], at[inside] - a, known[inside], aligned_before))
                yield from ((s, (edits, start + a, end + a)) for s, (edits, start, end) in searched[key])
            low = high

    def bands(self, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments with enough hits in a band, the band's diagonal of most hits, and its hits, the fullest first.

        Hits are spread over segments some at a time, and added up by diagonals, then by bands.
        """
        base = np.int64(int(at[-1]) + 2 * self.longest + 2)
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        held = self.count[known]
        group = np.cumsum(held) // HITS
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(group)) + 1):
            m = held[part]
            entry = np.repeat(self.first[known[part]] - np.cumsum(m) + m, m) + np.arange(m.sum())
            new, n_new = np.unique(self.segment[entry] * base + self.longest + np.repeat(at[part], m) - self.place[entry], return_counts=True)
            keys, n = added(np.concatenate([keys, new]), np.concatenate([n, n_new]))
        segment, diagonal = keys // base, keys % base - self.longest
        band = np.floor_divide(diagonal, self.budgets[segment] + 1)
        # Overlapping bands: each diagonal is in two.
        segment, diagonal, n, band = np.tile(segment, 2), np.tile(diagonal, 2), np.tile(n, 2), np.concatenate([band, band - 1])
        order = np.lexsort((diagonal, -n, band, segment))
        segment, diagonal, n, band = segment[order], diagonal[order], n[order], band[order]
        first = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (band[1:] != band[:-1])]))
        shared, segment, diagonal = np.add.reduceat(n, first), segment[first], diagonal[first]
        kept = np.flatnonzero(shared >= self.bounds[segment])
        kept = kept[np.argsort(-shared[kept], kind="stable")]
        return segment[kept], diagonal[kept], shared[kept]

    def part_regions(self, points: np.ndarray, at: np.ndarray, known: np.ndarray, aligned_before: dict) -> Iterator[tuple[int, Found]]:
        """The region of least edits of each segment found in a part, the first of equal ones.

        A band's region is taken about its diagonal of most hits, so that equal parts of a text have equal regions, which are aligned once.
        """
        best: dict[int, Found] = {}
        for s, d, hits in zip(*(x.tolist() for x in self.bands(at, known)), strict=True):
            part, budget = self.segments[s], int(self.budgets[s])
            # Fewer hits mean more edits: no band that follows can be as good.
            if s in best and best[s][0] < -(-(len(part) - self.q + 1 - hits) // self.q):
                continue
            low, high = d - 2 * budget - 1, d + 2 * budget + 1
            a, z = max(0, low), high + len(part)
            region = points[a:z]
            key = s, region.tobytes() + bytes((low < 0, z > len(points)))
            if key not in aligned_before:
                found = aligned(part, points, low, high, budget) if least_edits(self.masks(s), len(part), region) <= budget else None
                if len(aligned_before) >= REGIONS_KEPT:
                    aligned_before.clear()
                aligned_before[key] = found and (found[2], found[0] - a, found[1] - a)
            found = aligned_before[key]
            if found:
                found = found[0], found[1] + a, found[2] + a
                best[s] = min(best.get(s, found), found)
        yield from best.items()


def added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def least_edits(masks: dict[int, int], m: int, region: np.ndarray) -> int:
    """Least edits between a segment and any part of the region, by bit-parallel columns."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, edits = full, 0, m
    best = m
    for c in region.tolist():
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        gain, loss = down | (~(x | up) & full), up & x
        if gain & top:
            edits += 1
        elif loss & top:
            edits -= 1
            best = min(best, edits)
        gain, loss = gain << 1 & full, loss << 1 & full
        up, down = loss | (~((eq | down) | gain) & full), gain & (eq | down)
    return best


def aligned(part: np.ndarray, points: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The region of least edits (start, end, edits) on diagonals low..high, if within the budget.

    Row i of the table holds the cells of the diagonals: column i + d for diagonal d. Text before and after
    the region is free.
    """
    m, width = len(part), high - low + 1
    exact = np.arange(max(low, 0), min(high, len(points) - m) + 1)
    for d in exact:
        if np.array_equal(points[d : d + m], part):
            return int(d), int(d) + m, 0
    big = m + width
    diagonals = np.arange(low, high + 1)
    inside = (diagonals >= 0) & (diagonals <= len(points))
    cost = np.where(inside, 0, big)
    start = diagonals.copy()
    padded = np.concatenate([points, np.zeros(1, np.uint32)])
    for i in range(m):
        column = diagonals + i + 1  # text characters used after this row
        ok = (column >= 1) & (column <= len(points))
        same = padded[np.clip(column - 1, 0, len(points))] == part[i]
        step = cost + np.where(ok & same, 0, 1)
        step[~ok] = big
        # A character of the segment is left out: from the next diagonal.
        skip = np.append(cost[1:] + 1, big)
        skip[(column < 0) | (column > len(points))] = big
        use = skip < step
        new = np.where(use, skip, step)
        begin = np.where(use, np.append(start[1:], 0), start)
        # A character of the text is left out: along the row, cheapest first cell by a running minimum.
        key = (new - np.arange(width)) * (4 * big) + np.arange(width)
        first = np.minimum.accumulate(key)
        origin = first % (4 * big)
        cost, start = new[origin] + np.arange(width) - origin, begin[origin]
    k = int(np.argmin(cost))
    return (int(start[k]), int(diagonals[k]) + m, int(cost[k])) if cost[k] <= budget else None


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in blocks of bounded size."""
    block, size = [], 0
    for item, text in benchmark.select("item_id", F.col("text").cast("binary")).where("text is not null").toLocalIterator():
        block.append((item, bytes(text)))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


class Searcher:
    """Builds a block's index once in each Python worker."""

    def __init__(self, shared, q: int, segment: int, edit_rate: float):
        self.shared, self.options, self.index = shared, (q, segment, edit_rate), None

    def __getstate__(self):
        return self.__dict__ | {"index": None}

    def made(self) -> Index:
        if self.index is None:
            self.index = Index(self.shared.value, *self.options)
        return self.index


def searchers(benchmark: DataFrame, q: int, segment: int, edit_rate: float, block_chars: int) -> Iterator[tuple[Searcher, bool]]:
    """A searcher for each block, and whether it is the last; a block's broadcast goes when the next one is asked for."""
    sc, rest = benchmark.sparkSession.sparkContext, blocks(benchmark, block_chars)
    block = next(rest, None)
    while block is not None:
        following = next(rest, None)
        shared = sc.broadcast(block)
        yield Searcher(shared, q, segment, edit_rate), following is None
        if following is not None:
            shared.destroy()
        block = following


def contamination(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, segment: int = SEGMENT, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for search, last in searchers(benchmark, q, segment, edit_rate, block_chars):

        def run(it, search=search):
            for doc_id, text in it:
                for found in search.made().search(text):
                    yield doc_id, *found

        found = map_rows(rows, run, MATCHES)
        out = out.unionAll(found if last else checkpointed(found))
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, q: int = Q, segment: int = SEGMENT, edit_rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """docs without the documents in which an item is found."""
    for search, last in searchers(benchmark, q, segment, edit_rate, block_chars):
        udf = struct_udf(docs.sparkSession, partial(finds, search=search), "found boolean")
        kept = docs.where(~udf(F.col("text").cast("binary")).found)
        docs = kept if last else checkpointed(kept)
    return docs


def finds(text: bytes | None, search: Searcher) -> tuple[bool]:
    return (search.made().finds(text),)


def op10_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, edits, matched_chars."""
    return contamination(docs, benchmark)
