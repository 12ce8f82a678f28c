"""Packing: order-preserving dynamic programming over window cuts.

Documents are tokenized in stored order, each ends with the separator id, and the stream of a
partition is cut into sequences of at most ``window`` ids. Cuts may be made at document ends
(free), sentence ends and, only in long sentences, every ``GRAIN`` ids. With positions p,

    f(j) = penalty(j) + per_sequence + min over i of f(i) + padding(p[j] - p[i]),

and as padding is ``window - length``, the minimum over the window is a minimum of
``f(i) + p[i]``, kept in a monotone queue; lengths that are a power of two need no padding and
are looked up one by one (from GRAIN ids on). Nothing is dropped and no shuffle is needed: a partition's stream is
worked off in bounded chunks, of which the ids behind the best late cut go to the next chunk.

Defined results: a null text is empty, and an empty text is the separator alone; rows with the
same doc_id, or none, are documents of their own; a document longer than a window has several
pieces; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
from collections import deque
from functools import cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geopulse.llm.text import map_rows

WINDOW = 1024
SEPARATOR = 0
GRAIN = 32
SENTENCE_CUT = 4
INNER_CUT = 24
PER_SEQUENCE = 8
CHUNK = 1 << 18

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def vocabulary() -> str:
    """The tokenizer's file: the same vocabulary as byte_bpe_50k.json, as ranks, which encode several times faster."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """text -> ids. Runs of white space that are too long for the fast encoder's pattern matching go to the slower one."""

    def __init__(self, encoding: tiktoken.Encoding, slow_path: str):
        self.encoding, self.slow_path, self.slow = encoding, slow_path, None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            self.slow = self.slow or Tokenizer.from_file(self.slow_path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@cache
def load_tokenizer(path: str) -> tuple[Encoder, np.ndarray]:
    """The encoder, and for each id whether a sentence can end with it.

    Added tokens, which are single ids in texts too, are read from the JSON file beside the ranks.
    """
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    slow_path = os.path.splitext(path)[0] + ".json"
    with open(slow_path, encoding="utf-8") as f:
        added = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    ends = np.zeros(max(*ranks.values(), *added.values()) + 1, bool)
    for token, i in ranks.items():
        ends[i] = token.rstrip(b"\"')]").endswith((b".", b"!", b"?", b"\n"))
    return Encoder(tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added), slow_path), ends


def cut_points(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a document may be cut (its end is the last), and the penalties."""
    n = len(ids)
    at = np.flatnonzero(ends[ids[:-1]]) + 1
    at = np.append(at, n)
    gaps = np.diff(at, prepend=0)
    if gaps.max() > 2 * GRAIN:
        inner = np.arange(GRAIN, n, GRAIN)
        # Inner places only in gaps that are long.
        inner = inner[gaps[np.searchsorted(at, inner)] > 2 * GRAIN]
        inner = np.setdiff1d(inner, at, assume_unique=True)
        penalty = np.concatenate([np.full(len(at), SENTENCE_CUT), np.full(len(inner), INNER_CUT)])
        at = np.concatenate([at, inner])
        order = np.argsort(at, kind="stable")
        at, penalty = at[order], penalty[order]
    else:
        penalty = np.full(len(at), SENTENCE_CUT)
    penalty[-1] = 0
    return at, penalty


def best_cuts(points: list[int], penalties: list[int], window: int, closed: bool) -> list[int]:
    """The cuts of least cost, from points[0] (where a sequence begins) on.

    closed: the last point ends a sequence; else the cheapest late point does, and the ids behind it stay.
    """
    powers = [1 << k for k in range(window.bit_length()) if GRAIN <= 1 << k < window]
    place = {p: i for i, p in enumerate(points)}
    cost, back = [0] * len(points), [0] * len(points)
    queue: deque[tuple[int, int]] = deque([(points[0], 0)])
    for j in range(1, len(points)):
        p = points[j]
        while points[queue[0][1]] < p - window:
            queue.popleft()
        key, i = queue[0]
        best = key + window - p
        for length in powers:
            k = place.get(p - length)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        cost[j] = best = best + penalties[j] + PER_SEQUENCE
        back[j] = i
        key = best + p
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = len(points) - 1
    if not closed:
        late = range(max(1, int(np.searchsorted(points, points[-1] - window))), len(points))
        j = min(late, key=lambda k: (cost[k], -k), default=0)
    cuts = []
    while j > 0:
        cuts.append(points[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs one partition's stream of documents."""

    def __init__(self, window: int, first_sequence: int, chunk: int = CHUNK):
        self.window, self.sequence, self.chunk = window, first_sequence, chunk
        self.docs: list[tuple] = []  # doc_id, ids not yet packed, how many were, all, cut points, penalties
        self.size = 0

    def add(self, doc_id, ids: np.ndarray, at: np.ndarray, penalty: np.ndarray):
        self.docs.append((doc_id, ids, 0, len(ids), at, penalty))
        self.size += len(ids)
        if self.size >= self.chunk:
            yield from self.flush(closed=False)

    def flush(self, closed: bool):
        """Pieces of all sequences that are settled."""
        if not self.docs:
            return
        starts = np.cumsum([0, *(len(d[1]) for d in self.docs)])
        points = np.concatenate([[0], *(d[4] - d[2] + s for d, s in zip(self.docs, starts, strict=False))])
        penalties = np.concatenate([[0], *(d[5] for d in self.docs)])
        stream = np.concatenate([d[1] for d in self.docs])
        begin = k = 0
        for end in best_cuts(points.tolist(), penalties.tolist(), self.window, closed):
            a = begin
            while a < end:
                while starts[k + 1] <= a:
                    k += 1
                b = min(end, int(starts[k + 1]))
                doc_id, _, done, n, _, _ = self.docs[k]
                yield doc_id, done + a - int(starts[k]), b - a, stream[a:b].tobytes(), n, self.sequence, a - begin
                a = b
            self.sequence += 1
            begin = end
        rest, self.size = [], 0
        for (doc_id, ids, done, n, at, penalty), s in zip(self.docs, starts, strict=False):
            used = min(max(0, begin - int(s)), len(ids))
            if used < len(ids):
                later = at > done + used
                rest.append((doc_id, ids[used:], done + used, n, at[later], penalty[later]))
                self.size += len(ids) - used
        self.docs = rest


def pack_documents(docs: DataFrame, window: int = WINDOW, separator: int = SEPARATOR, path: str | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    path = path or vocabulary()

    def pack(rows):
        encode, ends = load_tokenizer(path)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        for doc_id, text in rows:
            ids = encode((text or b"").decode("utf-8", "replace"))
            ids = np.append(ids, np.uint32(separator)).astype("<u4")
            yield from packer.add(doc_id, ids, *cut_points(ids, ends))
        yield from packer.flush(closed=True)

    return map_rows(docs.select("doc_id", F.col("text").cast("binary").alias("text")), pack, PIECES)


def op1_packing(docs: DataFrame) -> DataFrame:
    """Digest: each piece with the crc32 of its ids."""
    return pack_documents(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
