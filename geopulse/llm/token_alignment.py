"""Alignment of two tokenizers' tokens of the same text by a dangling-suffix transducer.

Both sides encode the text with one blank before it. The transducer reads their tokens in turn: its
state is which side leads and the bytes of that side's last token that the other side hasn't
matched yet. The side behind gives its next token, which is linked with the leader's last one, as
their byte ranges overlap; the state goes on to what is left of the residual, or to what of the
token stands out, on the other side. An empty residual closes a group. Transitions are remembered by
state and token; they fail where bytes differ.

Where no token of either side reaches from a character other than white space into a blank or a
line feed, which is looked up in the vocabularies, both sides' tokens end there, in every text. So
texts are cut there, residuals are empty at the cuts, and the result of a whole word is remembered
for the other times it occurs.

A linked pair's count is the number of documents that hold it. Documents come in blocks of
bounded size (a longer text is a block of its own): a task numbers a block's distinct pairs and
writes, for each document, the numbers with their multiplicities, and once for the block, the pairs with
their documents. Only the latter are exploded, added up and joined with the totals by pair, and
they meet the block's documents again by the block's number. The highest counts have a row for each
id of the first vocabulary, and are broadcast.

Defined results: texts that are null, empty or not the same bytes as the blank and the text on both
sides have no tokens, zeros and '' for the digest; each row is a document, also with an id that
others have, or none; ties for the highest count are all best; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geopulse.llm.text import arrow_schema, checkpointed, map_rows

BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 1 << 16
BLOCK_PAIRS = 1 << 20
KNOWN_WORDS = 1 << 18
SEGMENT = 1 << 16  # characters that are cut into words at once
LONGEST_KEPT = 64  # characters of words whose results are remembered
TRANSITIONS = 1 << 20
PAIRS_IN_A_ROW = 1 << 16

CUT = re.compile(r"(?<=\S)(?=[ \n])")
CROSSING = re.compile(r"\S[ \n]")


class ByteLevel:
    """The first side: a byte-level vocabulary of ranks. Its pattern begins a token wherever white space begins.

    Texts with runs of white space that are too long for its pattern matching go to the slower encoder of the same vocabulary.
    """

    def __init__(self, path: str, slow_path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow_path, self.slow = slow_path, None
        self.words = True

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of texts as they are; names of special tokens are ordinary text."""
        try:
            return [self.encoding.encode_ordinary(w) for w in words]
        except ValueError:
            if self.slow is None:
                self.slow = Tokenizer.from_file(self.slow_path)
                self.slow.encode_special_tokens = True
            return [x.ids for x in self.slow.encode_batch(words, add_special_tokens=False)]


class Pieces:
    """The second side: a sentence-piece model, which puts a blank before a text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of, plain = [], []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes_of.append(piece.replace("▁", " ").encode())
                plain.append(piece.replace("▁", " "))
        self.blank = self.model.piece_to_id("▁")
        self.words = not any(CROSSING.search(p) or "\n" in p for p in plain)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of texts that begin with a blank or a line feed.

        Before a line feed the model's own blank is a token of its own, as no piece holds a line feed; it puts none before nothing.
        """
        found = self.model.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        return [[self.blank] if w == " " else ids if w[0] == " " else ids[1:] for w, ids in zip(words, found, strict=True)]


class Files(NamedTuple):
    """Paths of the vocabularies."""

    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    slow: str = public_tokenizers.path("byte_bpe_50k.json")
    pieces: str = public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """Transitions between states: which side leads, and the bytes of its last token that the other side hasn't matched."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.first, self.second = first, second
        self.after: dict[tuple[bool, bytes, int], tuple[bool, bytes] | None] = {}

    def transition(self, first_leads: bool, residual: bytes, token: int) -> tuple[bool, bytes] | None:
        """The state after the next token of the side behind (of the first side, where the residual is empty); None where bytes differ."""
        key = (first_leads, residual, token)
        if key in self.after:
            return self.after[key]
        if len(self.after) > TRANSITIONS:
            self.after.clear()
        if not residual:
            new = True, self.first[token]
        else:
            more = (self.second if first_leads else self.first)[token]
            if residual.startswith(more):
                new = first_leads, residual[len(more) :]
            else:
                new = (not first_leads, more[len(residual) :]) if more.startswith(residual) else None
        self.after[key] = new
        return new


class State(dict):
    """A state reached by some tokens since the last empty residual: token of the side behind -> State, or Group where that closes one."""

    __slots__ = ("first_leads", "residual", "a", "b", "links")

    def __init__(self, first_leads: bool, residual: bytes, a: tuple[int, ...], b: tuple[int, ...], links: tuple[int, ...]):
        self.first_leads, self.residual, self.a, self.b, self.links = first_leads, residual, a, b, links


#: A closed group: bytes, tokens of the first side * 2 ** 32 + tokens of the second, the ids as
#: a1,a2|b1, and the linked pairs' numbers as 32-bit integers.
Group = tuple[int, int, bytes, bytes]

#: The same of the groups of a word, without the bytes.
Word = tuple[int, bytes, bytes]
COUNTS, GROUPS, NUMBERS = map(itemgetter, range(3))


class Aligner:
    """Aligns texts, and numbers the linked pairs of the texts since it began the block."""

    def __init__(self, files: Files):
        self.one, self.two = ByteLevel(files.ranks, files.slow), Pieces(files.pieces)
        self.cut = self.one.words and self.two.words
        self.transducer = Transducer(self.one.bytes_of, self.two.bytes_of)
        self.forget()
        self.begin()

    def forget(self) -> None:
        self.known: dict[str, Word | None] = {}
        self.older: dict[str, Word | None] = {}
        self.pairs: dict[int, int] = {}
        self.root, self.states = State(False, b"", (), (), ()), 0

    def begin(self) -> None:
        """A new block. Pairs keep their numbers, unless there are very many."""
        if len(self.pairs) >= BLOCK_PAIRS or self.states >= TRANSITIONS:
            self.forget()
        self.docs = np.zeros(max(1 << 12, len(self.pairs)), np.int64)

    def reached(self, state: State, token: int) -> State | Group | None:
        """What the token leads to, which the state remembers; None where bytes differ. Two tokens are linked by each but a group's first."""
        new = self.transducer.transition(state.first_leads, state.residual, token)
        if new is None:
            return None
        if not state.residual:
            a, b, links = (token,), (), ()
        elif state.first_leads:
            a, b, links = state.a, (*state.b, token), (*state.links, state.a[-1] << 32 | token)
        else:
            a, b, links = (*state.a, token), state.b, (*state.links, token << 32 | state.b[-1])
        if new[1]:
            state[token] = State(*new, a, b, links)
        else:
            size = sum(len(self.one.bytes_of[i]) for i in a)
            written = ",".join(map(str, a)) + "|" + ",".join(map(str, b))
            numbers = array("I", [self.pairs.setdefault(p, len(self.pairs)) for p in links])
            state[token] = size, len(a) << 32 | len(b), written.encode(), numbers.tobytes()
        self.states += 1
        return state[token]

    def read(self, words: list[bytes], a: list[int], b: list[int]) -> list[Word] | None:
        """The results of words from the tokens of all of them; None where the bytes differ."""
        root, out, i, j, at, end = self.root, [], 0, 0, 0, 0
        a, b = [*a, -1], [*b, -1]  # no token leads on from the end
        for word in words:
            end += len(word)
            groups: list[Group] = []
            while at < end:
                state = root
                while type(state) is State:
                    if state.first_leads:
                        token = b[j]
                        j += 1
                    else:
                        token = a[i]
                        i += 1
                    after = state.get(token)
                    if after is None and (token < 0 or (after := self.reached(state, token)) is None):
                        return None
                    state = after
                groups.append(state)
                at += state[0]
            if at > end:
                return None
            out.append((sum([g[1] for g in groups]), b";".join([g[2] for g in groups]), b"".join([g[3] for g in groups])))
        return out if i == len(a) - 1 and j == len(b) - 1 else None

    def words(self, text: str) -> Iterator[list[str]]:
        """The text's words, with the white space before them, some at a time."""
        text = " " + text
        if not self.cut:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = CUT.search(text, at + SEGMENT)
            end = end.start() if end else len(text)
            yield CUT.split(text[at:end])
            at = end

    def look_up(self, words: list[str]) -> list[Word | None]:
        """The words' results; None for one whose bytes differ."""
        known, older = self.known, self.older
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            if len(known) > KNOWN_WORDS:
                self.older, self.known = known, {}
                known, older, new = self.known, known, words
            known.update({w: older[w] for w in new if w in older})
            new = [w for w in dict.fromkeys(new) if w not in known]
        long: dict[str, Word | None] = {}
        if new:
            for w, found in zip(new, self.align(new), strict=True):
                (known if len(w) <= LONGEST_KEPT else long)[w] = found
        return [long[w] if w in long else known[w] for w in words] if long else [known[w] for w in words]

    def align(self, words: list[str]) -> list[Word | None]:
        """The results of words, of which only the last may end with white space: as one text, or each for itself where the bytes differ somewhere."""
        text = "".join(words)
        (a,), (b,) = self.one.encode([text]), self.two.encode([text])
        parts = [w.encode() for w in words]
        found = self.read(parts, a, b) if b"".join([self.one.bytes_of[i] for i in a]) == b"".join(parts) else None
        if found is not None:
            return found
        return [None] if len(words) == 1 else [x for w in words for x in self.align([w])]

    def results(self, text: bytes | None) -> Iterator[list[Word | None]]:
        """The results of the text's words, some at a time; ends with one that is None where the bytes differ."""
        if not text:
            yield [None]
            return
        try:
            text = text.decode()
        except UnicodeDecodeError:
            yield [None]
            return
        for words in self.words(text):
            found = self.look_up(words)
            yield found
            if None in found:
                return

    def digest(self, text: bytes | None) -> tuple[int, int, int, int, str, bytes]:
        """Tokens of either side, groups, links, hash of the groups, and the pairs' numbers and multiplicities, packed."""
        tokens, hasher, between, parts = 0, hashlib.sha256(), b"", []
        for found in self.results(text):
            if None in found:
                return 0, 0, 0, 0, "", b""
            tokens += sum(map(COUNTS, found))
            hasher.update(between + b";".join(map(GROUPS, found)))
            between = b";"
            parts.append(np.unique(np.frombuffer(b"".join(map(NUMBERS, found)), np.uint32), return_counts=True))
        at, n = parts[0]
        if len(parts) > 1:
            at, where = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([x for _, x in parts])).astype(np.int64)
        if len(self.pairs) > len(self.docs):
            self.docs = np.concatenate([self.docs, np.zeros(len(self.pairs), np.int64)])
        self.docs[at] += 1
        n_a, n_b, links = tokens >> 32, tokens & 0xFFFFFFFF, int(n.sum())
        # Every token but the first of each group makes one link.
        return n_a, n_b, n_a + n_b - links, links, hasher.hexdigest(), packed(at, n)

    def block(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the block's pairs, the pairs as first id * 2 ** 32 + second, and how many of the block's documents hold each."""
        at = np.flatnonzero(self.docs)
        return at, np.fromiter(self.pairs, np.int64, len(self.pairs))[at], self.docs[at]


@cache
def aligner_of(files: Files) -> Aligner:
    """One for each Python worker, which several tasks use one after the other."""
    return Aligner(files)


def packed(at: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending numbers and their multiplicities: differences and counts, byte by byte of the same place, compressed."""
    both = np.concatenate([np.diff(at, prepend=np.uint32(0)), n]).astype(np.uint32)
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    if not data:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def as_lists(group: bytes) -> dict[str, list[int]]:
    a, b = group.split(b"|")
    return {"a": [*map(int, a.split(b","))], "b": [*map(int, b.split(b","))]}


def alignments(docs: DataFrame, files: Files = Files()) -> DataFrame:  # noqa: B008
    """doc_id, and the groups of each text in order: a and b are the ids of either side."""

    def run(rows):
        aligner = aligner_of(files)
        aligner.begin()
        for doc_id, text in rows:
            found = [w for part in aligner.results(text) for w in part]
            yield doc_id, [] if None in found else [as_lists(group) for w in found for group in w[1].split(b";")]
            if len(aligner.pairs) >= BLOCK_PAIRS or aligner.states >= TRANSITIONS:
                aligner.begin()

    return map_rows(docs.select("doc_id", F.col("text").cast("binary")), run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>", 64)


DIGESTS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, used binary, at array<int>, pairs array<long>, docs array<long>"


def digests(docs: DataFrame, files: Files) -> DataFrame:
    """Rows of documents (pairs null), and rows of the blocks' pairs with their numbers. Written, as the numbers are a task's own."""

    def run(rows):
        aligner, done, size, n = aligner_of(files), 0, 0, 0
        aligner.begin()
        first = TaskContext.get().partitionId() << 32

        def ended():
            columns = aligner.block()
            for i in range(0, len(columns[0]), PAIRS_IN_A_ROW):
                yield first + done, *[None] * 7, *(x[i : i + PAIRS_IN_A_ROW] for x in columns)

        for doc_id, text in rows:
            yield first + done, doc_id, *aligner.digest(text), None, None, None
            size += len(text or b"")
            n += 1
            if size >= BLOCK_BYTES or n >= BLOCK_ROWS or len(aligner.pairs) >= BLOCK_PAIRS or aligner.states >= TRANSITIONS:
                yield from ended()
                aligner.begin()
                done, size, n = done + 1, 0, 0
        yield from ended()

    return checkpointed(map_rows(docs.select("doc_id", F.col("text").cast("binary")), run, DIGESTS, 1024))


def exploded(found: DataFrame) -> DataFrame:
    """(block, at, pair, docs) of the blocks' pairs."""
    rows = found.where("pairs is not null").select("block", F.explode(F.arrays_zip("at", "pairs", "docs")).alias("x"))
    return rows.select("block", F.col("x.at").alias("at"), F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))


def counted(pairs: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold the pair, and whether no pair of its first id has more."""
    n = pairs.groupBy("pair").agg(F.sum("docs").alias("n"))
    first = F.shiftright("pair", 32)
    # A row for each id of the first vocabulary at most.
    top = n.groupBy(first.alias("a")).agg(F.max("n").alias("top"))
    return n.withColumn("a", first).join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def linked_pairs(docs: DataFrame, files: Files = Files()) -> DataFrame:  # noqa: B008
    """a, b, n and best of all linked pairs of ids."""
    return counted(exploded(digests(docs, files))).select(
        F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n", "best"
    )


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the sums of their links' counts."""
    at = pairs["at"].to_numpy()
    n, best = np.zeros((2, max(at, default=-1) + 1), np.int64)
    n[at], best[at] = pairs["n"].to_numpy(), pairs["best"].to_numpy()
    sums = [(int(best[k] @ m), int(n[k] @ m)) for k, m in map(unpacked, docs["used"].to_pylist())]
    out = docs.drop_columns(["block", "used"])
    return out.append_column("n_best", pa.array([x for x, _ in sums], pa.int64())).append_column("count_sum", pa.array([x for _, x in sums], pa.int64()))


def link_counts(docs: DataFrame, files: Files = Files()) -> DataFrame:  # noqa: B008
    """doc_id, tokens of either side, groups, links, best links, sum of the links' counts, hash of the groups."""
    found = digests(docs, files)
    pairs = exploded(found)
    totals = counted(pairs).select(F.col("pair").alias("key"), "n", "best")
    values = pairs.join(totals, pairs.pair == totals.key).select(F.col("block").alias("of"), "at", "n", F.col("best").cast("long").alias("best"))
    names, _ = arrow_schema(docs.sparkSession, RESULT)
    rows = found.where("pairs is null").select("block", *(c for c in names if c in found.columns), "used")
    merged = rows.groupBy("block").cogroup(values.groupBy("of"))
    return merged.applyInArrow(lambda left, right: summed(left, right).select(names), RESULT)


def op11_token_alignment(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    return link_counts(docs)
