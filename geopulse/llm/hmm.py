"""A hidden Markov language model over word classes, trained by Baum-Welch in Spark.

Frequent words have a class each; all other words share classes by their ending. A text's
probability is that of its class sequence under the hidden Markov model, times that of each word
within its class (relative frequency, with a Good-Turing share for words never seen). Classes
and states are bounded, the word counts are not: they stay a distributed table.

* Counts: documents are dealt into blocks; a block's words are counted once for the block, and
  added up over blocks by word (partial sums, so common words are no hot task).
* Training: class ids are written once; each pass reads those of all training texts, in
  stretches of ``STRETCH`` tokens; every task returns its expected counts, which Spark adds up,
  and the driver gets their sum.
* Scoring: a block's documents meet the counts of the block's words; the scaled forward
  recursion runs over whole texts and gives the exact likelihood.

Defined results: a null text is empty, and an empty text is the end token alone; a missing
doc_id counts as the empty text for the choice of training rows; repeated rows are counted and
scored each; without training rows N and V are 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.llm.text import arrow_schema, bounded_batches, checkpointed, drop_table, give_back, map_rows

STATES = 12
TOP_WORDS = 1024
ENDINGS = 512
PASSES = 3
STRETCH = 64
TOGETHER = 512
BLOCK_BYTES = 24 << 20
END = b""
SEED = 17
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def fold(doc_id: Column) -> Column:
    """The remainder that tells training rows (not 2) from held-out rows (2)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7


class Classes(dict):
    """Word -> class: the most frequent words, then endings. Words met are kept, up to a limit."""

    LIMIT = 100_000

    def __init__(self, top: list[bytes]):
        super().__init__()
        self.top = {w: i for i, w in enumerate(top)}
        self.n = len(self.top) + ENDINGS

    def __reduce__(self):
        return Classes, (list(self.top),)

    def find(self, word: bytes) -> int:
        k = self.top.get(word)
        return len(self.top) + xxhash.xxh3_64_intdigest(word[-3:]) % ENDINGS if k is None else k

    def __missing__(self, word: bytes) -> int:
        k = self.find(word)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = k
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def tokens(text: bytes | None) -> list[bytes]:
    words = (text or b"").lower().split()
    words.append(END)
    return words


def block_counts(blocks: DataFrame) -> DataFrame:
    """block, word, n (count in the block's training texts; 0 for words of other texts alone)."""

    def count(rows):
        seen: dict[int, Counter] = {}
        held = 0
        for block, train, text in rows:
            words = tokens(text)
            own = seen.setdefault(block, Counter())
            before = len(own)
            if train:
                own.update(words)
            else:
                for w in words:
                    own.setdefault(w, 0)
            held += len(own) - before
            if held > 1_000_000:
                yield from ((b, w, n) for b, x in seen.items() for w, n in x.items())
                seen, held = {}, 0
        yield from ((b, w, n) for b, x in seen.items() for w, n in x.items())

    return map_rows(blocks.select("block", "train", "text"), count, "block long, word binary, n long", flush=65536)


class Model:
    """Start, transition and emission probabilities, and words within classes."""

    def __init__(self, states: int, classes: int):
        rng = np.random.default_rng(SEED)
        draw = lambda *shape: rng.dirichlet(np.full(shape[-1], 0.3), shape[:-1])
        self.start = np.full((2, states), 1 / states)  # at a text's begin; within a text
        self.trans = 0.5 * draw(states, states) + 0.5 * np.eye(states)
        # Each class begins mostly in one state.
        own = rng.dirichlet(np.full(states, 0.2), classes)
        self.emit = own / own.sum(axis=0)

    @classmethod
    def of(cls, start, trans, emit, smoothing: float = 0.01) -> Model:
        m = cls.__new__(cls)
        norm = lambda x: (x + smoothing) / (x + smoothing).sum(axis=-1, keepdims=True)
        m.start, m.trans = norm(start), norm(trans)
        m.emit = norm(emit.T).T  # over classes, for each state
        return m


def expected(model: Model, sequences: list[np.ndarray], firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (start, transitions, emissions) and log-likelihood of sequences.

    Arrays have a row for each state and a column for each sequence, the longest first. Single
    precision within a stretch; sums over stretches are double.
    """
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    sequences = [sequences[i] for i in order]
    lengths = np.array([len(s) for s in sequences])
    longest, many, states = lengths[0], len(sequences), len(model.trans)
    inside = np.arange(longest)[:, None] < lengths
    grid = np.zeros((many, longest), np.intp)
    grid[inside.T] = np.concatenate(sequences)
    grid = np.ascontiguousarray(grid.T)
    active = inside.sum(axis=1)
    emissions_of = np.ascontiguousarray(model.emit.T, np.float32)
    move = model.trans.astype(np.float32)
    back = np.ascontiguousarray(move.T)
    emit = np.zeros((longest, states, many), np.float32)
    alpha = np.zeros_like(emit)
    scale = np.ones((longest, many), np.float32)
    a = model.start.astype(np.float32)[1 - firsts[order]].T
    for t in range(longest):
        n = active[t]
        emit[t, :, :n] = e = np.take(emissions_of, grid[t, :n], axis=1)
        a = (back @ a[:, :n] if t else a) * e
        scale[t, :n] = s = a.sum(axis=0)
        a /= s
        alpha[t, :, :n] = a
    start, trans = np.zeros_like(model.start), np.zeros_like(model.trans)
    beta = np.ones((states, active[-1]), np.float32)
    for t in range(longest - 1, -1, -1):
        if t < longest - 1:
            m = active[t + 1]
            weighted = emit[t + 1, :, :m] * beta
            weighted /= scale[t + 1, :m]
            trans += model.trans * (alpha[t, :, :m] @ weighted.T)
            beta = np.ones((states, active[t]), np.float32)
            beta[:, :m] = move @ weighted
        alpha[t, :, : active[t]] *= beta  # from here on what the state's probability is, given the whole stretch
    np.add.at(start, 1 - firsts[order], alpha[0].T)
    flat = grid[inside]
    emissions = np.stack([np.bincount(flat, alpha[:, k][inside], len(model.emit)) for k in range(states)], axis=1)
    return start, trans, emissions, float(np.log10(scale).sum(dtype=np.float64))


def class_sequences(docs: DataFrame, classes: Classes) -> DataFrame:
    """The class ids of the training texts' tokens as 16-bit numbers, written once for all passes."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def run(rows):
        for (text,) in rows:
            yield (shared.value.of(tokens(text)).astype("<u2").tobytes(),)

    return checkpointed(map_rows(docs.where("train").select("text"), run, "ids binary"))


def baum_welch_pass(sequences: DataFrame, model: Model) -> tuple[Model, float]:
    """One pass over all training texts: counts of each task, added up in Spark."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)
    states, n_classes = len(model.trans), len(model.emit)

    def count(rows):
        model = shared.value
        parts: list[np.ndarray] = []
        firsts: list[int] = []
        total = None

        def add(total):
            new = expected(model, parts, np.array(firsts))
            return new if total is None else tuple(a + b for a, b in zip(total, new, strict=True))

        for (ids,) in rows:
            ids = np.frombuffer(ids, "<u2")
            for i in range(0, len(ids), STRETCH):
                parts.append(ids[i : i + STRETCH])
                firsts.append(int(i == 0))
                if len(parts) == TOGETHER:
                    total = add(total)
                    parts, firsts = [], []
        if parts:
            total = add(total)
        if total is not None:
            start, trans, emit, likelihood = total
            flat = np.concatenate([[likelihood], start.ravel(), trans.ravel(), emit.ravel()])
            for i in range(0, len(flat), 4096):
                yield i, flat[i : i + 4096]

    partial = map_rows(sequences, count, "at long, x array<double>")
    # Sums of arrays by element: each task gave one array for each place.
    rows = partial.select("at", F.posexplode("x").alias("k", "v")).groupBy((F.col("at") + F.col("k")).alias("i")).agg(F.sum("v").alias("v"))
    got = rows.toPandas()  # as many rows as the model has numbers
    flat = np.zeros(1 + 2 * states + states * states + n_classes * states)
    flat[got["i"].to_numpy(np.int64)] = got["v"].to_numpy()
    cut = np.split(flat[1:], [2 * states, 2 * states + states * states])
    return Model.of(cut[0].reshape(2, states), cut[1].reshape(states, states), cut[2].reshape(-1, states)), float(flat[0])


def class_totals(totals: DataFrame, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """For each class: training tokens, and tokens of words seen once."""
    shared = totals.sparkSession.sparkContext.broadcast(classes)

    def total(rows):
        classes = shared.value
        n, once = np.zeros(classes.n, np.int64), np.zeros(classes.n, np.int64)
        for word, c in rows:
            k = classes.find(word)  # each word comes once
            n[k] += c
            once[k] += c == 1
        yield from ((k, int(n[k]), int(once[k])) for k in np.flatnonzero(n))

    rows = map_rows(totals.where("c > 0").select("word", "c"), total, "k long, n long, once long")
    got = rows.groupBy("k").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).toPandas()  # at most a row for each class
    n, once = np.zeros(classes.n), np.zeros(classes.n)
    n[got["k"]], once[got["k"]] = got["n"], got["once"]
    return n, once


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each sequence, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    emissions_of, back = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.trans.T)
    for i in range(0, len(order), 512):
        part = order[i : i + 512]
        lengths = np.array([len(sequences[k]) for k in part])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        a = np.repeat(model.start[:1].T, len(part), axis=1)
        for lo in range(0, int(lengths[0]), 256):  # bounded memory for long texts
            grid = np.zeros((min(256, int(lengths[0]) - lo), int(active[lo])), np.intp)
            for j, k in enumerate(part[: active[lo]]):
                piece = sequences[k][lo : lo + 256]
                grid[: len(piece), j] = piece
            scales = np.ones(grid.shape)
            for t in range(len(grid)):
                n = active[lo + t]
                a = a[:, :n] if lo + t == 0 else back @ a[:, :n]
                a = a * np.take(emissions_of, grid[t, :n], axis=1)
                scales[t, :n] = s = a.sum(axis=0)
                a /= s
            out[part[: active[lo]]] += np.log10(scales).sum(axis=0)
    return out


class Trained(NamedTuple):
    """What scoring needs: classes, the model, each class's training tokens and share of unseen words, the counts of the words
    that have classes of their own; and training tokens and distinct ones, and the tables of words."""

    classes: Classes
    model: Model
    totals: np.ndarray
    unseen: np.ndarray
    common: dict[bytes, int]
    n: int
    v: int
    blocks: DataFrame  # doc_id, text, train, block
    rest: DataFrame  # block, word, c: the words of each block without a class of their own


def train(docs: DataFrame, states: int = STATES, top_words: int = TOP_WORDS, passes: int = PASSES) -> Trained:
    """The model of the training rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), (fold(F.col("doc_id")) != 2).alias("train"), block.alias("block"))
    counts = checkpointed(block_counts(rows.repartition("block")))
    words = checkpointed(counts.groupBy("word").agg(F.sum("n").alias("c")))
    known = words.where("c > 0")
    n, v = known.agg(F.sum("c"), F.count("*")).head()
    n, v = n or 0, v or 0
    # The end token's count comes with them: it is counted like a word.
    most = known.orderBy(F.octet_length("word") > 0, F.desc("c"), "word").limit(top_words + 1).collect()
    top = {bytes(r.word): r.c for r in most if r.word} if top_words else {}
    ends = sum(r.c for r in most if not r.word)
    classes = Classes([END, *top])
    model = Model(states, classes.n)
    sequences = class_sequences(rows, classes)
    for _ in range(passes):
        model, _ = baum_welch_pass(sequences, model)
    drop_table(sequences)
    totals, once = class_totals(words, classes)
    unseen = (once + 0.5) / (totals + 1.0)
    unseen[: len(classes.top)] = 1e-9  # classes of one word
    unseen[totals == 0] = 1.0
    # Words of their own class are known to every task; each block's other words meet their counts.
    common = spark.createDataFrame([(w,) for w in classes.top], "word binary")
    rest = counts.select("block", "word").join(F.broadcast(common), "word", "left_anti").join(words, "word").select("block", "word", "c")
    return Trained(classes, model, totals, unseen, {END: ends, **top}, n, v, rows, rest)


def language_model_scores(docs: DataFrame, states: int = STATES, top_words: int = TOP_WORDS, passes: int = PASSES) -> DataFrame:
    """Scores of all documents, with held_out and train_tokens."""
    spark = docs.sparkSession
    trained = train(docs, states, top_words, passes)
    n, v, rows, rest = trained[5:]
    shared = spark.sparkContext.broadcast(trained[:5])
    names, types = arrow_schema(spark, SCORES)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        classes, model, totals, unseen, common = shared.value
        # Words of a block come about once, so their classes are not kept; there are fewer than 2^16. Batches are read one at a time.
        words = chain(common, chain.from_iterable(chunk.to_pylist() for chunk in right.column("word").chunks))
        place, kind = {}, np.empty(len(common) + right.num_rows, np.uint16)
        for i, w in enumerate(words):
            place[w], kind[i] = i, classes.find(w)
        c = np.concatenate([list(common.values()), right.column("c").to_numpy()]).astype(np.float64)
        base = np.log10((c + 1) / (n + v + 1))
        with np.errstate(divide="ignore"):
            within = np.where(c > 0, np.log10((1 - unseen[kind]) * c / np.maximum(totals[kind], 1)), np.log10(unseen[kind]))
        sequences, stats = [], []
        for chunk in left.column("text").chunks:
            for text in chunk.to_pylist():
                words = tokens(text)
                at = np.fromiter(map(place.__getitem__, words), np.int32, len(words))
                sequences.append(kind[at])
                stats.append((len(at), int((c[at] > 0).sum()), base[at].sum(), within[at].sum()))
        del place
        logs = forward(model, sequences) if sequences else np.empty(0)
        columns = list(zip(*stats, strict=True)) or [[], [], [], []]
        whole = logs + np.array(columns[3], np.float64)
        del sequences
        give_back()
        return pa.Table.from_arrays([left.column("doc_id").combine_chunks(), *(pa.array(x, t) for x, t in zip([*columns[:3], whole], types[1:], strict=True))], names)

    scored = (
        rows.select("doc_id", "text", "block").groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(score, SCORES)
    )
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return language_model_scores(docs)
