"""Language identification by bit-sliced Bloom filters over character n-grams.

Texts become letters in lower case with one blank between, before and after words. Counts of all
runs of 1 to ``LONGEST`` characters are added up in Spark for each language of the training rows.
A language's filter gets the n-grams that make up at least ``MIN_RATE`` of its runs of that length
(so at most 1 / MIN_RATE of each length), where no other language has them more than 1 /
``SHARE`` times as often. The filters of all languages have the same slots and hashes and are kept
slot by slot, a bit for each language: the conjunction of an n-gram's slots is the set of all
languages that contain it, found by one lookup for each hash, whatever the number of languages.

A text's hits in a language are the popcount of its bit over the text's n-grams. Of n lookups, n * f
hit by chance at a false positive rate of f, which the filter's fill gives, so ``(hits - n * f) /
(1 - f)`` is counted. The language with the highest count is predicted, the score is its count over
its and the runner-up's.

A model's size is bounded by ``MAX_SLOTS`` and ``MAX_LANGUAGES`` (those with most training rows,
should a table have more values of lang), so it may come to the driver and be broadcast; the counts never do.

Defined results: a null text, and one without a letter, is ``und`` with score 0, and so is every
text where there are no training rows; a text none of whose n-grams is known is the language with
most training rows, with score 0; ties go to the first language by name; rows without lang teach
nothing; repeated rows count each and get the same result; invalid bytes and marks are no letters;
further columns are kept in ``row``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, partial
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.llm.text import MULT, checkpointed, drop_table, map_rows, mix, signed, struct_udf

LONGEST = 4
MIN_RATE = 1e-5
SHARE = 0.25
HASHES = 3
SLOT_BITS = 21  # of the largest filter; HASHES * SLOT_BITS bits of a hash are used
MAX_SLOTS = 1 << SLOT_BITS
SLOTS_PER_GRAM = 16
MAX_LANGUAGES = 256
PIECE = 1 << 18  # characters worked off at once
BUFFER = 1 << 22  # n-grams counted at once
UNKNOWN = "und"
LETTER = np.uint32(1 << 31)


def in_training(doc_id: Column) -> Column:
    """Whether a row teaches: its id's remainder is not 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 != 2


@cache
def characters() -> np.ndarray:
    """For each code point: 0 where it is no part of a word, else its lower case, with LETTER set for letters."""
    out = np.zeros(0x110000, np.uint32)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LM":
            out[point] = ord(chr(point).lower()[0]) | (LETTER if kind == "L" else 0)
    return out


def symbols(text: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """The text's characters in pieces, each after the last LONGEST - 1 of the one before; their number."""
    carry = np.zeros(0, np.uint32)
    text = text.decode("utf-8", "replace")
    for i in range(0, len(text), PIECE):
        points = characters()[np.frombuffer(text[i : i + PIECE].encode("utf-32-le", "replace"), np.uint32)]
        if i == 0:
            points = np.concatenate([np.zeros(1, np.uint32), points])
        if i + PIECE >= len(text):
            points = np.append(points, np.uint32(0))
        before = np.concatenate([carry[-1:] if len(carry) else np.ones(1, np.uint32), points[:-1]])
        points = np.concatenate([carry, points[(points > 0) | (before > 0)]])
        yield points, len(carry)
        carry = points[-(LONGEST - 1) :] if LONGEST > 1 else points[:0]


def grams(points: np.ndarray, known: int) -> list[np.ndarray]:
    """64-bit hashes of the runs of each length that end after the first ``known`` characters."""
    points = (points & ~LETTER).astype(np.uint64) + np.uint64(1)
    out, h = [], np.zeros(len(points) + 1, np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, LONGEST + 1):
            h = h[:-1] * MULT + points[n - 1 :] if len(points) >= n else h[:0]
            new = slice(max(0, known - n + 1), None)
            # A blank alone is no n-gram.
            out.append(mix(h[new] if n > 1 else h[new][points[new] > 1]))
    return out


def tallied(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each occurs."""
    if counts is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes, kind="stable")
        hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.diff(np.append(first, len(hashes))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts


class Tally:
    """Counts of n-grams of one language and length, in bounded memory."""

    def __init__(self):
        self.raw, self.size, self.hashes, self.counts = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.raw.append(hashes)
        self.size += len(hashes)

    def settle(self) -> None:
        """Count what was added."""
        new, n = tallied(np.concatenate([np.zeros(0, np.uint64), *self.raw]))
        self.hashes, self.counts = tallied(np.concatenate([self.hashes, new]), np.concatenate([self.counts, n]))
        self.raw, self.size = [], 0


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, length, gram, n), and for gram null the number of rows, of rows(text, lang)."""

    def count(it):
        tallies: dict[tuple[str, int], Tally] = {}
        texts: dict[str, int] = {}
        waiting = 0

        def counted():
            for (lang, n), tally in tallies.items():
                tally.settle()
                yield from ((lang, n, g, c) for g, c in zip(signed(tally.hashes).tolist(), tally.counts.tolist(), strict=True))
            tallies.clear()

        for text, lang in it:
            texts[lang] = texts.get(lang, 0) + 1
            for points, known in symbols(text):
                for n, hashes in enumerate(grams(points, known), 1):
                    tallies.setdefault((lang, n), Tally()).add(hashes)
                    waiting += len(hashes)
                if waiting >= BUFFER:
                    for tally in tallies.values():
                        tally.settle()
                    waiting = 0
                    if sum(len(tally.hashes) for tally in tallies.values()) >= BUFFER // 2 or len(tallies) > 4096:
                        yield from counted()
        yield from counted()
        yield from ((lang, 0, None, c) for lang, c in texts.items())

    found = map_rows(rows, count, "lang string, length int, gram long, n long", 1 << 16)
    return found.groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    """Languages by name, the filter (slots x words of 64 bits, or of fewer where that is enough), false positive rates, most frequent language."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray
    default: int


def slot_numbers(hashes: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of n-grams under each hash: separate bits of their 64."""
    return [((hashes >> np.uint64(SLOT_BITS * j)) & np.uint64(slots - 1)).astype(np.int64) for j in range(HASHES)]


def learn(docs: DataFrame, max_languages: int = MAX_LANGUAGES, min_rate: float = MIN_RATE, share: float = SHARE) -> Model | None:
    """The model of docs(text, lang); None where no row has both."""
    spark = docs.sparkSession
    rows = docs.where("text is not null and lang is not null").select(F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = checkpointed(gram_counts(rows))
    most = {r.lang: r.n for r in counts.where("length = 0").orderBy(F.desc("n"), "lang").limit(max_languages).collect()}
    if not most:
        return None
    languages = sorted(most)
    numbers = spark.createDataFrame(list(enumerate(languages)), "language int, lang string")
    totals = counts.where("length > 0").groupBy("lang", "length").agg(F.sum("n").alias("total"))
    rates = counts.where("length > 0").join(F.broadcast(totals.join(F.broadcast(numbers), "lang")), ["lang", "length"]).withColumn("rate", F.col("n") / F.col("total"))
    # The languages of one n-gram: at most max_languages entries.
    sets = rates.groupBy("length", "gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("language", "rate")).alias("of"))
    chosen = F.filter("of", lambda x: (x["rate"] >= min_rate) & (x["rate"] >= share * F.col("top")))
    sets = checkpointed(sets.select("gram", chosen["language"].alias("languages")).where(F.size("languages") > 0))
    largest = sets.select(F.explode("languages").alias("language")).groupBy("language").count().agg(F.max("count")).head()[0] or 1
    slots = min(MAX_SLOTS, max(1 << 10, 1 << (SLOTS_PER_GRAM * largest - 1).bit_length()))
    places = F.array(*(F.shiftrightunsigned("gram", SLOT_BITS * j).bitwiseAND(slots - 1) for j in range(HASHES)))
    bits = sets.select("languages", F.explode(places).alias("slot")).select("slot", F.explode("languages").alias("language"))
    mask = F.expr("bit_or(shiftleft(1L, language % 64))")
    found = bits.groupBy("slot", F.floor(F.col("language") / 64).alias("word")).agg(mask.alias("mask")).toPandas()
    table = np.zeros((slots, -(-len(languages) // 64)), np.uint64)
    table[found["slot"].to_numpy(np.int64), found["word"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    drop_table(counts)
    drop_table(sets)
    fill = np.array([int(np.count_nonzero(table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))) for i in range(len(languages))]) / slots
    if len(languages) <= 8:
        table = table.astype(np.uint8)
    return Model(languages, table, fill**HASHES, languages.index(max(sorted(most), key=most.get)))


BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def popcounts(masks: np.ndarray, languages: int) -> np.ndarray:
    """How many of the masks (n-grams x words) have each language's bit."""
    parts = np.ascontiguousarray(masks).view(np.uint8).reshape(len(masks), masks.shape[1] * masks.itemsize)
    counts = [np.bincount(parts[:, k], minlength=256) @ BITS for k in range(-(-languages // 8))]
    return np.concatenate(counts)[:languages]


def identify_text(text: bytes | None, model: Model | None) -> tuple[str, float, int]:
    """Language, score and number of n-grams."""
    hits, n, letters = 0, 0, False
    for points, known in symbols(text or b""):
        letters = letters or bool((points[known:] & LETTER).any())
        if model is None:
            continue
        for hashes in grams(points, known):
            first, *more = slot_numbers(hashes, len(model.slots))
            masks = model.slots[first]
            for at in more:
                masks &= model.slots[at]
            hits = hits + popcounts(masks, len(model.languages))
            n += len(hashes)
    if not letters or model is None:
        return UNKNOWN, 0.0, n
    counts = np.maximum(hits - n * model.chance, 0) / np.maximum(1 - model.chance, 1e-9)
    best = int(np.argmax(counts))
    if counts[best] <= 0:
        return model.languages[model.default], 0.0, n
    second = max(np.delete(counts, best), default=0.0)
    return model.languages[best], float(counts[best] / (counts[best] + second)), n


def identified(text: bytes | None, shared) -> tuple[str, float, int]:
    return identify_text(text, shared.value)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs as a struct ``row``, with lang_pred, score and n_grams."""
    spark = docs.sparkSession
    udf = struct_udf(spark, partial(identified, shared=spark.sparkContext.broadcast(model)), "lang_pred string, score double, n_grams long")
    return docs.select(F.struct("*").alias("row"), udf(F.col("text").cast("binary")).alias("s")).select("row", "s.*")


def op12_language_id(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, held_out, lang_pred, score, n_grams."""
    model = learn(docs.where(in_training(F.col("doc_id"))).select("text", "lang"))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("row.doc_id", (~in_training(F.col("row.doc_id"))).alias("held_out"), "lang_pred", "score", "n_grams")
