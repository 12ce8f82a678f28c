"""Exact Jaccard join of word n-gram sets, with set-relation skipping.

A document's set is its distinct word shingles. Equal sets are one class from the start; the
join runs over classes. Every set is ordered by one global order - shingles that are frequent
in the corpus last - and only its prefix is indexed: two sets with J >= t share a shingle of
their prefixes. An index list (shingle) is divided into blocks by set size, a block
covering one factor of 1/t, and a set is only taken to the blocks that it can match; within a block
the positions of the shared shingle bound the overlap, so entries too far behind are skipped.

Answers are computed from those of similar sets: first each list's sets are compared with the
centres of their block and the blocks beside it. Sets in one component need no further comparison,
and for a pair of different components the overlaps with their common centre bound the overlap of
the pair: ``|B & C| <= min(|A & B|, |A & C|) + |C| - |A & C|``, where an upper bound may stand for
the first of the overlaps. Further centres
are tried while the pairs left are many against the index's size; then all pairs left are
verified, so no link between different components is lost. Of a list, only the entries outside
its largest component are taken to the others, so a list of near copies costs no square.

Before pairs leave a list, and again before whole sets are compared, parity bitmaps bound the
overlap from above; they leave hardly any pair without a link. Sets are compared by 64-bit hashes of shingles.

Defined results: null texts and texts without words have an empty set, linked with nothing; a
text with fewer words than a shingle has its whole word sequence as one; rows without doc_id get
no component_id and link nothing; repeated rows are in the same class; rows of one doc_id with
different texts are judged by their texts; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from geopulse.llm.graph import components
from geopulse.llm.reduction import maybe_in, membership
from geopulse.llm.text import WordHash, checkpointed, drop_table, hash_words, map_rows, release, rolling, signed

SHINGLE = 4
PERCENT = 85
HEAVY_LOCAL = 2
HEAVY_TOKENS = 1 << 17
FLUSH_TOKENS = 1 << 19
COMMON = 256  # from this count on a shingle's list is no window's business
PAIRS_PER_ENTRY = 16
CENTRES = 32


def shingle_set(text: bytes | None, size: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles in lower case."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hash_words(words, cache), min(size, len(words))))


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), len(s)) - 2**63


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent of the shingles that some task saw often, with their counts: at most HEAVY_TOKENS rows.

    They only settle the order of shingles, which may be any; so the bound changes costs, not results.
    """

    def count(rows):
        cache, sets, total = WordHash(), [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(sets), return_counts=True)
            often = n >= HEAVY_LOCAL
            return zip(signed(tokens[often]).tolist(), n[often].tolist(), strict=True)

        for (text,) in rows:
            sets.append(shingle_set(text, size, cache))
            total += len(sets[-1])
            if total >= FLUSH_TOKENS:
                yield from flush()
                sets, total = [], 0
        if sets:
            yield from flush()

    counts = map_rows(docs.select(F.col("text").cast("binary")), count, "token long, n long")
    counts = checkpointed(counts.groupBy("token").agg(F.sum("n").alias("n")), 40 * docs.count())
    # The least count of which at most HEAVY_TOKENS shingles have as many: from the number of shingles for each quarter of a power of two.
    sizes = counts.groupBy(F.floor(F.log2("n") * 4).alias("k")).agg(F.count("*").alias("m"), F.min("n").alias("n")).orderBy(F.desc("k")).collect()
    total, least = 0, None
    for r in sizes:
        total += r.m
        if total > HEAVY_TOKENS:
            break
        least = r.n
    top = counts.where(F.lit(False) if least is None else F.col("n") >= least)
    got = top.toPandas().sort_values("token")
    return got["token"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


SKETCH = 8  # words of 64 bits


def parity_bits(own: np.ndarray, width: int | None = None) -> np.ndarray:
    """A bitmap in which each shingle turns one bit over: at least two bits for each, a power of two of them, or ``width``.

    The bits in which two such bitmaps differ are at most as many as the shingles that only one set has.
    """
    width = width or 1 << max(6, (2 * len(own) - 1).bit_length())
    turned = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").view(np.int64)


SKETCHES = [f"sketch_{i}" for i in range(SKETCH)]


def differing(x: Column, y: Column, percent: int) -> Column:
    """Bits in which two parity bitmaps differ; the wider one is folded to the width of the other."""
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, (F.size(c) / 2 + 1).cast("int"), (F.size(c) / 2).cast("int")), lambda a, b: a.bitwiseXOR(b))
    for _ in range(max(1, math.ceil(math.log2(100 / percent)))):
        x, y = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)


def prefixes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A row for each document: key (of doc_id and text), doc_id, n, sid (id of the set; null if empty), the prefix in the
    global order, how many of its shingles come before the common ones, and the parity bitmap, also in a fixed width."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_shingles(docs, size))

    def run(rows):
        tokens, counts = shared.value
        cache = WordHash()
        for key, doc_id, text in rows:
            s = shingle_set(text, size, cache)
            n = len(s)
            if not n:
                yield key, doc_id, 0, None, 0, [], [], []
                continue
            own = signed(s)
            weight = np.zeros(n, np.int64)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                weight = np.where(tokens[at] == own, counts[at], 0)
            order = np.lexsort((s, weight))[: prefix_length(n, percent)]
            rare = int(np.searchsorted(weight[order], COMMON))
            yield key, doc_id, n, set_id(s), rare, own[order], parity_bits(s), parity_bits(s, 64 * SKETCH)

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.col("text").cast("binary").alias("text"))
    return map_rows(keyed, run, "key long, doc_id long, n long, sid long, rare int, prefix array<long>, bits array<long>, sketch array<long>", flush=1024)


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """sid and the whole set of each document."""

    def run(rows):
        cache = WordHash()
        for (text,) in rows:
            s = shingle_set(text, size, cache)
            yield set_id(s), signed(s)

    return map_rows(docs.select(F.col("text").cast("binary")), run, "sid long, tokens array<long>", flush=1024)


class Joiner:
    """The join over classes of equal sets."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT):
        self.docs, self.size, self.percent = docs.select("doc_id", "text"), size, percent
        self.rows = checkpointed(prefixes(docs, size, percent))
        # One row for each set: the one of the least doc_id; copies are added up within tasks first.
        least = F.min(F.struct("doc_id", "n", "rare", "prefix", "bits", "sketch")).alias("r")
        self.n = self.rows.count()
        # Rows hold arrays: a tenth as many go into a file.
        self.classes = checkpointed(self.rows.where("sid is not null and doc_id is not null").groupBy("sid").agg(least).select("sid", "r.*"), 10 * self.n)
        # From here on only the classes need the arrays.
        wide, self.rows = self.rows, checkpointed(self.rows.select("key", "doc_id", "n", "sid"), self.n)
        drop_table(wide)
        block = F.floor(F.log("n") / np.log(100 / percent) + 1e-9).cast("int")
        release(docs.sparkSession)
        entries = self.classes.select("sid", "n", "rare", F.posexplode("prefix").alias("pos", "token"))
        # Lists with one set only link nothing. Those of common shingles are known to be longer, so no window holds them.
        whole = W.partitionBy("token")
        listed = entries.where("pos < rare").select("sid", "n", "pos", "token", F.min("sid").over(whole).alias("lo"), F.max("sid").over(whole).alias("hi"))
        live = listed.where("lo <> hi").select("sid", "n", "pos", "token").unionAll(entries.where("pos >= rare").select("sid", "n", "pos", "token"))
        self.live = checkpointed(live.withColumns({"block": block, "comp": F.col("sid")}), 40 * self.n)
        self.entries = self.live.count()
        wide, self.classes = self.classes, checkpointed(self.classes.drop("rare", "prefix"), 10 * self.n)
        drop_table(wide)
        release(docs.sparkSession)
        self.links: DataFrame | None = None  # a, b: links between classes, or such that join the same components
        self.labels: DataFrame | None = None  # v, label; classes without a row are on their own
        self.spent: list[DataFrame] = []  # written tables that nothing needs once the components are known
        self.answers: DataFrame | None = None  # centre, sid, overlap

    def needed(self, m: str, n: str) -> str:
        """SQL: the least overlap of sets of m and n shingles."""
        return f"cast(ceil({self.percent} * ({m} + {n}) / {100 + self.percent} - 1e-9) as long)"

    def lists(self, k: int) -> DataFrame:
        """Of each block of a list up to ``CENTRES`` centres (the least of as many parts of it, other ones in each round k), and how
        far its entries reach, and its least set: a block that reaches no further than a probe needs is skipped as a whole.
        """
        by = F.col("sid") if k == 0 else F.xxhash64("sid", F.lit(k))
        part = F.pmod(F.xxhash64("sid", F.lit(-k)), F.lit(CENTRES)).cast("int")
        centre = F.min(F.struct(by.alias("k"), "sid", "n", "pos", "comp")).alias("c")
        found = self.live.groupBy("token", "block", part.alias("part")).agg(centre, F.max(F.expr("n - pos")).alias("reach"), F.min("n").alias("least_n"))
        found = found.select(F.col("token").alias("t"), F.col("block").alias("b"), F.col("c.k").alias("by"), F.col("c.sid").alias("centre"), F.col("c.n").alias("c_n"), F.col("c.pos").alias("c_pos"), F.col("c.comp").alias("c_comp"), "reach", "least_n")
        return checkpointed(found, self.entries)

    def sizes_allow(self, m: str, n: str, p: str, q: str) -> str:
        """SQL: sets of m and n shingles, met at positions p and q, may still be a link."""
        return f"100 * least({m}, {n}) >= {self.percent} * greatest({m}, {n}) and least({m} - {p}, {n} - {q}) >= {self.needed(m, n)}"

    def verify(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For the pairs a < b, (a, b, most, near): what the bitmaps say of the overlap, and whether it allows a link; and the exact
        overlaps (a, b, overlap, m, n) of those that are near. Links are added."""
        spark = pairs.sparkSession
        one = self.classes.select(F.col("sid").alias("a"), F.col("doc_id").alias("d"), F.col("n").alias("m"), F.col("bits").alias("x"))
        two = self.classes.select(F.col("sid").alias("b"), F.col("doc_id").alias("e"), "n", F.col("bits").alias("y"))
        bound = F.floor((F.col("m") + F.col("n") - differing(F.col("x"), F.col("y"), self.percent)) / 2)
        pairs = checkpointed(pairs, self.entries)
        count = pairs.count()
        scored = pairs.join(one, "a").join(two, "b").select("a", "b", "d", "e", bound.alias("most"), (bound >= F.expr(self.needed("m", "n"))).alias("near"))
        scored = checkpointed(scored, 4 * count)
        drop_table(pairs)
        close = scored.where("near")
        count = close.count()
        ids = checkpointed(close.select("d").unionAll(close.select("e")).distinct(), 2 * count)
        # Whole sets are made again for the documents in question, and for some others that the bitmap lets through, empty ones among them.
        sets = checkpointed(set_table(maybe_in(self.docs, "doc_id", ids), self.size).where("size(tokens) > 0"))
        one = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("x"))
        two = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("y"))
        overlap = F.size(F.array_intersect("x", "y")).cast("long")
        found = close.join(one, "a").join(two, "b").select("a", "b", overlap.alias("overlap"), F.size("x").alias("m"), F.size("y").alias("n"))
        # Several documents of one set may have come through the reduction: they say the same.
        found = checkpointed(found.distinct(), 160 * count)
        for x in (ids, sets):
            drop_table(x)
        release(spark)
        links = found.where(f"100 * overlap >= {self.percent} * (m + n - overlap)").select("a", "b")
        self.links = links if self.links is None else self.links.unionAll(links)
        self.spent += [scored, found]
        return scored, found

    def compare_with_centres(self, lists: DataFrame) -> None:
        """Each entry against the centres of its own block and those beside it that are of other components."""
        entries = self.live.select("sid", "n", "pos", "token", "comp", F.explode(F.expr("array(block - 1, block, block + 1)")).alias("at"))
        met = entries.join(lists, F.expr("token = t and at = b")).where(f"comp <> c_comp and {self.sizes_allow('n', 'c_n', 'pos', 'c_pos')}")
        before, self.spent = self.spent, []
        scored, found = self.verify(met.select(F.least("sid", "centre").alias("a"), F.greatest("sid", "centre").alias("b")).distinct())
        known = found.select("a", "b", "overlap", F.col("overlap").alias("most")).unionAll(scored.where("not near").select("a", "b", F.lit(None).cast("long"), "most"))
        self.answers = known.select(F.col("a").alias("centre"), F.col("b").alias("sid"), "overlap", "most").unionAll(known.select("b", "a", "overlap", "most"))
        self.join_links()
        for x in before:  # the answers of the round before, whose links are in the labels
            drop_table(x)
        release(self.docs.sparkSession)

    def join_links(self) -> None:
        """Links found so far become components, which then stand for them."""
        self.labels = components(self.links, self.n)
        self.links = self.labels.select(F.col("v").alias("a"), F.col("label").alias("b"))

    def contested(self) -> DataFrame:
        """token and major, the component with most entries, of each list that holds several; rest: entries of the others."""
        labels = self.labels.select(F.col("v").alias("sid"), "label")
        before = self.live
        self.live = checkpointed(self.live.drop("comp", "major").join(labels, "sid", "left").withColumn("comp", F.coalesce("label", "sid")).drop("label"), self.entries)
        drop_table(before)
        each = self.live.groupBy("token", "comp").agg(F.count("*").alias("k"))
        of_list = each.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("entries"))
        return checkpointed(of_list.where("entries > most.k").select(F.col("token").alias("t"), F.col("most.comp").alias("major"), "entries", F.expr("entries - most.k").alias("rest")), self.entries)

    def run(self) -> DataFrame:
        """sid and label of all classes that are linked with others."""
        before = math.inf
        for k in itertools.count():
            lists = self.lists(k)
            self.compare_with_centres(lists)
            contested = self.contested()
            left = contested.agg(F.sum(F.expr("rest * entries"))).head()[0]
            if not left:
                return self.labels
            # Only lists with several components are looked at from now on.
            narrowed = self.live.join(contested.select(F.col("t").alias("token"), "major"), "token").drop(*SKETCHES)
            narrowed = narrowed.join(self.classes.select("sid", *(F.col("sketch")[i].alias(c) for i, c in enumerate(SKETCHES))), "sid")
            wide, self.live = self.live, checkpointed(narrowed, self.entries)
            drop_table(wide)
            # Further centres are of use only while they join components.
            if left <= PAIRS_PER_ENTRY * self.entries or left > 0.7 * before:
                break
            before = left
            drop_table(lists)
        # Pairs of one component need no comparison: so one of a pair is outside its list's largest component.
        blocks = F.expr("if(comp <=> major, array(block), array(block - 1, block, block + 1))")
        probes = self.live.select("sid", "n", "pos", "token", "comp", "block", *SKETCHES, F.expr("comp <=> major").alias("in_major"), F.explode(blocks).alias("at"))
        known = lists.groupBy("t", "b").agg(F.min(F.struct("by", "centre")).alias("c"), F.max("reach").alias("reach"), F.min("least_n").alias("least_n"))
        known = checkpointed(known.select("t", "b", "c.centre", "reach", "least_n"), self.entries)
        probes = probes.join(known, F.expr("token = t and at = b")).where(f"at = block or not in_major and least(n - pos, reach) >= {self.needed('n', 'least_n')}")
        probes = probes.drop("t", "b", "reach", "least_n").join(self.answers, ["centre", "sid"], "left")
        probes = probes.withColumns({"overlap": F.expr("if(sid = centre, n, overlap)"), "most": F.expr("if(sid = centre, n, coalesce(most, n))")})
        probes = checkpointed(probes, 3 * self.entries)
        ours = probes.where("not in_major").select(*(F.col(c).alias(f"p_{c}") for c in ("sid", "n", "pos", "token", "comp", "at", "overlap", "most", *SKETCHES)))
        others = probes.where("at = block")
        # What both share with the block's centre bounds what they share with each other.
        needed = self.needed("p_n", "n")
        bound = f"coalesce(least(p_most, overlap) + n - overlap >= {needed}, true) and coalesce(least(most, p_overlap) + p_n - p_overlap >= {needed}, true)"
        apart = " + ".join(f"bit_count(p_{c} ^ {c})" for c in SKETCHES)
        both = ours.join(others, F.expr("p_token = token and p_at = block"))
        met = both.where(f"p_comp <> comp and (in_major or p_sid < sid) and {self.sizes_allow('p_n', 'n', 'p_pos', 'pos')} and {bound} and p_n + n - ({apart}) >= 2 * {needed}")
        self.verify(met.select(F.least("p_sid", "sid").alias("a"), F.greatest("p_sid", "sid").alias("b")).distinct())
        for x in (probes, lists, known):
            drop_table(x)
        self.join_links()
        return self.labels


def with_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """key (of doc_id and text), doc_id, n_shingles and component_id."""
    joiner = Joiner(docs, size, percent)
    labels = joiner.run().select(F.col("v").alias("sid"), "label")
    known = checkpointed(joiner.classes.select("sid", "doc_id").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")), joiner.n)
    least = checkpointed(known.groupBy("label").agg(F.min("doc_id").alias("component_id")), joiner.n)
    of_set = checkpointed(known.join(least, "label").select("sid", "component_id"), joiner.n)
    for x in (known, least, joiner.live, joiner.classes, *joiner.spent):
        drop_table(x)
    release(docs.sparkSession)
    rows = joiner.rows.select("key", "doc_id", F.col("n").alias("n_shingles"), "sid").join(of_set, "sid", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("key", "doc_id", "n_shingles", own.alias("component_id"))


def similarity_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id: the least doc_id reachable by links of Jaccard >= percent / 100."""
    return with_components(docs, size, percent).drop("key")


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one document, that of least doc_id, of each component, once; all rows without doc_id stay.

    Only documents that may go, or may occur twice, are shuffled.
    """
    found = checkpointed(with_components(docs, size, percent).where("doc_id is not null").select("key", (F.col("doc_id") != F.col("component_id")).alias("gone")), docs.count())
    often = found.groupBy("key").agg(F.count("*").alias("n"), F.max("gone").alias("gone")).where("n > 1 or gone")
    often = checkpointed(often.select(F.col("key").alias("k"), "gone"), found.count())
    keyed = docs.select(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("key"), F.struct("*").alias("row"))
    may = F.coalesce(membership(often.select("k"))(F.col("key")), F.lit(False))
    some = keyed.where(may).join(often, F.expr("key = k"), "left").where("gone is null or not gone")
    once = some.where("gone is null").select("row").unionAll(some.where("gone is not null").dropDuplicates(["key"]).select("row"))
    return keyed.where(~may).select("row").unionAll(once).select("row.*")


def op3_jaccard_join(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, n_shingles, component_id."""
    return similarity_components(docs)
