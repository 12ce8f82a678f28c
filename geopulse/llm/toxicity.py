"""Toxicity: a learned lexicon, matched by Levenshtein automata over its trie, weighed by context.

The lexicon is learned from labelled training rows (at most ``MAX_LABELLED`` of them, by the hash
of their id): words and word stems that toxic texts have far more often than others. A
stem takes the place of its words where it has many endings. All entries' Levenshtein automata
(one edit, swaps included, for entries of 5 or more letters) run at once over the trie as one
automaton whose states are made when they are first met. Each entry weighs as much as the
training rows say: by the share of toxic ones among the texts with exact hits, or with hits
that are misspelled only.

A hit's context window separates quotation from abuse: within quotation marks, or beside a
reporting word, it counts for ``QUOTED`` of its weight. Reporting words are learned in every
language: those that stand beside hits in several training texts, hardly any of them toxic. The score is
``1 - product(1 - weight * context)`` over the hits.

Defined results: null and empty texts score 0; without labelled toxic rows the lexicon is empty
and all scores are 0; a document with contrary labels counts as toxic; labels of documents that
don't exist, and null labels, are ignored; repeated rows get the same score; a missing doc_id
counts as the empty text for the choice of training rows.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.llm.text import checkpointed, map_rows, struct_udf

MAX_LABELLED = 20_000
LEXICON_SIZE = 512
MIN_TOXIC = 5
MIN_SHARE = 0.01  # of the toxic training texts
MIN_RATIO = 20.0
STEMS = range(4, 9)
CONTEXT = 8
QUOTED = 0.25
THRESHOLD = 0.3
PRIOR_MISSPELLED = 0.6
BESIDE = 3
REPORTING_SIZE = 256
MIN_REPORTS = 5
MOST_TOXIC = 0.1
# Marks around quotations.
QUOTES = "\"'“”„«»‘’‹›"
EDGE = "".join(map(chr, range(33, 48))) + "0123456789" + ":;<=>?@[\\]^_`{|}~" + QUOTES + "…–—¡¿"


def plain(word: bytes) -> str:
    """The word in lower case without marks and digits at its ends."""
    return word.decode("utf-8", "replace").lower().strip(EDGE)


def in_training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 != 2


class Automaton:
    """The entries' Levenshtein automata intersected with their trie; states are made on demand.

    A position is (node, edits, swapped letter still to come). entries: (letters, is a stem).
    """

    MAX_STATES = 20_000

    def __init__(self, entries: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.reach = [0]  # edits that some entry below may have
        self.most = [1 if len(e) >= 5 else 0 for e, _ in entries]
        for i, (letters, is_stem) in enumerate(entries):
            node = 0
            self.reach[0] = max(self.reach[0], self.most[i])
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], self.most[i])
            (self.stem if is_stem else self.word)[node] = i
        self.clear()

    def clear(self) -> None:
        self.start = self.closed({(0, 0, "")})
        self.steps: dict[frozenset, dict[str, frozenset]] = {}

    def closed(self, positions: set) -> frozenset:
        """With the positions reached by leaving out letters of an entry."""
        todo = list(positions)
        while todo:
            node, edits, wait = todo.pop()
            if not wait and edits < self.reach[node]:
                for child in self.children[node].values():
                    new = (child, edits + 1, "")
                    if edits + 1 <= self.reach[child] and new not in positions:
                        positions.add(new)
                        todo.append(new)
        return frozenset(positions)

    def next(self, state: frozenset, c: str) -> frozenset:
        to = set()
        for node, edits, wait in state:
            if wait:
                if wait == c:
                    to.add((node, edits, ""))
                continue
            children = self.children[node]
            if c in children:
                to.add((children[c], edits, ""))
            if edits < self.reach[node]:
                to.add((node, edits + 1, ""))
                for a, child in children.items():
                    if a != c and edits < self.reach[child]:
                        to.add((child, edits + 1, ""))
                        after = self.children[child].get(c)
                        if after is not None and edits < self.reach[after]:
                            to.add((after, edits + 1, a))
        return self.closed(to)

    def accepted(self, state: frozenset, ends: list[int]) -> tuple[int, int] | None:
        """(edits, entry) of the best entry that a state stands for."""
        found = [(e, ends[n]) for n, e, wait in state if not wait and ends[n] >= 0 and e <= self.most[ends[n]]]
        return min(found, default=None)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, entry) of the nearest entry; stems match the beginning of a word."""
        state, best = self.start, None
        for c in word:
            steps = self.steps.get(state)
            if steps is None:
                if len(self.steps) >= self.MAX_STATES:
                    self.clear()
                steps = self.steps[state] = {}
            after = steps.get(c)
            if after is None:
                after = steps[c] = self.next(state, c)
            state = after
            if not state:
                return best
            stem = self.accepted(state, self.stem)
            if stem and (best is None or stem < best):
                best = stem
        whole = self.accepted(state, self.word)
        return whole if best is None or whole and whole < best else best


class Matcher:
    """Word -> hit, remembered for the words met."""

    LIMIT = 300_000

    def __init__(self, entries: list[tuple[str, bool]]):
        self.automaton, self.known = Automaton(entries), {}

    def __call__(self, word: bytes) -> tuple[int, int] | None:
        known = self.known
        if word in known:
            return known[word]
        if len(known) >= self.LIMIT:
            known.clear()
        hit = known[word] = self.automaton.match(plain(word))
        return hit


def labelled(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(text, toxic) of the labelled training rows; their ids are at most ``limit`` rows, which are broadcast."""
    rows = labels.where(in_training(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(rows), "doc_id").select("text", "toxic")


Lexicon = tuple[list[tuple[str, bool, float, float]], frozenset]


def learn_lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> Lexicon:
    """Entries (letters, is a stem, weight of an exact hit, weight of a misspelled hit), and the reporting words."""

    def count(it):
        seen: Counter = Counter()
        n = [0, 0]
        for text, toxic in it:
            toxic = int(bool(toxic))
            n[toxic] += 1
            features = set()
            for word in set((text or b"").lower().split()):
                word = plain(word)
                if len(word) >= 4:
                    features.add(word + "$")
                    features.update(word[:k] for k in STEMS if k <= len(word))
            seen.update((f, toxic) for f in features)
            if len(seen) > 300_000:
                yield from ((f, t, c) for (f, t), c in seen.items())
                seen.clear()
        yield from ((f, t, c) for (f, t), c in seen.items())
        yield from (("", t, c) for t, c in enumerate(n))

    counts = map_rows(rows, count, "feature string, toxic int, n long").groupBy("feature").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n0")
    )
    counts = checkpointed(counts)
    total = counts.where("feature = ''").head()
    if total is None or not total.n1:
        return [], frozenset()
    ratio = (F.col("n1") / total.n1) / ((F.col("n0") + 0.5) / max(total.n0, 1))
    marked = counts.where((F.col("feature") != "") & (F.col("n1") >= max(MIN_TOXIC, MIN_SHARE * total.n1)) & (ratio >= MIN_RATIO))
    # At most a few features for each entry come to the driver.
    found = {r.feature: r.n1 for r in marked.orderBy(F.desc("n1"), "feature").limit(16 * size).collect()}
    entries: list[tuple[str, bool]] = []
    for feature, n1 in sorted(found.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        letters = feature.rstrip("$")
        if len(entries) >= size or any(letters.startswith(e) for e, stem in entries if stem) or (letters, False) in entries:
            continue
        if feature.endswith("$"):
            # Drop a word whose stem has many other endings: the stem comes for it.
            if not any(found.get(letters[:k], 0) > 1.5 * n1 for k in STEMS if k < len(letters)):
                entries.append((letters, False))
        else:
            # The longest stem with nearly all of the shortest one's texts, unless it is one word's beginning only.
            longer = [f for f, n in found.items() if not f.endswith("$") and f.startswith(letters) and n >= 0.9 * n1]
            word = any(f.endswith("$") and f.startswith(letters) and n >= 0.67 * n1 for f, n in found.items())
            if not word:
                entries.append((max(longer, key=len), True))
    return weighed(rows, entries)


def weighed(rows: DataFrame, entries: list[tuple[str, bool]]) -> Lexicon:
    """The entries with weights from the labelled rows' exact hits, and from those hit by misspellings only; the words beside hits."""

    def count(it):
        matcher, seen = Matcher(entries), Counter()
        for text, toxic in it:
            words = (text or b"").lower().split()
            at = [(i, h) for i, h in enumerate(map(matcher, words)) if h]
            exact = {i for _, (e, i) in at if e == 0}
            seen.update({(i, e, int(bool(toxic)), "") for _, (e, i) in at if e == 0 or not exact})
            near = {plain(words[k]) for i, _ in at for k in range(max(0, i - BESIDE), min(len(words), i + BESIDE + 1)) if not matcher(words[k])}
            seen.update((-1, 0, int(bool(toxic)), w) for w in near if w)
            if len(seen) > 300_000:
                yield from ((*k, n) for k, n in seen.items())
                seen.clear()
        yield from ((*k, n) for k, n in seen.items())

    counts = map_rows(rows, count, "entry int, edits int, toxic int, word string, n long").groupBy("entry", "edits", "toxic", "word").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    n = {(r.entry, r.edits, r.toxic): r.n for r in counts.where("entry >= 0").collect()}
    beside = counts.where("entry < 0").groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("toxic")).alias("n1"))
    beside = beside.where((F.col("n") >= MIN_REPORTS) & (F.col("n1") <= MOST_TOXIC * F.col("n"))).orderBy(F.desc("n"), "word").limit(REPORTING_SIZE)

    def share(i: int, edits: int, prior: float) -> float:
        toxic, other = n.get((i, edits, 1), 0), n.get((i, edits, 0), 0)
        weight = (toxic + 2 * prior) / (toxic + other + 2)
        return weight if weight >= 0.5 else 0.0  # many weak hits don't make a strong one

    return [(e, stem, share(i, 0, 0.9), share(i, 1, PRIOR_MISSPELLED)) for i, (e, stem) in enumerate(entries)], frozenset(r.word for r in beside.collect())


def quoted(words: list[bytes], i: int, reporting: frozenset) -> bool:
    """Whether the word stands in quotation marks that open and close near it, or beside a reporting word."""
    before = [w.decode("utf-8", "replace") for w in words[max(0, i - CONTEXT) : i]]
    after = [w.decode("utf-8", "replace") for w in words[i + 1 : i + 1 + CONTEXT]]
    own = words[i].decode("utf-8", "replace")
    opens = own[0] in QUOTES
    for w in reversed(before):
        if opens or w[-1] in QUOTES and w[0] not in QUOTES:
            break
        opens = w[0] in QUOTES and w[-1] not in QUOTES
    closes = own.rstrip(".,;:!?")[-1:] in tuple(QUOTES)
    for w in after:
        if closes or w[0] in QUOTES:
            break
        closes = w.rstrip(".,;:!?")[-1:] in tuple(QUOTES)
    return opens and closes or any(w.strip(EDGE) in reporting for w in before[-BESIDE:] + after[:BESIDE])


def score(text: bytes | None, matcher, weights: list[tuple[float, float]], reporting: frozenset) -> tuple[float, int]:
    """Score and number of hits."""
    words = (text or b"").lower().split()
    left, hits = 1.0, 0
    for i, hit in enumerate(map(matcher, words)):
        if hit:
            hits += 1
            left *= 1 - weights[hit[1]][hit[0]] * (QUOTED if quoted(words, i, reporting) else 1)
    return 1 - left, hits


def scorer(learned: Lexicon):
    """score(text) with the automaton made once in each Python worker."""
    made = []
    lexicon, reporting = learned

    def run(text: bytes | None) -> tuple[float, int]:
        if not lexicon:
            return 0.0, 0
        if not made:
            made.append(Matcher([x[:2] for x in lexicon]))
        return score(text, made[0], [x[2:] for x in lexicon], reporting)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, size: int = LEXICON_SIZE) -> DataFrame:
    """The rows of docs as a struct ``row``, with score and hits."""
    lexicon = learn_lexicon(labelled(docs, labels, limit), size)
    udf = struct_udf(docs.sparkSession, partial(scored, run=scorer(lexicon)), "score double, hits long")
    return docs.select(F.struct("*").alias("row"), udf(F.col("text").cast("binary")).alias("s")).select("row", "s.*")


def scored(text: bytes | None, run) -> tuple[float, int]:
    return run(text)


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest: doc_id, held_out, score, predicted, hits."""
    found = toxicity(docs.select("doc_id", "text"), labels)
    return found.select(
        "row.doc_id",
        (~in_training(F.col("row.doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "hits",
    )
