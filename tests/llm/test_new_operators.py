"""Token alignment, language identification and importance resampling against plain versions."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm import COLUMNS, mixed_texts, table
from tokenizers import Tokenizer

from geopulse.llm import importance, language_id, token_alignment

SF = "/root/testdata/sf0.01"

OPERATORS = {
    "alignment": token_alignment.op11_token_alignment,
    "language": language_id.op12_language_id,
    "importance": lambda docs: importance.op13_importance(docs, docs.sparkSession.createDataFrame([(1, "the a b", "x")], "item_id long, text string, doc_id string")),
}
CONTRACT = {
    "alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "language": "doc_id held_out lang_pred score",
    "importance": "doc_id n_features weight score rank",
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_tables_nulls_and_repeated_rows(spark, name):
    run = OPERATORS[name]
    assert run(table(spark, []).where("false")).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None, None), (1, None, None, None, None, None), (None, "a b c", None, None, None, None), (1, "", "en", None, None, None)], COLUMNS)
    got = run(nulls)
    assert got.count() == 4 and got.columns[: len(CONTRACT[name].split())] == CONTRACT[name].split()
    # Columns whose names clash with those of the operators, in other places.
    clash = spark.createDataFrame([(0, 5, "x y", "a b c", "en"), (0, 5, "x y", "a b c", "en")], "rank long, doc_id long, score string, text string, lang string")
    assert len({tuple(r)[:-1] for r in run(clash).collect()}) == 1 and run(clash).count() == 2


# Token alignment.

LETTERS = "abé ñ\n\t  \r.,!0123'sßΩ漢字👍🏽　​\x00<s>"


def odd_texts():
    rng = random.Random(3)
    out = [None, "", "a", " ", "\n", "\na", "a\n\nb", " a  b", "x<|endoftext|>y <s> </s> <unk>", "▁", "a▁b", "don't we'll", "a\r\nb\r\n", "\x1c \x1d a", "  　a", "漢字仮名 交じり", "👩‍👩‍👧 ok", "é a"]
    out += [" " * 5000 + "x", "x" * 3000, "ab " * 100, "ab " * 100]
    return out + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60))) for _ in range(600)]


class PlainAlignment:
    """Both tokenizers over whole texts, and groups and links from byte offsets."""

    def __init__(self):
        self.one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.one.encode_special_tokens = True
        self.two = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        # Byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        rest = [b for b in range(256) if b not in own]
        self.byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}

    def __call__(self, text):
        if not text:
            return None
        a, b = self.one.encode(" " + text, add_special_tokens=False).ids, self.two.encode(text)
        sides = [bytes(self.byte[c] for c in self.one.id_to_token(i)) for i in a], [bytes([int(self.two.id_to_piece(i)[3:5], 16)]) if self.two.is_byte(i) else self.two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if any(b"".join(s) != (" " + text).encode() for s in sides):
            return None
        ends = [np.cumsum([len(x) for x in s]) for s in sides]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
            k, m = int(np.searchsorted(ends[0], e)) + 1, int(np.searchsorted(ends[1], e)) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        links = []
        for k, end in enumerate(ends[0].tolist()):
            start = end - len(sides[0][k])
            links += [(a[k], b[m]) for m in range(int(np.searchsorted(ends[1], start, side="right")), int(np.searchsorted(ends[1] - [len(x) for x in sides[1]], end)))]
        return a, b, groups, links


@pytest.fixture(scope="module")
def plain_alignment():
    return PlainAlignment()


def test_alignment_against_plain_version(spark, plain_alignment, monkeypatch):
    """Odd texts and a third of a table in several partitions, with small segments and blocks."""
    texts = odd_texts() + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 3 = 0").collect()]
    want = [plain_alignment(t) for t in texts]
    held, top = collections.Counter(), collections.Counter()
    for w in want:
        held.update(set(w[3]) if w else ())
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    for parts, block, segment in ((1, 1 << 24, 1 << 16), (7, 1 << 16, 50)):
        monkeypatch.setattr(token_alignment, "BLOCK_BYTES", block)
        monkeypatch.setattr(token_alignment, "SEGMENT", segment)
        got = {r.doc_id: r for r in token_alignment.op11_token_alignment(table(spark, texts).repartition(parts)).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(want):
            r = got[i]
            if w is None:
                assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
                continue
            a, b, groups, links = w
            digest = hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
            assert tuple(r)[1:] == (len(a), len(b), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), digest), texts[i]
    pairs = {(r.a, r.b): (r.n, r.best) for r in token_alignment.linked_pairs(table(spark, texts)).collect()}
    assert pairs == {p: (n, n == top[p[0]]) for p, n in held.items()}


def test_alignment_groups(spark, plain_alignment):
    texts = odd_texts()[:80]
    got = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in token_alignment.alignments(table(spark, texts)).collect()}
    assert all(got[i] == (w[2] if w else []) for i, w in ((i, plain_alignment(t)) for i, t in enumerate(texts)))


def test_transducer_states():
    """Residuals, sides, failures and remembered transitions on a small vocabulary."""
    t = token_alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"abcd"])
    assert t.transition(False, b"", 0) == (True, b"ab")
    assert t.transition(True, b"ab", 0) == (True, b"b") and t.transition(True, b"b", 1) == (False, b"c")
    assert t.transition(False, b"c", 1) == (False, b"") and t.transition(True, b"ab", 1) is None
    assert t.transition(True, b"abc", 2) == (False, b"d")
    assert set(t.after) == {(False, b"", 0), (True, b"ab", 0), (True, b"b", 1), (False, b"c", 1), (True, b"ab", 1), (True, b"abc", 2)}


# Language identification.


def plain_grams(text):
    s = re.sub(" +", " ", " " + "".join(c.lower()[0] if unicodedata.category(c)[0] in "LM" else " " for c in text) + " ")
    return [s[i : i + n] for n in range(1, 5) for i in range(len(s) - n + 1) if s[i : i + n] != " "] if text else []


@pytest.mark.parametrize("piece", [1, 3, 1 << 18])
def test_grams_against_plain_version(piece, monkeypatch):
    monkeypatch.setattr(language_id, "PIECE", piece)
    rng = random.Random(2)
    known: dict[int, str] = {}
    for _ in range(150):
        text = "".join(rng.choice("aBé ß.1\nǅ́") for _ in range(rng.randint(0, 25)))
        got = [h for points, n in language_id.symbols(text.encode()) for x in language_id.grams(points, n) for h in x.tolist()]
        want = plain_grams(text)
        assert sorted(collections.Counter(got).values()) == sorted(collections.Counter(want).values())
        if piece > 100:
            for h, g in zip(got, want, strict=True):
                assert known.setdefault(h, g) == g


def test_language_model_and_predictions_against_plain_version(spark):
    """Counts, sets and decisions of the query with Python sets, up to what the filter hits by chance."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    trains = lambda i: zlib.crc32(str(i).encode()) % 4 != 2
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if trains(r.doc_id) and r.text is not None and r.lang is not None:
            for g in plain_grams(r.text):
                counts[r.lang, len(g)][g] += 1
    langs = sorted({k for k, _ in counts})
    sets = {k: set() for k in langs}
    for n in range(1, 5):
        total = {k: sum(counts[k, n].values()) for k in langs}
        for g in set().union(*(counts[k, n] for k in langs)):
            rate = {k: counts[k, n][g] / total[k] for k in langs}
            for k in langs:
                if rate[k] >= language_id.MIN_RATE and rate[k] >= language_id.SHARE * max(rate.values()):
                    sets[k].add(g)
    model = language_id.learn(docs.where(language_id.in_training(docs.doc_id)).select("text", "lang"))
    assert model.languages == langs and (model.chance < 0.02).all()
    got = {r.doc_id: r for r in language_id.op12_language_id(docs).collect()}
    right = 0
    for r in rows:
        text, g = r.text or "", plain_grams(r.text or "")
        p = got[r.doc_id]
        assert p.held_out != trains(r.doc_id)
        if not any(c.isalpha() for c in text):
            assert (p.lang_pred, p.score) == ("und", 0.0)
            continue
        hits = sorted(((sum(x in sets[k] for x in g), k) for k in langs), key=lambda x: (-x[0], x[1]))
        assert p.n_grams == len(g)
        if hits[0][0] - hits[1][0] > 0.05 * len(g) + 3:
            assert p.lang_pred == hits[0][1]
            assert p.score == pytest.approx(hits[0][0] / (hits[0][0] + hits[1][0]), abs=0.03)
        right += p.held_out and p.lang_pred == r.lang
    held = [r for r in rows if not trains(r.doc_id) and r.lang is not None]
    assert right >= 0.98 * len(held)


def test_language_edge_cases(spark):
    texts = ["the cat and the dog", "der hund und die katze", "12 !?", "", None, "ωψξ", "the cat"]
    docs = table(spark, texts).withColumn("lang", F.expr("get(array('en', 'de', null, 'en', 'de', null, 'en'), int(doc_id))"))
    model = language_id.learn(docs)
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()}
    assert got[0][0] == got[6][0] == "en" and got[1][0] == "de" and got[2] == got[3] == got[4] == ("und", 0.0)
    assert got[5] == ("en", 0.0)  # nothing known: most training rows
    assert language_id.learn(docs.where("lang is null")) is None
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_many_languages(spark):
    """More languages than bits of a byte and of a word: each text finds its own."""
    rng = random.Random(5)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for _ in range(70)]
    texts = [" ".join(w) for w in words]
    docs = spark.createDataFrame([(i, t, f"l{i:02}") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert model.slots.shape[1] == 2
    got = {r.row.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    assert got == {i: f"l{i:02}" for i in range(70)}
    assert len(language_id.learn(docs, max_languages=9).languages) == 9


def test_popcounts():
    masks = np.random.default_rng(0).integers(0, 2**63, (500, 2)).astype(np.uint64)
    want = [sum(int(m[i // 64]) >> (i % 64) & 1 for m in masks) for i in range(100)]
    assert language_id.popcounts(masks, 100).tolist() == want


# Importance resampling.

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    words = WORD.findall((text or "").encode().lower())
    return len(words), [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("slice_bytes", [5, 40, 1 << 20])
def test_word_runs_against_plain_version(slice_bytes, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", slice_bytes)
    rng = random.Random(1)
    texts = [None, "", "a", "Ab cD", "é x y", "zz" * 200 + " q " + "ab" * 40, " ", "end", "start no", "A-b_c`{}z9 10", *mixed_texts()]
    texts += ["".join(rng.choice("ab é.\n") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    column = pa.array(["skipped", *texts], pa.string())[1:]
    data, offsets = importance.buffers(column)
    words, found = np.zeros(len(texts), int), [[] for _ in texts]
    for first, part, upto in importance.slices(data, offsets):
        n, runs = importance.word_runs(data, part, upto=upto)
        words[first : first + len(n)] += n
        for text, bucket in runs:
            for t, b in zip(text.tolist(), bucket.tolist(), strict=True):
                found[first + t].append(b)
    for i, t in enumerate(texts):
        n, features = plain_features(t)
        assert words[i] == n and sorted(found[i]) == sorted(zlib.crc32(f) % 10_000 for f in features)


def test_importance_against_plain_version(spark):
    """Odd rows: nulls, repeated rows, short and long texts, two rows with the same id."""
    texts = [*mixed_texts(), *("some words of text " * k for k in range(30)), "the same text " * 9, "the same text " * 9]
    ids = [*range(len(texts) - 1), len(texts) - 2]
    bench = [(1, "some words"), (2, None), (3, "The quick brown fox"), (4, "")]
    docs, target = table(spark, texts, ids), spark.createDataFrame(bench, "item_id long, text string")
    s, t = np.zeros(10_000), np.zeros(10_000)
    for counts, rows in ((s, texts), (t, [x for _, x in bench])):
        for x in rows:
            for f in plain_features(x)[1]:
                counts[zlib.crc32(f) % 10_000] += 1
    gain = np.floor(1000 * np.log((t + 1) * (s.sum() + 10_000) / ((s + 1) * (t.sum() + 10_000))))
    want = []
    for i, x in zip(ids, texts, strict=True):
        n, features = plain_features(x)
        weight = int(sum(gain[zlib.crc32(f) % 10_000] for f in features))
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in want if r[5] >= 20), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[4] = rank
    got = [tuple(r) for r in importance.op13_importance(docs.repartition(5), target).collect()]
    assert sorted(got, key=str) == sorted((tuple(r[:5]) for r in want), key=str) and sum(r[4] is not None for r in want) == 1
    half = importance.resampled(docs, target, percent=50).where("rank is not null")
    assert sorted(r["rank"] for r in half.collect()) == list(range(1, len(able) // 2 + 1))
    kept = importance.resample(docs, target, percent=50)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in able[: len(able) // 2]}


def test_words_that_come_once_are_not_kept():
    from geopulse.llm.hmm import Classes

    classes = Classes([b"", b"the"])
    found = [classes.find(w) for w in (b"", b"the", b"other")]
    assert not classes and found == classes.of([b"", b"the", b"other"]).tolist()


def test_join_keeps_arrays_only_where_they_are_needed(spark):
    from geopulse.llm.jaccard_join import Joiner

    joiner = Joiner(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string"))
    assert joiner.rows.columns == ["key", "doc_id", "n", "sid"] and joiner.rows.count() == 3
    assert joiner.classes.columns == ["sid", "doc_id", "n", "bits", "sketch"]
