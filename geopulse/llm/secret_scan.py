"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The patterns give the spans ``assign``, ``access`` and ``hex``. The method adds spans of kind
``novel``: a run of 16 or more token characters, with digits and letters, that has a sensitive
word shortly before it and no pattern span over it, is compressed together with the code around
it by a zstandard compressor primed with the corpus's identifiers. Its marginal bytes,
``size(context + candidate) - size(context)``, over its length are its novelty: names and
repeated material cost a few bytes, random strings about as many as they have.

The identifier dictionary comes from a count over all documents of names that stand before
``=``, ``:`` or ``(``; its size is a parameter, so what the driver gets is bounded.

Defined results: a null text is empty; an empty text has no spans; offsets are code points of
the text (an invalid byte counts as one); repeated rows each get their own result; the order of
spans is by start, then kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from functools import partial
from itertools import accumulate

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.text import map_rows, struct_udf

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # shorter maximal runs would be dropped anyway
IDENTIFIER = re.compile(rb"\b([A-Za-z_][A-Za-z0-9_]{2,40}) ?[=:(]")
SENSITIVE = re.compile(rb"key|secret|token|passw|pwd|auth(?!or(?!i[sz]))|bearer|cred|private|signature|session|salt|access")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
AROUND = 256
BEFORE = 48
NOVELTY = 0.7
DICTIONARY_SIZE = 4096

Span = tuple[int, int, int, int]  # start, kind, end, start of the value; bytes


def base_spans(text: bytes) -> list[Span]:
    """Spans of the patterns: leftmost and non-overlapping for each kind, failing matches dropped."""
    # Group 2 has the letters of either case, so matching in lower case gives the same matches.
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text.lower()) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return found


def novelty(text: bytes, start: int, end: int, size) -> float:
    """Marginal compressed bytes of text[start:end] over its length."""
    around = text[max(0, start - AROUND) : start] + b"\n" + text[end : end + AROUND] + b"\n"
    return (size(around + text[start:end]) - size(around)) / (end - start)


def novel_spans(text: bytes, base: list[Span], size, threshold: float) -> list[Span]:
    """Incompressible candidates in a sensitive context, outside the base spans."""
    found, after = [], 0
    starts = [s for s, *_ in sorted(base)]
    # How far the spans reach that begin up to each of them.
    reached = list(accumulate((e for _, _, e, _ in sorted(base)), max))
    # A candidate needs a sensitive word before it, so only what follows such words is looked at.
    lower = text.lower()
    for word in SENSITIVE.finditer(lower):
        for m in CANDIDATE.finditer(text, max(after, word.start()), word.end() + BEFORE):
            # The search ends shortly after the word: take the whole run from where it begins.
            run = CANDIDATE.match(text, m.start())
            start, end = run.span()
            if start < after or start > word.end() + BEFORE - 16:
                continue
            after = end
            value = text[start:end]
            digits = sum(48 <= c < 58 for c in value)
            if digits < 2 or digits == len(value):
                continue
            k = bisect_left(starts, end)
            if k and reached[k - 1] > start:
                continue
            if novelty(text, start, end, size) >= threshold:
                found.append((start, 3, end, start))
    return found


def spans(text: bytes | None, size, threshold: float) -> list[Span]:
    """All spans by start and kind."""
    text = text or b""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, size, threshold))


def code_points(text: bytes, found: list[Span]) -> list[Span]:
    """The same spans in code points."""
    at, done, places = 0, 0, {}
    for x in sorted({p for s, _, e, v in found for p in (s, e, v)}):
        at += len(text[done:x].decode("utf-8", "replace"))
        done = x
        places[x] = at
    return [(places[s], k, places[e], places[v]) for s, k, e, v in found]


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found)


def compressed_size(names: list[bytes]):
    """The compressor primed with the identifiers: bytes -> compressed size."""
    content = b"\n".join(reversed(names)) or b"="  # the most frequent last, where offsets are short
    prime = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compressor = zstandard.ZstdCompressor(level=3, dict_data=prime, write_content_size=False)
    return lambda data: len(compressor.compress(data))


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_SIZE) -> list[bytes]:
    """The ``size`` most frequent identifiers of all texts (ties by name)."""

    def count(rows):
        seen: Counter = Counter()
        for (text,) in rows:
            if text:
                seen.update(IDENTIFIER.findall(text))
            if len(seen) > 200_000:
                yield from seen.items()
                seen.clear()
        yield from seen.items()

    counts = map_rows(docs.select(F.col("text").cast("binary")), count, "name binary, n long")
    top = counts.groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(size)
    return [bytes(r.name) for r in top.collect()]


def scanner(names: list[bytes], threshold: float):
    """fn(text) with the compressor made once in each Python worker."""
    made = []

    def scan(text: bytes | None) -> list[Span]:
        if not made:
            made.append(compressed_size(names))
        return spans(text, made[0], threshold)

    return scan


def digest(text: bytes | None, scan) -> tuple:
    text = text or b""
    found = code_points(text, scan(text)) if text else []
    base = [x for x in found if x[1] < 3]
    counts = [sum(k == i for _, k, _, _ in found) for i in range(4)]
    return *counts[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), counts[3]


def find_secrets(docs: DataFrame, threshold: float = NOVELTY, dictionary_size: int = DICTIONARY_SIZE) -> DataFrame:
    """The rows of docs as a struct ``row`` with counts by kind and the spans."""
    fn = partial(digest, scan=scanner(identifier_dictionary(docs, dictionary_size), threshold))
    udf = struct_udf(docs.sparkSession, fn, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
    return docs.select(F.struct("*").alias("row"), udf(F.col("text").cast("binary")).alias("s")).select("row", "s.*")


def redacted(text: bytes | None, scan) -> tuple:
    found = scan(text) if text else []
    out, done = [], 0
    for start, kind, end, value in sorted(found, key=lambda x: x[3]):
        if value >= done:
            out += [text[done:value], b"<", KINDS[kind].encode(), b">"]
        done = max(done, end)
    return (b"".join([*out, text[done:]]).decode("utf-8", "replace") if found else None, len(found))


def redact_secrets(docs: DataFrame, threshold: float = NOVELTY, dictionary_size: int = DICTIONARY_SIZE) -> DataFrame:
    """docs with each secret's value replaced by its kind in angle brackets; n_chars follows the text."""
    fn = partial(redacted, scan=scanner(identifier_dictionary(docs, dictionary_size), threshold))
    udf = struct_udf(docs.sparkSession, fn, "text string, n long")
    new = docs.select(F.struct("*").alias("row"), udf(F.col("text").cast("binary")).alias("s"))
    fields = {"text": F.when(F.col("s.n") > 0, F.col("s.text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        fields["n_chars"] = F.when(F.col("s.n") > 0, F.length("s.text").cast("long")).otherwise(F.col("row.n_chars"))
    return new.select(*(fields.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def op9_secret_scans(docs: DataFrame) -> DataFrame:
    """Digest: doc_id, counts, base_sha256, spans, n_novel."""
    return find_secrets(docs.select("doc_id", "text")).select(
        "row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"
    )
