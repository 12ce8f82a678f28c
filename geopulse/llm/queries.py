"""Queries of the training-data operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geopulse.llm import compaction, decontamination, hmm, importance, jaccard_join, language_id, packing, quality, secret_scan, suffix_dedup, token_alignment, toxicity, window_dedup
from geopulse.llm.text import documents


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": lambda spark, sf: packing.op1_packing(documents(spark, sf)),
        "op2_lm_scoring": lambda spark, sf: hmm.op2_lm_scoring(documents(spark, sf)),
        "op3_jaccard_join": lambda spark, sf: jaccard_join.op3_jaccard_join(documents(spark, sf)),
        "op4_sharding": lambda spark, sf: compaction.op4_sharding(documents(spark, sf)),
        "op5_substring_dedup": lambda spark, sf: window_dedup.op5_substring_dedup(documents(spark, sf)),
        "op6_toxicity": lambda spark, sf: toxicity.op6_toxicity(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")),
        "op7_suffix_dedup": lambda spark, sf: suffix_dedup.op7_suffix_dedup(documents(spark, sf)),
        "op8_quality_rules": lambda spark, sf: quality.op8_quality_rules(documents(spark, sf)),
        "op9_secret_scans": lambda spark, sf: secret_scan.op9_secret_scans(documents(spark, sf)),
        "op10_decontamination": lambda spark, sf: decontamination.op10_decontamination(
            documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")
        ),
        "op11_token_alignment": lambda spark, sf: token_alignment.op11_token_alignment(documents(spark, sf)),
        "op12_language_id": lambda spark, sf: language_id.op12_language_id(documents(spark, sf)),
        "op13_importance": lambda spark, sf: importance.op13_importance(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet")),
    }


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: A-Z in lower case, whatever the locale.
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.replace("text", LOWER, 1)} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON r.u = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS component_id FROM r GROUP BY v) c ON c.v = d.doc_id
"""


OP5 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS k
  FROM w WHERE len(w) >= 20),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM win),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
g AS (
  SELECT p.doc_id, p.i, word,
    max(coalesce(again, false)::INTEGER) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM p LEFT JOIN f ON f.doc_id = p.doc_id AND f.i = p.i)
SELECT d.doc_id, count(word) AS n_words, CAST(coalesce(sum(gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id GROUP BY d.doc_id
"""


def _only(characters: str) -> str:
    return f"length(regexp_replace(coalesce(text, ''), '[^{characters}]', '', 'g'))"


def _quantiles(level: str, keys: str) -> str:
    """Fences of one level of groups from the histogram."""
    by = f"{keys}, measure" if keys else "measure"
    return f"""{level}_b AS (SELECT {by}, bucket, sum(n) AS n FROM hist GROUP BY ALL),
{level}_r AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}) AS total FROM {level}_b),
{level}_q AS (SELECT {by}, max(total) AS total, min(bucket) FILTER (upto * 1000 >= total * 500) AS b50, min(bucket) FILTER (upto * 1000 >= total * 750) AS b75 FROM {level}_r GROUP BY ALL),
{level} AS (SELECT {by}, total, {_top("b50")} + {quality.SPREAD} * ({_top("b75")} - {_top("b50")}) AS fence FROM {level}_q)"""


def _top(b: str) -> str:
    return f"(((({b} - ({b} // 64) * 64) + 1) << ({b} // 64)) - 1)"


PUNCTUATION = r"!-/:-@\[-`{-~"
_FENCES = ", ".join(f"max(fence + {slack}) FILTER (measure = '{m}') AS max_{m}" for m, slack in quality.MEASURES.items())
_WITHIN = " AND ".join(f"m.{m} <= max_{m}" for m in quality.MEASURES)

OP8 = f"""
WITH t AS (
  SELECT doc_id, lang, source, {WORDS} AS w, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    {_only("#*$%&|<>")} AS n_symbols, {_only(PUNCTUATION)} AS n_punct, {_only("A-Z")} AS n_upper,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
tri AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS k
  FROM t WHERE len(w) >= 3),
often AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM often, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
c AS (
  SELECT t.doc_id, lang, source, len(w) AS n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(l) AS n_lines, n_punct, n_upper
  FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
m AS (
  SELECT *, n_symbols * 1000 // greatest(word_chars, 1) AS symbol_pm, n_punct * 1000 // greatest(word_chars, 1) AS punct_pm,
    n_upper * 1000 // greatest(word_chars, 1) AS upper_pm, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_pm,
    n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_pm, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM c),
v AS (SELECT lang, source, unnest({list(quality.MEASURES)}) AS measure, unnest([{", ".join(quality.MEASURES)}])::BIGINT AS v FROM m),
e AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS e FROM v),
hist AS (SELECT lang, source, measure, e * 64 + (v >> e) AS bucket, count(*) AS n FROM e GROUP BY ALL),
{_quantiles("own", "lang, source")},
{_quantiles("lng", "lang")},
{_quantiles("crp", "")},
chosen AS (
  SELECT a.lang, a.source, a.measure, CASE WHEN a.total >= {quality.MIN_ROWS} THEN a.fence WHEN b.total >= {quality.MIN_ROWS} THEN b.fence ELSE c.fence END AS fence
  FROM own a JOIN lng b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN crp c ON a.measure = c.measure),
fences AS (SELECT lang, source, {_FENCES} FROM chosen GROUP BY lang, source)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_WITHIN} AS kept,
  {", ".join(quality.MEASURES)}, {", ".join(f"max_{x}" for x in quality.MEASURES)}
FROM m JOIN fences f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
"""


def _runs(table: str, key: str) -> str:
    """A row for each run of one to three words."""
    words = f"regexp_extract_all(coalesce({LOWER}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    run = lambda n: f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    return f"""(SELECT key, unnest(list_concat({run(1)}, {run(2)}, {run(3)})) AS f FROM (SELECT {key} AS key, {words} AS w FROM {table}))"""


def _nibbles() -> list[int]:
    """Steps of the reflected CRC-32 by four bits."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP13 = f"""
WITH d AS MATERIALIZED (SELECT * FROM {_runs("documents", "doc_id")}), b AS MATERIALIZED (SELECT * FROM {_runs("benchmark", "item_id")}),
x AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM d UNION SELECT f FROM b)),
k AS MATERIALIZED (
  SELECT f, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(0, len(x)), lambda i: instr('0123456789ABCDEF', x[xor(i, 1) + 1])::BIGINT - 1)),
    lambda r, n: xor(list_extract({_nibbles()}::BIGINT[], (xor(r, n) & 15) + 1), r >> 4)), 4294967295) % {importance.BUCKETS} AS bucket
  FROM x),
s AS (SELECT bucket, count(*) AS s FROM d JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (f) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM d) + {importance.BUCKETS} AS s, (SELECT count(*) FROM b) + {importance.BUCKETS} AS t),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t.t, 0) + 1)::DOUBLE * n.s) / ((s.s + 1)::DOUBLE * n.t)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT key AS doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM d JOIN k USING (f) JOIN g USING (bucket) GROUP BY key),
c AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('{importance.SEED}:' || doc_id), 1, 8))::BIGINT::DOUBLE AS h
  FROM documents LEFT JOIN w USING (doc_id)),
r AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM c),
-- n words have 3 * n - 3 runs from two words on
e AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_features >= 3 * {importance.MIN_WORDS} - 3)
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= {importance.PERCENT} * n // 100 THEN place END AS rank
FROM r LEFT JOIN e USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jaccard_join": OP3,
        "op5_substring_dedup": OP5,
        "op8_quality_rules": OP8,
        "op13_importance": OP13,
        "op4_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    }
