"""Registered queries of the training-data operators and the SQL that DuckDB can hold them against.

Every query reads its whole table and returns its full result, with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, exact_dedup, jaccard_join, licenses, mixing, pieces, quality, suffix_dedup, token_files, warc
from .common import new_dir, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"))
    return judged.selectExpr("row.doc_id AS doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "line_chars", "clean_chars")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(_table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = jaccard_join.link_documents(_table(spark, sf_dir, "documents"), words=4, percent=85)
    return linked.select("doc_id", "n_shingles", "component_id", "class_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_dir(spark, "warc")
    names = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    captures = staged(warc.assemble(staged(warc.read_records(spark, folder, names, with_payload=False), "records")), "captures")
    fact = lambda name: F.col("metadata.fields")[name].try_cast("long")
    return warc.resolved(captures, fact("page-id")).select(
        fact("page-id").alias("page_id"), F.coalesce("response.payload_bytes", fact("payload-length")).alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"), F.col("original").alias("refers_to"), F.col("request.fields")["request-line"].alias("request_line"),
    )


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_dir(spark, "tokens")
    parts = token_files.write_files(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(spark, folder, parts)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_warc": op5_warc,
    "op6_brown_lm": op6_brown_lm,
    "op7_license_scan": op7_license_scan,
    "op8_token_files": op8_token_files,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sentencepiece": op10_sentencepiece,
}

_GAPLESS = r"[^\x20\x09-\x0D]"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_GAPLESS}+') AS ws, string_split(t, chr(10)) AS ls FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM pos),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM tri, (VALUES (0), (1), (2)) AS v(o) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM w),
worded AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS y FROM lines WHERE regexp_matches(x, '{_GAPLESS}')),
judged AS (
  SELECT doc_id, x,
    (len(regexp_extract_all(x, '{quality.MARKS}')) * 10 >= length(x))
    OR (length(x) >= 60 AND NOT regexp_matches(x, '{quality.ENDS}') AND NOT coalesce(regexp_matches(y, '{quality.GOES_ON}'), false))
    OR (len(regexp_extract_all(x, '{quality.MENU}')) >= 3 AND len(regexp_extract_all(x, '{quality.MENU}')) * 40 >= length(x))
    OR (length(x) <= 300 AND regexp_matches(x, '{quality.FURNITURE}')) AS fails
  FROM worded),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines,
    sum(length(x)) AS line_chars, coalesce(sum(length(x)) FILTER (NOT fails), 0) AS clean_chars
  FROM judged GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '{quality.SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines,
    CAST(coalesce(line_chars, 0) AS BIGINT) AS line_chars, CAST(coalesce(clean_chars, 0) AS BIGINT) AS clean_chars
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PCT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND clean_chars * 100 >= line_chars * {quality.KEEP_PCT} AS kept, n_lines, n_failed_lines, line_chars, clean_chars
FROM f
"""

OP2_SQL = rf"""
WITH items AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_GAPLESS}+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM items GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM s),
w AS (SELECT *, CASE ord % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM o),
r AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, ord) AS k,
    sum(3 * source_size) OVER (ORDER BY source_size / weight, ord) - 3 * source_size AS capped,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY source_size / weight, ord) + weight AS free,
    sum(source_size) OVER () AS total FROM w),
c AS (SELECT min(k) AS k0 FROM r WHERE CAST(3 * source_size AS DOUBLE) * free > CAST(weight AS DOUBLE) * (total - capped)),
p AS (SELECT CAST(total - capped AS DOUBLE) AS rest, CAST(free AS DOUBLE) AS free FROM r, c WHERE k = k0),
t AS (SELECT source, source_size, CASE WHEN k < coalesce(k0, 1000000000) THEN CAST(3 * source_size AS DOUBLE) ELSE weight * p.rest / p.free END AS target
  FROM r CROSS JOIN c LEFT JOIN p ON true),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
keys AS (SELECT source, key, sum(size) AS g FROM items GROUP BY source, key),
run AS (SELECT source, key, g, sum(g) OVER (PARTITION BY source ORDER BY key) AS upto FROM keys),
take AS (
  SELECT run.source, run.key, b.source_size, b.target, b.times,
    CASE WHEN upto <= target - times * source_size THEN 1
      WHEN upto - g <= target - times * source_size AND upto - (target - times * source_size) < (target - times * source_size) - (upto - g) THEN 1 ELSE 0 END AS more
  FROM run JOIN b ON run.source IS NOT DISTINCT FROM b.source)
SELECT i.doc_id, i.size, CAST(source_size AS BIGINT) AS source_size, target, CAST(i.size * (times + more) AS BIGINT) AS taken
FROM items i JOIN take ON i.source IS NOT DISTINCT FROM take.source AND i.key = take.key
"""

OP3_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
  count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def _op7_sql() -> str:
    q = lambda s: s.replace("'", "''")
    known = ", ".join(f"('{q(s)}', '{k}')" for s, k in licenses.table_of().items())
    rules = ", ".join(f"('{k}', '{licenses.RULES[k][0]}', '{q(p)}')" for k, p in licenses.patterns().items())
    norm = lambda x: f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
WITH known(s, id) AS (VALUES {known}), rules(rule, license, pattern) AS (VALUES {rules}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_split_to_array(text, '{licenses.CUT}') AS c FROM documents WHERE regexp_matches(lower(text), '{licenses.hint(list(licenses.table_of()))}')),
one AS (SELECT r, doc_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM d),
whole AS (SELECT one.*, id FROM one LEFT JOIN known ON {norm("x")} = s),
cut AS (SELECT r, doc_id, i, string_split(x, chr(10)) AS l FROM whole WHERE id IS NULL AND contains(x, chr(10))),
lines AS (SELECT r, doc_id, i, unnest(l) AS y, generate_subscripts(l, 1) AS j FROM cut),
ids AS (SELECT r, doc_id, i, 0 AS j, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT r, doc_id, i, j, known.id FROM lines JOIN known ON {norm("y")} = s),
seqs AS (SELECT r, any_value(doc_id) AS doc_id, list(id ORDER BY i, j) AS l FROM ids GROUP BY r),
hits AS (SELECT r, doc_id, array_to_string(l, ',') AS sentence_ids, rule, license, len(regexp_extract_all('|' || array_to_string(l, '||') || '|', pattern)) AS n FROM seqs, rules)
SELECT any_value(doc_id) AS doc_id, any_value(sentence_ids) AS sentence_ids, string_agg(rule, ',' ORDER BY rule) AS rules,
  array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, CAST(sum(n) AS BIGINT) AS n_matches
FROM hits WHERE n > 0 GROUP BY r
"""


OP5_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
g AS (SELECT *, octet_length(encode(html)) AS bytes, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, CAST(bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to,
  'GET /' || regexp_extract(url, '^[^:]*://[^/]*/?(.*)$', 1, 's') || ' HTTP/1.1' AS request_line
FROM g
"""

SQL = {"op1_quality_rules": OP1_SQL, "op2_mix_sources": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op5_warc": OP5_SQL, "op7_license_scan": _op7_sql()}
