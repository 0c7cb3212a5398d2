"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, crf, langid, mixing, packing, pii, quality_rules, sharding, simhash, urlfilter
from .common import table

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumn("host_rate", F.round("host_rate", 9))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.kd_shards(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.url_filter(pages, urlfilter.rules_frame(spark, RULES)).drop("url")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


_RULE_ROWS = ", ".join(f"('{r}', '{a}')" for r, a in RULES)
_OP8_SQL = f"""
WITH rules AS (SELECT rule, action, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS p FROM (VALUES {_RULE_ROWS}) t(rule, action)),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT page_id, rule, action, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT p.page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND k = 1
"""


_OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (SELECT rid, i, ws[i:i+2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again CROSS JOIN (VALUES (0), (1), (2)) s(k) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines ON w.rid = lines.rid LEFT JOIN covered ON w.rid = covered.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM b GROUP BY source),
s AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(f) / sum(n) AS mean, count(*) AS k, sum(n * n) AS nn, sum(f * f / n) AS nrr FROM h),
v AS (SELECT mean, (nrr - n * mean * mean - (k - 1) * mean * (1 - mean)) / nullif(n - nn / n, 0) AS between_hosts FROM s),
p AS (SELECT mean, CASE WHEN between_hosts > 0 THEN least(1000, greatest(1, mean * (1 - mean) / between_hosts - 1)) ELSE 1000 END AS strength FROM v),
r AS (SELECT source, (f + mean * strength) / (n + strength) AS rate FROM h CROSS JOIN p)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, round(rate, 9) AS host_rate, NOT base_failed AND (b.source IS NULL OR rate < 0.5) AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
"""


def queries() -> dict:
    ops = (op1_language_id, op2_quality_rules, op3_packing, op4_pii, op5_sharding, op6_mixing, op7_ann, op8_url_filter, op9_quality_classifier, op10_simhash)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": _OP2_SQL, "op8_url_filter": _OP8_SQL}
