"""The queries opN_<name>: each applies one operator to its whole table, and what SQL can say of the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontaminate, media, mixing, pii, repair, simhash, tokencount, toxicity, urlfilter, warc
from gleaner.llm.common import fresh_dir
from gleaner.llm.tokenizing import vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def _url_sql() -> str:
    """By other means than the operator's: the parts of a split URL, and its words as a list that is intersected with the terms."""
    rules, vocabulary = urlfilter.Rules(), urlfilter.Vocabulary()
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules.rows)
    terms = ", ".join(f"('{t}', {w})" for t, w in vocabulary.weights)
    return f"""
WITH r(rule_host, rule_path, ruled) AS (VALUES {values}), v(term, w) AS (VALUES {terms}),
t AS (SELECT page_id, row_number() OVER () AS n, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, n, url, string_split(string_split(rest, '#')[1], '?')[1] AS rest FROM t),
u AS (SELECT page_id, n, url, translate(string_split(rest, '/')[1], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(string_split(rest, '/')[1]) + 1) AS path FROM s),
c AS (SELECT n, count(*) FILTER (w >= {vocabulary.limit}) AS n_strict, count(*) FILTER (w < {vocabulary.limit}) AS n_soft, sum(w)::DOUBLE AS weight
      FROM (SELECT DISTINCT n, unnest(regexp_split_to_array(lower(url_decode(url)), '[^\\pL\\pN]+')) AS term FROM u) JOIN v USING (term) GROUP BY 1),
b AS (SELECT n, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(ruled, length(rule_host || rule_path)) AS ruled
      FROM u, r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN weight >= {vocabulary.limit} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft, coalesce(weight, 0.0)::DOUBLE AS weight
FROM u LEFT JOIN b USING (n) LEFT JOIN c USING (n)
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session's setting spark.gleaner.tokenCounts names a cache that outlives the run; else it begins empty."""
    cache = spark.conf.get("spark.gleaner.tokenCounts", None) or fresh_dir(spark, "token-counts")
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), cache)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_packages(warc.write_packages(_table(spark, sf_dir, "pages"), fresh_dir(spark, "packages")))


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT sha1(html) AS payload_digest, max(page_id) AS newest FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY 1)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest <> page_id THEN newest END AS refers_to
FROM p LEFT JOIN g ON sha1(p.html) = g.payload_digest
"""


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.to_media(_table(spark, sf_dir, "documents")))


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return repair.read_shards(repair.write_shards(docs, vocabulary("byte_bpe_50k.json"), fresh_dir(spark, "token-ids")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_mixing": op3_mixing,
    "op4_url_filter": op4_url_filter,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_token_counts": op7_token_counts,
    "op8_warc": op8_warc,
    "op9_webp": op9_webp,
    "op10_repair": op10_repair,
}

ORACLES: dict[str, str] = {"op4_url_filter": _url_sql(), "op8_warc": OP8_SQL}
