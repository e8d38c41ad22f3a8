"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions.normalize import SQL_LATEST_FINDINGS
from tidescan.llm import credentials, generated, history, leakage, mixture, quality, topn


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.unwritten_files(spark, sf_dir).select("file_path")


def p1_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.unwritten_files(spark, sf_dir).groupBy("kind", "by").agg(F.count(F.lit(1)).alias("files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topn.worst_findings(spark, sf_dir).select("run_id", "id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(spark, sf_dir)


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.redacted_snippets(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeated_items(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.document_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = leakage.spread(spark, sf_dir, "documents", "doc_id", "text")
    return leakage.remove_spans(docs, leakage.document_leaks(spark, sf_dir)).filter(F.col("removed_chars") > 0)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.document_mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(*mixture.document_mixture(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_shapes(spark, sf_dir)


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.text_statistics(spark, sf_dir)


P2_SQL = f"""
WITH f AS (
  SELECT lower(trim(run_id)) AS run_id, lower(trim(id)) AS id, round(cvss_score, 1) AS score,
         CASE lower(trim(severity)) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS sev
  FROM {SQL_LATEST_FINDINGS})
SELECT run_id, id FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY sev, score DESC NULLS LAST, id) AS rn FROM f)
WHERE rn <= 10
"""

_COMMON = ", ".join(f"'{w}'" for w in quality.COMMON_WORDS)
P9_SQL = f"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{M}}\\p{{N}}]+)*') AS w,
         list_filter(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda s: trim(s) <> '') AS s
  FROM documents)
SELECT doc_id, len(w)::BIGINT AS words,
       CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 4) END AS mean_word_length,
       CASE WHEN length(text) > 0 THEN round(len(regexp_extract_all(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Z}}\\t\\n\\r\\f]'))::DOUBLE / length(text), 4) END AS symbol_ratio,
       CASE WHEN len(s) > 0 THEN round(len(list_filter(s, lambda x: regexp_matches(x, '[.!?]\\s*$')))::DOUBLE / len(s), 4) END AS ended_lines,
       CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: lower(x) IN ({_COMMON})))::DOUBLE / len(w), 4) END AS common_words
FROM d
"""

QUERIES = {
    "p5_found": p5_found, "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p8_mixture": p8_mixture, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_statistics": p9_statistics,
    "p1_found": p1_found, "p1_kinds": p1_kinds, "p2_found": p2_found, "p7_found": p7_found, "p7_cleaned": p7_cleaned}
ORACLES = {"p2_found": P2_SQL, "p9_statistics": P9_SQL}


def collect() -> tuple[dict, dict]:
    return dict(QUERIES), dict(ORACLES)
