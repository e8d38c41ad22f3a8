"""Table-level queries: snapshot changes and orphan references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions.normalize import SQL_CLEAN_PATH, SQL_LATEST_FINDINGS, SQL_LATEST_RUNS
from tidescan.operators import orphans, snapshots


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.finding_changes(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.current_orphans(orphans.finding_orphans(spark, sf_dir)).select("child_table", "child_id", "ref_state")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orphans.current_orphans(orphans.finding_orphans(spark, sf_dir))
    return found.groupBy("child_table", "period", "ref_state").agg(F.count(F.lit(1)).alias("n"))


_PATH = SQL_CLEAN_PATH.format("file_path")

P3_SQL = f"""
WITH snaps AS (
  SELECT rtrim(path, '/') AS scope, lower(trim(id)) AS run_id,
         row_number() OVER (PARTITION BY rtrim(path, '/') ORDER BY ts, lower(trim(id))) AS snap
  FROM {SQL_LATEST_RUNS} r
  WHERE lower(trim(status)) IN ('complete', 'pending_review') AND purged_at IS NULL),
rows AS (
  SELECT s.scope, s.snap, {_PATH} AS file_path, coalesce(line_start, 0) AS line_start, vuln_type,
         lower(trim(severity)) AS severity, confidence, f.status, round(cvss_score, 1) AS cvss_score
  FROM {SQL_LATEST_FINDINGS} f JOIN snaps s ON lower(trim(f.run_id)) = s.run_id),
cur AS (SELECT r.*, s.run_id FROM rows r JOIN snaps s ON r.scope = s.scope AND r.snap = s.snap WHERE r.snap > 1),
prev AS (SELECT r.* REPLACE (r.snap + 1 AS snap), s.run_id FROM rows r JOIN snaps s ON r.scope = s.scope AND s.snap = r.snap + 1)
SELECT coalesce(c.run_id, p.run_id) AS run_id, coalesce(c.file_path, p.file_path) AS file_path,
       coalesce(c.line_start, p.line_start) AS line_start, coalesce(c.vuln_type, p.vuln_type) AS vuln_type,
       CASE WHEN p.run_id IS NULL THEN 'added' WHEN c.run_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN prev p ON c.run_id = p.run_id AND c.file_path = p.file_path
  AND c.line_start = p.line_start AND c.vuln_type = p.vuln_type
WHERE p.run_id IS NULL OR c.run_id IS NULL OR c.severity IS DISTINCT FROM p.severity
  OR c.confidence IS DISTINCT FROM p.confidence OR c.status IS DISTINCT FROM p.status
  OR c.cvss_score IS DISTINCT FROM p.cvss_score
"""

_P4 = """
WITH f AS (SELECT lower(trim(id)) AS id, arg_max(lower(trim(run_id)), ingested_at) AS ref, min(ingested_at) AS seen
           FROM findings GROUP BY 1),
v AS (SELECT lower(trim(id)) AS id, arg_max(coalesce(lower(trim(finding_id)), ''), ingested_at) AS ref, min(ingested_at) AS seen
      FROM reviews GROUP BY 1),
r AS (SELECT lower(trim(id)) AS id, max(purged_at) AS purged_at, min(ingested_at) AS seen FROM scan_runs GROUP BY 1),
found AS (
  SELECT 'findings' AS child_table, f.id AS child_id, f.seen,
         CASE WHEN r.id IS NULL THEN 'missing' WHEN r.purged_at IS NOT NULL THEN 'deleted'
              WHEN r.seen > f.seen THEN 'late' END AS ref_state
  FROM f LEFT JOIN r ON f.ref = r.id WHERE f.ref <> ''
  UNION ALL
  SELECT 'reviews', v.id, v.seen,
         CASE WHEN f.id IS NULL THEN 'missing' WHEN f.seen > v.seen THEN 'late' END
  FROM v LEFT JOIN f ON v.ref = f.id WHERE v.ref <> '')
"""

QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p4_counts": p4_counts}
ORACLES = {
    "p3_found": P3_SQL,
    "p4_found": _P4 + "SELECT child_table, child_id, ref_state FROM found WHERE ref_state IS NOT NULL",
    "p4_counts": _P4
    + "SELECT child_table, strftime(seen, '%Y-%m') AS period, ref_state, count(*) AS n FROM found WHERE ref_state IS NOT NULL GROUP BY ALL",
}
