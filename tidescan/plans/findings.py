"""Queries over findings, runs and reviews: store, classification, evaluation, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions.cvss import base_score
from tidescan.functions.normalize import SQL_CLEAN_PATH, SQL_LATEST_FINDINGS, SQL_LATEST_RUNS, clean_id, clean_path, one_decimal
from tidescan.functions.versions import severity_of_score
from tidescan.operators import classify, report, store
from tidescan.plans import sql
from tidescan.sources.tables import findings_latest, runs_latest, table

COLUMNS = {
    "run_id": lambda: clean_id("run_id"), "file_path": lambda: clean_path("file_path"), "line_start": lambda: F.col("line_start"), "vuln_type": lambda: F.col("vuln_type"),
    "severity": lambda: clean_id("severity"), "status": lambda: F.col("status"), "title": lambda: F.col("title"), "cwe": lambda: F.col("cwe"), "owasp": lambda: F.col("owasp"),
    "cvss_score": lambda: one_decimal("cvss_score"), "cvss_vector": lambda: F.col("cvss_vector"), "code_snippet": lambda: F.col("code_snippet"), "confidence": lambda: F.col("confidence"), "line_end": lambda: F.col("line_end"),
    **{n: (lambda n=n: F.col(n)) for n in ("language", "description", "taint_source", "taint_sink", "remediation")},
}


def current(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return findings_latest(spark, sf_dir, {n: COLUMNS[n]() for n in names}).drop("first_seen")


def severity_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.severity_pivot(current(spark, sf_dir, "vuln_type", "severity"), "vuln_type")


def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = current(spark, sf_dir, "vuln_type", "severity", "cvss_score").withColumn("severity", F.coalesce("severity", F.lit("none")))
    return rows.rollup("severity", "vuln_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("cvss_score") * 10).cast("bigint")).alias("score_tenths"))


def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_latest(spark, sf_dir)
    return store.run_status(runs, current(spark, sf_dir, "run_id", "status"), 5).select("id", "path", "status", "candidates", "confirmed")


def reportable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.select_findings(current(spark, sf_dir, "run_id", "severity", "status"), statuses=["confirmed", "likely"], least="medium")
    return found.select("id", "run_id", "severity", "status")


def reviewed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert of the verdicts: the status that each reviewed finding has after them."""
    found = current(spark, sf_dir, "run_id", "file_path", "line_start", "vuln_type", "status")
    verdicts = table(spark, sf_dir, "reviews").select(clean_id("finding_id").alias("id"), "verdict").filter(F.col("verdict").isin("true_positive", "false_positive"))
    latest = verdicts.groupBy("id").agg(F.max("verdict").alias("verdict"))
    updates = found.join(latest, "id").select(*store.KEY, F.when(F.col("verdict") == "true_positive", "confirmed").otherwise("false_positive").alias("status"))
    out = store.upsert(found, updates, ["status"])
    return out.groupBy("vuln_type", "status").agg(F.count(F.lit(1)).alias("n"))


def unscanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "source_files").select(clean_path("path").alias("path")).distinct()
    return store.unscanned(files, table(spark, sf_dir, "findings").select(clean_path("file_path").alias("path")))


def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = current(spark, sf_dir, "vuln_type", "title", "severity")
    each = F.array_compact(F.array(*[F.when(store.in_phase(p), F.lit(p)) for p in store.PHASES]))
    return found.select(F.explode(each).alias("phase"), "severity").groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "critical").alias("critical"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each finding's CWE and OWASP entries agree with the tables, per type."""
    found = current(spark, sf_dir, "vuln_type", "cwe", "owasp").join(classify.kinds(spark), "vuln_type", "left")
    same = F.col("cwe") == F.concat(F.lit("CWE-"), F.col("cwe_id").cast("string"))
    return found.groupBy("vuln_type", "cwe_id", "owasp_category").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("same_cwe"), F.count_if(F.col("owasp") == F.col("owasp_category")).alias("same_owasp"))


def cvss_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score of every delivered vector, and the severity it stands for."""
    rows = table(spark, sf_dir, "findings").groupBy("cvss_vector").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("cvss_vector", "n", base_score(F.col("cvss_vector")).alias("score"), severity_of_score(base_score(F.col("cvss_vector"))).alias("rating"))


def review_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings reported as likely or confirmed against the kinds that reviews confirm, per file."""
    found = current(spark, sf_dir, "file_path", "vuln_type", "status")
    verdict = table(spark, sf_dir, "reviews").groupBy(clean_id("finding_id").alias("id")).agg(F.max(F.col("verdict") == "true_positive").alias("true"))
    seen = found.join(verdict, "id")
    labels = seen.select(F.col("file_path").alias("file"), F.when(F.col("true"), F.col("vuln_type")).alias("kind"))
    reported = seen.filter(F.col("status").isin("likely", "confirmed")).select(F.col("file_path").alias("file"), F.col("vuln_type").alias("kind"))
    return classify.evaluate(reported, labels)


def sarif_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rules(current(spark, sf_dir, "vuln_type", "severity", "cwe"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir, "run_id", "file_path", "line_start", "line_end", "vuln_type", "severity", "confidence", "status", "title", "cwe", "owasp", "cvss_score", "cvss_vector", "code_snippet", "language", "description", "taint_source", "taint_sink", "remediation")


def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.markdown(_documents(spark, sf_dir))


def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.json_report(_documents(spark, sf_dir))


def html_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.html(_documents(spark, sf_dir))


def sarif_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif(_documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        severity_by_type, severity_rollup, newest_runs, reportable_findings, reviewed_findings, unscanned_files, phase_counts, classified, cvss_scores,
        review_evaluation, sarif_rule_table, markdown_reports, json_reports, html_reports, sarif_reports,
    )
}

_S = "lower(trim(severity))"
_FP = SQL_CLEAN_PATH.format("file_path")
_RANK = f"CASE {_S} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
_F = SQL_LATEST_FINDINGS
_KINDS = sql.values(classify.KINDS, ["vuln_type", "cwe_id", "owasp_category", "default_vector"], "kinds")
_PHASE = sql.values([(p, t) for p, ts in store.PHASES.items() for t in ts], ["phase", "t"], "phases")
_ALIAS = sql.values(list(classify.ALIASES.items()), ["a", "b"], "alias")
_M = lambda m: f"regexp_extract(cvss_vector, '(^|/){m}:([A-Z])', 2)"
_W = lambda m, d: "CASE " + _M(m) + "".join(f" WHEN '{k}' THEN {v}" for k, v in d.items()) + " END"
_CIA = {"H": 0.56, "L": 0.22, "N": 0.0}

ORACLES = {
    "severity_by_type": f"SELECT vuln_type, {', '.join(f'count(*) FILTER (WHERE {_S} = {sql.text(w)}) AS {w}' for w in ('critical', 'high', 'medium', 'low', 'informational'))}, count(*) AS total FROM {_F} GROUP BY vuln_type",
    "severity_rollup": f"SELECT severity, vuln_type, count(*) AS n, sum(round(s * 10)::BIGINT)::BIGINT AS score_tenths FROM (SELECT coalesce({_S}, 'none') AS severity, vuln_type, round(cvss_score, 1) AS s FROM {_F}) GROUP BY ROLLUP (severity, vuln_type)",
    "newest_runs": f"""WITH r AS (SELECT lower(trim(id)) AS id, rtrim(path, '/') AS path, ts, lower(trim(status)) AS status FROM {SQL_LATEST_RUNS} ORDER BY ts DESC, id LIMIT 5)
        SELECT r.id, r.path, r.status, count(*) FILTER (WHERE f.status = 'candidate') AS candidates, count(*) FILTER (WHERE f.status = 'confirmed') AS confirmed
        FROM r LEFT JOIN {_F} f ON lower(trim(f.run_id)) = r.id GROUP BY ALL""",
    "reportable_findings": f"SELECT lower(trim(id)) AS id, lower(trim(run_id)) AS run_id, {_S} AS severity, status FROM {_F} WHERE status IN ('confirmed', 'likely') AND {_RANK} <= 2",
    "reviewed_findings": f"""WITH v AS (SELECT lower(trim(finding_id)) AS id, max(verdict) AS verdict FROM reviews WHERE verdict IN ('true_positive', 'false_positive') GROUP BY 1)
        SELECT f.vuln_type, CASE v.verdict WHEN 'true_positive' THEN 'confirmed' WHEN 'false_positive' THEN 'false_positive' ELSE f.status END AS status, count(*) AS n
        FROM {_F} f LEFT JOIN v ON lower(trim(f.id)) = v.id GROUP BY ALL""",
    "unscanned_files": f"SELECT DISTINCT {SQL_CLEAN_PATH.format('path')} AS path FROM source_files WHERE {SQL_CLEAN_PATH.format('path')} NOT IN (SELECT {_FP} FROM findings)",
    "phase_counts": f"""WITH {_PHASE}, f AS (SELECT lower(trim(id)) AS id, vuln_type, title, {_S} AS s FROM {_F}),
        x AS (SELECT DISTINCT f.id, f.s, p.phase FROM f JOIN phases p ON contains(f.vuln_type, p.t) OR contains(lower(f.title), p.t))
        SELECT phase, count(*) AS n, count(*) FILTER (WHERE s = 'critical') AS critical FROM x GROUP BY phase""",
    "classified": f"""WITH {_KINDS} SELECT f.vuln_type, k.cwe_id, k.owasp_category, count(*) AS n, count(*) FILTER (WHERE f.cwe = 'CWE-' || k.cwe_id) AS same_cwe,
        count(*) FILTER (WHERE f.owasp = k.owasp_category) AS same_owasp FROM {_F} f LEFT JOIN kinds k ON f.vuln_type = k.vuln_type GROUP BY ALL""",
    "cvss_scores": f"""WITH v AS (SELECT cvss_vector, count(*) AS n FROM findings GROUP BY 1),
        m AS (SELECT *, {_M('S')} = 'C' AS ch, {_W('AV', {'N': 0.85, 'A': 0.62, 'L': 0.55, 'P': 0.2})} AS av, {_W('AC', {'L': 0.77, 'H': 0.44})} AS ac, {_W('UI', {'N': 0.85, 'R': 0.62})} AS ui,
          CASE WHEN {_M('PR')} = 'N' THEN 0.85 WHEN {_M('PR')} = 'L' THEN CASE WHEN {_M('S')} = 'C' THEN 0.68 ELSE 0.62 END WHEN {_M('PR')} = 'H' THEN CASE WHEN {_M('S')} = 'C' THEN 0.5 ELSE 0.27 END END AS pr,
          1 - (1 - {_W('C', _CIA)}::DOUBLE) * (1 - {_W('I', _CIA)}::DOUBLE) * (1 - {_W('A', _CIA)}::DOUBLE) AS iss FROM v),
        s AS (SELECT *, CASE WHEN ch THEN 7.52 * (iss - 0.029) - 3.25 * pow(iss - 0.02, 15) ELSE 6.42 * iss END AS impact, 8.22 * av::DOUBLE * ac * pr * ui AS ex FROM m),
        r AS (SELECT *, CASE WHEN ch THEN 1.08 * (impact + ex) ELSE impact + ex END AS raw FROM s),
        t AS (SELECT *, round(CASE WHEN raw > 10 THEN 10.0 ELSE raw END * 100000)::BIGINT AS w FROM r),
        u AS (SELECT cvss_vector, n, CASE WHEN w IS NULL THEN NULL WHEN impact <= 0 THEN 0.0 WHEN w % 10000 = 0 THEN round(w / 100000.0, 1) ELSE round((w // 10000 + 1) / 10.0, 1) END AS score FROM t)
        SELECT *, CASE WHEN score >= 9 THEN 'critical' WHEN score >= 7 THEN 'high' WHEN score >= 4 THEN 'medium' WHEN score > 0 THEN 'low' WHEN score IS NOT NULL THEN 'informational' END AS rating FROM u""",
    "review_evaluation": f"""WITH {_ALIAS}, v AS (SELECT lower(trim(finding_id)) AS id, bool_or(verdict = 'true_positive') AS t FROM reviews GROUP BY 1),
        s AS (SELECT {_FP} AS file, coalesce(a.b, lower(trim(f.vuln_type))) AS kind, f.status, v.t FROM {_F} f JOIN v ON lower(trim(f.id)) = v.id LEFT JOIN alias a ON a.a = lower(trim(f.vuln_type))),
        files AS (SELECT file, bool_or(t) AS vulnerable FROM s GROUP BY file), truth AS (SELECT DISTINCT file, kind, true AS t FROM s WHERE t),
        got AS (SELECT DISTINCT s.file, kind, vulnerable, true AS g FROM s JOIN files USING (file) WHERE status IN ('likely', 'confirmed')),
        b AS (SELECT kind, (coalesce(t, false) AND coalesce(g, false))::INT AS tp, (coalesce(g, false) AND NOT coalesce(t, false) AND (NOT coalesce(vulnerable, false) OR kind IN (SELECT kind FROM truth)))::INT AS fp,
          (coalesce(t, false) AND NOT coalesce(g, false))::INT AS fn FROM truth FULL JOIN got USING (file, kind)),
        r AS (SELECT coalesce(kind, 'overall') AS kind, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM b GROUP BY ROLLUP (kind))
        SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0.0 END AS recall,
          CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 4) ELSE 0.0 END AS f1 FROM r WHERE tp + fp + fn > 0""",
    "sarif_rule_table": f"SELECT coalesce(nullif(cwe, ''), vuln_type) AS rule_id, min(vuln_type) AS name, CASE WHEN min({_RANK}) <= 1 THEN 'error' WHEN min({_RANK}) = 2 THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM {_F} GROUP BY 1",
}
