"""The findings store as Parquet tables: append, upsert, filter, resume, latest runs, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions.normalize import severity_rank

#: What identifies a defect within a run.
KEY = ["run_id", "file_path", "line_start", "vuln_type"]
# The types that each review phase looks at.
PHASES = {
    "injection": ["sqli", "cmdi", "ldap", "nosql", "eval", "xxe", "ssti"], "auth": ["auth", "session", "timing", "jwt"],
    "crypto": ["crypto", "random", "tls", "secret"], "files": ["path_traversal", "lfi", "toctou", "upload"],
    "web": ["xss", "csrf", "redirect", "ssrf", "prototype"], "data": ["deserialization", "mass_assignment", "info"],
    "infrastructure": ["iac", "k8s", "gha", "gitlab", "compose"], "memory": ["buffer", "format_string", "overflow", "use_after_free", "memory", "unsafe"],
}


def finding_id(*key: str) -> Column:
    """A stable id: the first 12 hex digits of a hash of the key."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]), 256), 1, 12)


def upsert(stored: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """``stored`` with ``columns`` taken from the update of the same KEY where it sets them; new keys are added.

    A null in an update leaves the stored value. Repeated updates of a key: the one with
    the greatest values counts. Nulls in the key are equal.
    """
    one = updates.groupBy(*[F.col(k).alias(f"_{k}") for k in KEY]).agg(F.max(F.struct(*columns)).alias("_u"))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
    kept = [c for c in stored.columns if c not in KEY and c not in columns]
    both = stored.join(one, on, "full")
    key = [F.coalesce(k, f"_{k}").alias(k) for k in KEY]
    changed = [F.coalesce(f"_u.{c}", c).alias(c) for c in columns]
    out = both.select(*key, *changed, *kept)
    if "id" in kept:
        out = out.withColumn("id", F.coalesce("id", finding_id(*KEY)))
    return out.select(*stored.columns)


def read_findings_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Findings from JSON files that hold a list or a single object; fields not in ``schema`` are dropped, missing ones null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    """One JSON object a line, or one a block of lines if ``pretty``. Null fields are kept."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", **({"pretty": "true"} if pretty else {})})
    df.select(text.alias("value")).write.mode("overwrite").text(path)


def add_run(runs: str, row: DataFrame) -> None:
    """Append runs to the table of runs; a missing status is ``running``, a missing id a hash of path and time."""
    run_id = F.substring(F.sha2(F.concat_ws("|", "path", F.col("ts").cast("string")), 256), 1, 8)
    row.withColumn("id", F.coalesce("id", run_id)).withColumn("status", F.coalesce("status", F.lit("running"))).write.mode("append").parquet(runs)


def add_findings(findings: str, rows: DataFrame) -> None:
    """Append findings with all their columns; missing ids, severities, confidences and statuses get their defaults."""
    out = rows.withColumn("id", F.coalesce("id", finding_id(*KEY)))
    for name, value in (("severity", "medium"), ("confidence", "possible"), ("status", "candidate")):
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    out.write.mode("append").partitionBy("run_id").parquet(findings)


def write_runs(findings: DataFrame, path: str) -> None:
    """Rewrite just the run partitions that ``findings`` holds."""
    findings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def select_findings(findings: DataFrame, run_id: str | None = None, statuses: list[str] | None = None, least: str | None = None) -> DataFrame:
    """Findings of a run, with given statuses and at least a severity, worst first, ties by id."""
    out = findings
    if run_id is not None:
        out = out.filter(F.col("run_id") == run_id)
    if statuses:
        out = out.filter(F.col("status").isin(statuses))
    rank = severity_rank("severity")
    if least:
        out = out.filter(rank <= severity_rank(F.lit(least)))
    return out.orderBy(rank, "id")


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest runs by (ts, id)."""
    return runs.orderBy(F.col("ts").desc(), "id").limit(n)


def run_status(runs: DataFrame, findings: DataFrame, n: int = 5) -> DataFrame:
    """The newest runs with their candidate and confirmed findings."""
    counts = findings.groupBy("run_id").agg(F.count_if(F.col("status") == "candidate").alias("candidates"), F.count_if(F.col("status") == "confirmed").alias("confirmed"))
    new = latest_runs(runs, n)
    return new.join(counts, new["id"] == counts["run_id"], "left").select("id", "path", "ts", new["status"], F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("confirmed", F.lit(0)).alias("confirmed"))


def unscanned(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Files whose path is not in ``scanned``: what a resumed scan still has to do."""
    return files.join(scanned.select("path").distinct(), "path", "left_anti")


def in_phase(phase: str) -> Column:
    """Whether a type of the phase is part of vuln_type or of the lower-case title."""
    out = F.lit(False)
    for t in PHASES[phase]:
        out = out | F.coalesce(F.col("vuln_type").contains(t), F.lit(False)) | F.coalesce(F.lower("title").contains(t), F.lit(False))
    return out


def phase_payload(findings: DataFrame, phase: str, n: int = 50) -> DataFrame:
    """The ``n`` worst findings of a phase as JSON, with their excerpts keyed ``file:line`` (the cap follows the filter)."""
    chosen = findings.filter(in_phase(phase)).orderBy(severity_rank("severity"), "id").limit(n)
    place = F.concat_ws(":", "file_path", F.coalesce("line_start", F.lit(0)).cast("string"))
    one = F.struct("id", "file_path", "line_start", "vuln_type", "severity", "title")
    return chosen.agg(
        F.lit(phase).alias("phase"), F.count(F.lit(1)).alias("findings_count"), F.to_json(F.array_sort(F.collect_list(one))).alias("findings"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.concat_ws("#", place, "id"), "code_snippet"))))).alias("code_excerpts"),
    )
