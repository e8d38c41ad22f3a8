"""Readers of the input tables in their canonical form.

Rules of the data model: run ids, finding ids and severities compare trimmed and in
lower case; a file is the same whichever separator its path uses; rows of ``findings``
with one id are versions of one finding and the latest ``ingested_at`` counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions.normalize import clean_id, clean_path, clean_root, one_decimal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest_versions(df: DataFrame, key: str, version: str, keep: list[str]) -> DataFrame:
    """One row per ``key``: the row with the greatest ``version``.

    Of rows that tie on ``version`` the one whose kept columns are greatest in order
    counts, so the choice never depends on row order. Null keys form one group.
    ``first_seen`` is the smallest version. Kept columns must be orderable.
    """
    row = F.struct(F.col(version), *[F.col(c) for c in keep])
    return (
        df.groupBy(key)
        .agg(F.max(row).alias("_last"), F.min(version).alias("first_seen"))
        .select(key, "first_seen", *[F.col(f"_last.{c}").alias(c) for c in keep])
    )


def findings_latest(spark: SparkSession, sf_dir: str, columns: dict[str, Column]) -> DataFrame:
    """Current version of each finding: ``id``, ``first_seen`` and the given columns.

    ``columns`` maps output names to expressions over the raw table; only their inputs
    are read.
    """
    raw = table(spark, sf_dir, "findings").select(
        clean_id("id").alias("id"), F.col("ingested_at"), *[e.alias(n) for n, e in columns.items()]
    )
    return latest_versions(raw, "id", "ingested_at", list(columns))


def runs_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current version of each run: id, path without trailing slash, ts, status, purged_at, first_seen."""
    raw = table(spark, sf_dir, "scan_runs").select(
        clean_id("id").alias("id"),
        clean_root("path").alias("path"),
        "ts",
        F.lower(F.trim("status")).alias("status"),
        "purged_at",
        "ingested_at",
    )
    return latest_versions(raw, "id", "ingested_at", ["path", "ts", "status", "purged_at"])


FINDING_COLUMNS = {
    "run_id": lambda: clean_id("run_id"),
    "file_path": lambda: clean_path("file_path"),
    "line_start": lambda: F.coalesce(F.col("line_start"), F.lit(0)),
    "vuln_type": lambda: F.col("vuln_type"),
    "severity": lambda: clean_id("severity"),
    "confidence": lambda: F.col("confidence"),
    "status": lambda: F.col("status"),
    "cvss_score": lambda: one_decimal("cvss_score"),
}


def finding_columns(*names: str) -> dict[str, Column]:
    return {n: FINDING_COLUMNS[n]() for n in names}
