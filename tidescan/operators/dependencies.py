"""Dependencies against known vulnerabilities: a join on the package, then the version range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescan.functions.versions import severity_of_score, version_in_range
from tidescan.sources.advisories import ALIASES, OSV_NAMES


def advisory_index(advisories: DataFrame, aliases: bool = True) -> DataFrame:
    """Advisories under every ecosystem that they serve (lock files share those of their language)."""
    rows = [(e, t) for e, ts in ALIASES.items() for t in ts] if aliases else []
    named = advisories.withColumn("package_key", F.lower("package"))
    if not rows:
        return named
    pairs = advisories.sparkSession.createDataFrame(rows, "for_ecosystem string, ecosystem string")
    extra = named.join(pairs, "ecosystem").withColumn("ecosystem", F.col("for_ecosystem")).drop("for_ecosystem")
    return named.unionByName(extra).distinct()


def audit(deps: DataFrame, advisories: DataFrame, aliases: bool = True, first_only: bool = False) -> DataFrame:
    """One row per dependency and advisory whose range holds its version.

    ``deps``: manifest, ecosystem, name, version, is_dev, is_direct. The join is an equality
    on ecosystem and name; Spark broadcasts the advisories while they are small. A null
    version or name matches nothing. A dependency in two manifests gives two rows.
    """
    index = advisory_index(advisories, aliases).withColumnRenamed("ecosystem", "_e")
    hit = deps.join(index, (deps["ecosystem"] == index["_e"]) & (deps["name"] == index["package_key"]))
    held = hit.filter(version_in_range(F.col("version"), F.col("range"), first_only))
    return held.select(
        "package", "ecosystem", F.col("version").alias("current_version"), F.col("range").alias("vulnerable_range"), "safe_version", "cve", "cvss", "vuln_type",
        "description", F.coalesce("is_dev", F.lit(False)).alias("is_dev"), "manifest", severity_of_score(F.col("cvss")).alias("severity"),
        F.lit("candidate").alias("status"), F.lit("known_vulns").alias("source"),
    ).distinct()


def osv_findings(deps: DataFrame, fetched: DataFrame) -> DataFrame:
    """Findings of a table fetched from the public database: ecosystem (its names), package, version, vulns (JSON list).

    The CVE among the aliases names the finding, else its id. CRITICAL, HIGH, MEDIUM and LOW
    count as 9.5, 7.5, 5.0 and 2.5, anything else as 5.0; below 7 the severity is medium.
    """
    shape = "array<struct<id: string, aliases: array<string>, summary: string, details: string, database_specific: struct<severity: string>>>"
    names = F.create_map(*[F.lit(x) for kv in OSV_NAMES.items() for x in kv])
    each = fetched.select(F.col("ecosystem").alias("_e"), F.lower("package").alias("_p"), F.col("version").alias("_v"), F.explode(F.from_json("vulns", shape)).alias("v"))
    hit = deps.join(each, (F.coalesce(F.try_element_at(names, deps["ecosystem"]), deps["ecosystem"]) == F.col("_e")) & (deps["name"] == F.col("_p")) & (deps["version"] == F.col("_v")))
    level = F.upper("v.database_specific.severity")
    cvss = F.when(level == "CRITICAL", 9.5).when(level == "HIGH", 7.5).when(level == "LOW", 2.5).otherwise(5.0)
    cve = F.coalesce(F.get(F.filter("v.aliases", lambda a: a.startswith("CVE-")), 0), F.col("v.id"))
    return hit.select(
        F.col("name").alias("package"), "ecosystem", F.col("version").alias("current_version"), F.lit("see OSV").alias("vulnerable_range"), F.lit("see OSV").alias("safe_version"),
        cve.alias("cve"), cvss.alias("cvss"), F.lit("known_cve").alias("vuln_type"), F.coalesce("v.summary", F.substring("v.details", 1, 200)).alias("description"),
        F.coalesce("is_dev", F.lit(False)).alias("is_dev"), "manifest", F.when(cvss >= 9, "critical").when(cvss >= 7, "high").otherwise("medium").alias("severity"),
        F.lit("candidate").alias("status"), F.lit("osv.dev").alias("source"),
    )


def enrich(found: DataFrame, more: DataFrame) -> DataFrame:
    """``found`` and those of ``more`` whose (package, cve) it lacks, each pair once."""
    key = [F.lower("package").alias("_p"), F.col("cve").alias("_c")]
    seen = found.select(*key).distinct()
    new = more.join(seen, (F.lower(more["package"]) == seen["_p"]) & (more["cve"] == seen["_c"]), "left_anti")
    return found.unionByName(new.dropDuplicates(["package", "cve"]))


def summary(found: DataFrame) -> DataFrame:
    return found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low")], F.count(F.lit(1)).alias("total"))
