"""Rule tables: the built-in catalogue, or JSON files of a rule directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.sources.catalogue import CATALOGUE, SEVERITY

SCHEMA = "language string, category string, rule_id string, regex string, vuln_type string, confidence string, description string, severity string, cwe int"
_RULE = "array<struct<id string, regex string, vuln_type string, confidence string, description string, severity string, cwe string>>"


def builtin_rows() -> list[tuple]:
    """The catalogue as rows of SCHEMA, ids numbered within language and kind."""
    rows = []
    for language, rules in CATALOGUE.items():
        count: dict[str, int] = {}
        for kind, confidence, cwe, regex, text in rules:
            count[kind] = count.get(kind, 0) + 1
            rows.append((language, kind, f"{language}-{kind.replace('_', '-')}-{count[kind]}", regex, kind, confidence, text, SEVERITY.get(kind, "medium"), cwe))
    return rows


def builtin_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(builtin_rows(), SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from ``<language>_patterns.json`` files: an object of category -> list of rules.

    A rule needs id and regex; missing kind, confidence and text become unknown, possible
    and ''. Rules without an expression are dropped.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)_patterns\.json$", 1).alias("language"), "value")
    each = text.select("language", F.explode(F.from_json("value", f"map<string, {_RULE}>")).alias("category", "rules")).select("language", "category", F.explode("rules").alias("r"))
    return each.filter(F.col("r.regex").isNotNull()).select(
        "language", "category", F.col("r.id").alias("rule_id"), "r.regex",
        F.coalesce("r.vuln_type", F.lit("unknown")).alias("vuln_type"), F.coalesce("r.confidence", F.lit("possible")).alias("confidence"),
        F.coalesce("r.description", F.lit("")).alias("description"), F.lower("r.severity").alias("severity"),
        F.regexp_extract("r.cwe", r"(\d+)", 1).try_cast("int").alias("cwe"),
    )
