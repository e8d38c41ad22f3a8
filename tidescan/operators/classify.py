"""Classification tables (CWE, OWASP, default vectors) and the evaluation of findings against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kind, CWE, OWASP Top 10 (2021) category, default CVSS 3.1 vector.
KINDS = [
    ("sqli", 89, "A03:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), ("cmdi", 78, "A03:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("rce", 94, "A03:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"), ("eval_injection", 95, "A03:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("xss", 79, "A03:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"), ("ssti", 1336, "A03:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("path_traversal", 22, "A01:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N"), ("lfi", 98, "A03:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:L/A:N"),
    ("ssrf", 918, "A10:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:N/A:N"), ("xxe", 611, "A05:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:L"),
    ("deserialization", 502, "A08:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), ("open_redirect", 601, "A01:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"),
    ("prototype_pollution", 1321, "A08:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:L"), ("hardcoded_secret", 798, "A07:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:N"),
    ("weak_crypto", 327, "A02:2021", "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:N/A:N"), ("insecure_random", 330, "A02:2021", "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:L/I:N/A:N"),
    ("tls_bypass", 295, "A02:2021", "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:N"), ("mass_assignment", 915, "A08:2021", "CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:U/C:L/I:H/A:N"),
    ("buffer_overflow", 120, "A03:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"), ("format_string", 134, "A03:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("integer_overflow", 190, "A03:2021", "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H"), ("use_after_free", 416, "A03:2021", "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    ("word_splitting", 88, "A03:2021", "CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:U/C:L/I:L/A:N"), ("toctou", 367, "A04:2021", "CVSS:3.1/AV:L/AC:H/PR:L/UI:N/S:U/C:L/I:H/A:N"),
    ("iac_network", 284, "A05:2021", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N"), ("iac_privilege", 250, "A05:2021", "CVSS:3.1/AV:L/AC:L/PR:L/UI:N/S:C/C:H/I:H/A:H"),
    ("gha_curl_pipe_sh", 494, "A08:2021", "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H"),
]
# Other names of a kind.
ALIASES = {
    "sql_injection": "sqli", "sql injection": "sqli", "command_injection": "cmdi", "command injection": "cmdi", "rce": "cmdi", "path traversal": "path_traversal",
    "lfi": "path_traversal", "directory_traversal": "path_traversal", "cross_site_scripting": "xss", "cross-site scripting": "xss",
    "server_side_template_injection": "ssti", "server_side_request_forgery": "ssrf", "insecure_deserialization": "deserialization", "xml_external_entity": "xxe",
    "open redirect": "open_redirect", "prototype_pollution": "proto_pollution",
}


def kinds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KINDS, "vuln_type string, cwe_id int, owasp_category string, default_vector string")


def normal_kind(kind: Column) -> Column:
    low = F.lower(F.trim(kind))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv]), low), low)


def evaluate(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Per kind and over all: tp, fp, fn, precision, recall, f1 (4 digits, 0 where undefined).

    ``found``: file, kind. ``labels``: file, kind; a file with a null kind is a safe one. Kinds are
    compared per file as sets. A kind found in a labelled file but not among its labels is a false positive only
    if it is some label's kind; every kind found in a safe file is one. Files without a label row are ignored.
    """
    files = labels.groupBy("file").agg(F.max(F.col("kind").isNotNull()).alias("vulnerable"))
    truth = labels.filter(F.col("kind").isNotNull()).select("file", normal_kind(F.col("kind")).alias("kind")).distinct().withColumn("t", F.lit(True))
    got = found.select("file", normal_kind(F.col("kind")).alias("kind")).distinct().join(files, "file").withColumn("g", F.lit(True))
    known = truth.select("kind").distinct().withColumn("labelled", F.lit(True))
    both = truth.join(got, ["file", "kind"], "full").join(known, "kind", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    counted = both.select(
        "kind", (yes("t") & yes("g")).cast("bigint").alias("tp"), (yes("g") & ~yes("t") & (~yes("vulnerable") | yes("labelled"))).cast("bigint").alias("fp"), (yes("t") & ~yes("g")).cast("bigint").alias("fn")
    )
    agg = counted.rollup("kind").agg(F.grouping("kind").alias("all_kinds"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))
    return agg.select(
        F.when(F.col("all_kinds") == 1, "overall").otherwise(F.col("kind")).alias("kind"), "tp", "fp", "fn", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
    ).filter(F.col("tp") + F.col("fp") + F.col("fn") > 0)
