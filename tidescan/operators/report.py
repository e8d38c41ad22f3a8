"""Reports of a run: severity tables, Markdown, JSON, HTML and SARIF documents.

Each document is built by Spark as one or more parts (rows of text) per run, the worst findings
first. The number of findings in a part is a parameter; no finding is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidescan.functions.normalize import SEVERITIES, clean_id, severity_rank
from tidescan.session import materialise

BAR = 30


def severity_pivot(findings: DataFrame, by: str) -> DataFrame:
    """Per group the number of findings of each severity word, and in all (other words only count there)."""
    s = clean_id("severity")
    return findings.groupBy(by).agg(*[F.count_if(s == w).alias(w) for w in SEVERITIES], F.count(F.lit(1)).alias("total"))


def severity_bars(findings: DataFrame) -> DataFrame:
    """severity, n and a bar of up to 30 cells, the longest for the most frequent."""
    counts = findings.groupBy(F.coalesce(SEVERITY_WORD(), F.lit("other")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    cells = F.round(F.col("n") / F.max("n").over(W.partitionBy()) * BAR).cast("int")
    return counts.select("severity", "n", F.repeat(F.lit("#"), cells).alias("bar"))


def SEVERITY_WORD() -> Column:  # noqa: N802
    s = clean_id("severity")
    return F.when(s.isin(SEVERITIES), s)


def escape_html(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def numbered(findings: DataFrame, most: int) -> DataFrame:
    """The findings with part_no and _n, their place in the run, from 1 and the worst first.

    Places are counted in range partitions and shifted by the run's rows in those before, so no run is one group.
    """
    key = ["run_id", "_rank", "id"]
    ranked = findings.withColumn("_rank", severity_rank("severity"))
    rows = materialise(ranked.repartitionByRange(*key).sortWithinPartitions(*key).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "numbered")
    pieces = rows.groupBy(F.col("run_id").alias("_run"), F.col("_p").alias("_part")).agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    ahead = F.coalesce(F.sum("_rows").over(W.partitionBy("_run").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("_run", "_part", (ahead - F.col("_first")).alias("_shift"))
    placed = rows.join(pieces, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("_p") == F.col("_part"))).withColumn("_n", F.col("_m") + F.col("_shift") + 1)
    return placed.withColumn("part_no", F.floor((F.col("_n") - 1) / most).cast("int") + 1).drop("_rank", "_p", "_m", "_run", "_part", "_shift")


def _beside(parts: DataFrame, by_run: DataFrame) -> DataFrame:
    """Each part with the row of its run, a null run too."""
    other = by_run.withColumnRenamed("run_id", "_run")
    return parts.join(other, F.col("run_id").eqNullSafe(F.col("_run"))).drop("_run")


def _joined(findings: DataFrame, text: Column, most: int, sep: str) -> DataFrame:
    rows = numbered(findings, most).select("run_id", "part_no", F.struct("_n", text.alias("t")).alias("x"))
    return rows.groupBy("run_id", "part_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), sep).alias("body"))


def markdown(findings: DataFrame, most: int = 200) -> DataFrame:
    """run_id, part_no, document."""
    text = F.concat(
        F.lit("### ["), F.upper(F.coalesce(SEVERITY_WORD(), F.lit("informational"))), F.lit("] "), F.coalesce("title", "vuln_type", F.lit("finding")), F.lit("\n\n- File: `"),
        F.coalesce("file_path", F.lit("?")), F.lit(":"), F.coalesce(F.col("line_start").cast("string"), F.lit("0")), F.lit("`\n- Status: "), F.coalesce("status", F.lit("candidate")),
        F.lit("\n\n```\n"), F.coalesce("code_snippet", F.lit("")), F.lit("\n```\n"),
    )
    counts = severity_pivot(findings, "run_id")
    head = F.concat(F.lit("# Security report\n\n| severity | findings |\n|---|---|\n"), *[F.concat(F.lit(f"| {w} | "), F.col(w).cast("string"), F.lit(" |\n")) for w in SEVERITIES], F.lit("\n"))
    return _beside(_joined(findings, text, most, "\n"), counts).select("run_id", "part_no", F.concat(head, "body").alias("document"))


def json_report(findings: DataFrame, most: int = 200) -> DataFrame:
    """run_id, part_no, document: a summary of all five severities and the findings."""
    one = F.struct(
        "id", "file_path", "line_start", "line_end", "language", "vuln_type", "severity", "confidence", "status", "title", "description", "cwe", "owasp", "cvss_score", "cvss_vector",
        "code_snippet", "taint_source", "taint_sink", "remediation",
    )
    rows = numbered(findings, most).groupBy("run_id", "part_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", one.alias("f")))), lambda x: x["f"]).alias("findings"))
    summary = severity_pivot(findings, "run_id").select("run_id", F.struct(*SEVERITIES, "total").alias("summary"))
    return _beside(rows, summary).select("run_id", "part_no", F.to_json(F.struct("run_id", "part_no", "summary", "findings")).alias("document"))


def html(findings: DataFrame, most: int = 200) -> DataFrame:
    """run_id, part_no, document: one collapsible section per finding, all text escaped."""
    text = F.concat(
        F.lit('<details class="'), escape_html(F.coalesce(SEVERITY_WORD(), F.lit("informational"))), F.lit('"><summary>'), escape_html(F.coalesce("title", "vuln_type")), F.lit(" - "),
        escape_html(F.col("file_path")), F.lit(":"), escape_html(F.col("line_start")), F.lit("</summary><pre>"), escape_html(F.col("code_snippet")), F.lit("</pre></details>"),
    )
    return _joined(findings, text, most, "\n").select("run_id", "part_no", F.concat(F.lit("<!doctype html><html><body><h1>Security report</h1>\n"), "body", F.lit("\n</body></html>")).alias("document"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One rule per CWE, or per type where there is none: rule_id, name, level of its worst finding, n."""
    rule = F.coalesce(F.nullif("cwe", F.lit("")), "vuln_type")
    least = F.min(severity_rank("severity"))
    return findings.groupBy(rule.alias("rule_id")).agg(F.min("vuln_type").alias("name"), F.when(least <= 1, "error").when(least == 2, "warning").otherwise("note").alias("level"), F.count(F.lit(1)).alias("n"))


def sarif(findings: DataFrame, most: int = 1000) -> DataFrame:
    """run_id, part_no, document: SARIF 2.1.0 with rules, results and stable fingerprints."""
    rank = severity_rank("severity")
    rule = F.coalesce(F.nullif("cwe", F.lit("")), "vuln_type")
    place = F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.coalesce("line_start", F.lit(1)), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation")))
    print_ = F.sha1(F.concat_ws(":", "file_path", F.coalesce(F.col("line_start").cast("string"), F.lit("0")), "vuln_type"))
    result = F.struct(
        rule.alias("ruleId"), F.when(rank <= 1, "error").when(rank == 2, "warning").otherwise("note").alias("level"), F.struct(F.coalesce("title", "vuln_type").alias("text")).alias("message"),
        place.alias("locations"), F.struct(print_.alias("primary")).alias("fingerprints"),
    )
    rows = numbered(findings, most).groupBy("run_id", "part_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", result.alias("r")))), lambda x: x["r"]).alias("results"))
    rules = findings.groupBy("run_id").agg(F.array_sort(F.collect_set(F.struct(rule.alias("id"), F.struct(F.col("vuln_type").alias("text")).alias("shortDescription")))).alias("rules"))
    run = F.struct(F.struct(F.struct(F.lit("tidescan").alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return _beside(rows, rules).select("run_id", "part_no", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))
