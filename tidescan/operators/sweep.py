"""The multi-rule line sweep.

Every line is tested once against one alternation of all the rules of its language; only
the few lines that pass meet the single rules, taken from a literal array that is
exploded beside them. No join of lines with rules, no Python, one pass over the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescan.functions import languages as L
from tidescan.functions.text import alternation, explode_lines, extract, literal_table
from tidescan.sources.rules import builtin_rows

FLAGS = "(?i)"
FIELDS = ["rule_id", "regex", "vuln_type", "confidence", "description", "severity", "cwe"]


def any_rule(line: Column, rules: list[tuple]) -> Column:
    return line.rlike(FLAGS + alternation([r[3] for r in rules]))


def sweep_lines(lines: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """``lines`` (with language, line) times the rules that match: all columns but ``line`` stay, plus the rule's.

    ``rules`` are rows of the rule schema, by default the built-in ones. A line meets the
    rules of its language, else of its kin, else the generic ones; a null line meets none,
    a null language the generic ones. The first match of a rule in a line counts.
    """
    rows = rules if rules is not None else builtin_rows()
    by_set: dict[str, list[tuple]] = {}
    for r in rows:
        by_set.setdefault(r[0], []).append(r)
    own = L.rule_language(F.coalesce(F.col("language"), F.lit("unknown")), sorted(by_set))
    passes, mine = F.when(F.lit(False), F.lit(False)), None
    for name, group in by_set.items():
        passes = passes.when(F.col("_set") == name, any_rule(F.col("line"), group))
        branch = literal_table([(r[2], FLAGS + r[3], *r[4:9]) for r in group], FIELDS)
        mine = F.when(F.col("_set") == name, branch) if mine is None else mine.when(F.col("_set") == name, branch)
    rest = [c for c in lines.columns if c != "line"]
    hit = lines.withColumn("_set", own).filter(passes).select(*lines.columns, F.explode(mine).alias("r"))
    found = hit.filter(F.regexp_like("line", F.col("r.regex")))
    return found.select(*rest, *[f"r.{n}" for n in FIELDS if n != "regex"], extract(F.col("line"), F.col("r.regex")).alias("match"))


def candidates(files: DataFrame, rules: list[tuple] | None = None, context: int = 3) -> DataFrame:
    """Candidate findings of files (path, language, content), with their excerpt.

    A file without content gives none. The status is ``candidate``; severity and CWE come from the rule.
    """
    lines = explode_lines(files.select("path", "language", "content"))
    found = sweep_lines(lines, rules).drop("match")
    # Every hit asks for the numbers around it, so the lines come by an equality join.
    wanted = found.withColumn("n", F.explode(F.sequence(F.col("line_no") - context, F.col("line_no") + context)))
    near = wanted.join(lines.select("path", F.col("line_no").alias("n"), "line"), ["path", "n"])
    mark = F.when(F.col("n") == F.col("line_no"), ">>> ").otherwise("    ")
    text = F.concat(mark, F.lpad(F.col("n").cast("string"), 4, " "), F.lit(" | "), F.col("line"))
    excerpt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.alias("text")))), lambda r: r["text"]), "\n")
    title = F.when(F.col("description") == "", F.concat(F.lit("Potential "), "vuln_type", F.lit(" - "), "rule_id")).otherwise(F.col("description"))
    return near.groupBy(*found.columns).agg(excerpt.alias("code_snippet")).select(
        F.col("path").alias("file_path"), F.col("line_no").alias("line_start"), "language", "vuln_type", "confidence", title.alias("title"), "code_snippet",
        F.col("rule_id").alias("pattern_id"), "severity", "cwe", F.lit("candidate").alias("status"),
    )


def count_by_type(found: DataFrame) -> DataFrame:
    return found.groupBy("vuln_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "vuln_type")
