"""Data-flow queries over the source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions import languages as L
from tidescan.functions.normalize import clean_path
from tidescan.functions.text import alternation
from tidescan.operators import taint as T
from tidescan.plans import sql
from tidescan.plans.code import file_lines
from tidescan.session import materialise
from tidescan.sources.files import delivered_files
from tidescan.sources.tables import table


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(T.line_facts(file_lines(spark, sf_dir)), "line-facts")


def tainted_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spread(_facts(spark, sf_dir)).select("path", "var", "since")


def taint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow by line facts in all files, and by syntax trees in the Python files that parse; a sink found both ways comes once."""
    by_line = T.variable_paths(_facts(spark, sf_dir))
    files = delivered_files(spark, sf_dir).filter((F.col("language") == "python") & F.col("content").isNotNull()).select("path", "content")
    by_tree = T.variable_paths(materialise(T.python_facts(files), "tree-facts"), ordered=False)
    key = ["path", "sink_line", "sink_type"]
    return by_tree.unionByName(by_line.join(by_tree.select(*key).distinct(), key, "left_anti"))


def taint_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.near_paths(_facts(spark, sf_dir)).groupBy("sink_type").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("path").alias("files"))


def python_taint_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow inside each distinct excerpt of a Python file, by syntax trees of its whole statements."""
    rows = table(spark, sf_dir, "findings").select(clean_path("file_path").alias("file_path"), F.regexp_replace("code_snippet", r"(?m)^(?:>>>)?[ \t]*\d+ \| ?", "").alias("content"))
    named = rows.filter(L.detect_language(F.col("file_path")) == "python").distinct()
    files = named.select(F.concat_ws("#", "file_path", F.md5("content")).alias("path"), "content")
    return T.variable_paths(materialise(T.python_facts(files, lenient=True), "tree-facts"), ordered=False)


QUERIES = {f.__name__: f for f in (tainted_variables, taint_paths, taint_near, python_taint_paths)}


def _case(regexes: dict[str, str]) -> str:
    return "CASE lang" + "".join(f" WHEN '{k}' THEN regexp_matches(line, {sql.text(v)})" for k, v in regexes.items()) + " ELSE false END"


_SINKS = sql.values([(k, t, rx) for k, ts in T.SINKS.items() for t, rx in ts.items()], ["lang", "sink_type", "regex"], "sinkdefs")
_BASE = f"""WITH RECURSIVE {sql.FILE_LINES}, {_SINKS},
    l AS MATERIALIZED (SELECT *, CASE WHEN language = 'typescript' THEN 'javascript' ELSE language END AS lang,
      array_to_string(list_filter(list_transform(string_split(CASE WHEN language IN ('javascript', 'typescript') THEN regexp_extract(line, {sql.text(T.DESTRUCT)}, 1) ELSE '' END, ','), lambda x: regexp_extract(x, '(\\w+)\\s*$', 1)), lambda x: x <> ''), ',') AS several FROM lines),
    f AS MATERIALIZED (SELECT path, line_no, lang, line, 
      CASE WHEN several <> '' THEN several ELSE regexp_extract(line, {sql.text(T.ASSIGN)}, 1) END AS target,
      CASE WHEN several <> '' THEN regexp_extract(line, {sql.text(T.DESTRUCT)}, 2) ELSE regexp_extract(line, {sql.text(T.ASSIGN)}, 2) END AS rhs,
      {_case({k: alternation(v) for k, v in T.SOURCES.items()})} AS is_source, {_case(T.SANITIZERS)} AS safe FROM l WHERE lang IN ({', '.join(sql.text(k) for k in T.SOURCES)})),
    each AS MATERIALIZED (SELECT * REPLACE (unnest(string_split(target, ',')) AS target) FROM f),
    uses AS MATERIALIZED (SELECT DISTINCT path, line_no AS m, target, unnest(regexp_extract_all(rhs, '\\w+', 0)) AS var FROM each WHERE target <> '' AND NOT safe AND NOT is_source),
    t AS (SELECT DISTINCT path, target AS var, line_no AS since FROM each WHERE is_source AND target <> '' AND NOT safe
      UNION SELECT u.path, u.target, u.m FROM t JOIN uses u ON u.path = t.path AND u.var = t.var AND t.since < u.m)"""
_INLINE = "(" + " OR ".join(f"f.lang = '{g}' AND d.sink_type = '{t}' AND regexp_matches(f.line, {sql.text(rx)})" for g, ts in T.INLINE.items() for t, rx in ts.items()) + ")"
ORACLES = {
    "tainted_variables": _BASE + " SELECT path, var, min(since) AS since FROM t GROUP BY ALL",
    "taint_near": _BASE
    + f""", k AS (SELECT f.path, f.line_no, d.sink_type FROM f JOIN sinkdefs d ON d.lang = f.lang AND regexp_matches(f.line, d.regex)
        AND NOT {_INLINE} AND NOT (d.sink_type = 'sqli' AND (f.lang = 'go' AND regexp_matches(f.line, {sql.text(T.BOUND["go"])}) OR f.lang = 'java' AND regexp_matches(f.line, {sql.text(T.BOUND["java"])}) AND NOT contains(f.line, '+'))))
      SELECT k.sink_type, count(*) AS pairs, count(DISTINCT k.path) AS files FROM k JOIN f s ON s.path = k.path AND s.is_source AND abs(s.line_no - k.line_no) <= 20 GROUP BY 1""",
}
