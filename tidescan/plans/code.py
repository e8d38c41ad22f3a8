"""Queries over source files and code excerpts: inventory, rules, secrets, expressions, routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions import languages as L
from tidescan.functions.entropy import PLACEHOLDER, THRESHOLD
from tidescan.functions.normalize import SQL_CLEAN_PATH, clean_path
from tidescan.functions.text import explode_lines
from tidescan.operators import lints, redos, routes, secrets, sweep
from tidescan.plans import sql
from tidescan.session import materialise
from tidescan.sources.detectors import DETECTORS
from tidescan.sources.files import delivered_files
from tidescan.sources.rules import builtin_rows
from tidescan.sources.tables import table


def file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_lines(materialise(delivered_files(spark, sf_dir).select("path", "language", "content"), "files"))


def excerpt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of the excerpts of each file, without their numbering: file_path, line."""
    rows = table(spark, sf_dir, "findings").select(clean_path("file_path").alias("file_path"), F.explode(F.split("code_snippet", "\n")).alias("line"))
    lines = rows.select("file_path", F.regexp_replace("line", r"^(?:>>>)?\s*\d+ \| ?", "").alias("line")).distinct()
    # Stored once: the sweeps that follow test a line against many expressions, and none of them moves below the distinct.
    return materialise(lines, "excerpt-lines")


def line_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = file_lines(spark, sf_dir)
    return lines.groupBy("language").agg(
        F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"), F.max("line_no").cast("bigint").alias("longest_file")
    )


def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return delivered_files(spark, sf_dir).select("path").distinct().select(
        "path", L.detect_language(p).alias("language"), L.is_test(p).alias("test"), L.is_generated(p).alias("generated"), L.skipped(p).alias("skipped"), L.is_manifest(p).alias("manifest")
    )


def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivered_files(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def framework_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.framework_histogram(delivered_files(spark, sf_dir))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.sweep_lines(file_lines(spark, sf_dir)).select("path", "line_no", "rule_id", "vuln_type", "confidence", "severity", "match")


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.count_by_type(sweep.sweep_lines(file_lines(spark, sf_dir)))


def excerpt_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sweep over the lines of all excerpts, the language taken from the path."""
    lines = excerpt_lines(spark, sf_dir).withColumn("language", L.detect_language(F.col("file_path")))
    return sweep.sweep_lines(lines).groupBy("language", "rule_id", "vuln_type").agg(F.count(F.lit(1)).alias("n"))


def candidate_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.candidates(materialise(delivered_files(spark, sf_dir).select("path", "language", "content"), "files")).select("file_path", "line_start", "pattern_id", "title", "code_snippet", "status")


def named_secret_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.named_secrets(excerpt_lines(spark, sf_dir)).groupBy("file_path", "secret_type", "severity", "evidence", "entropy").agg(F.count(F.lit(1)).alias("n"))


def entropy_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.entropy_secrets(excerpt_lines(spark, sf_dir)).groupBy("file_path", "evidence", "entropy").agg(F.count(F.lit(1)).alias("n"))


def regex_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of every quoted literal of the excerpts, read as an expression."""
    lits = excerpt_lines(spark, sf_dir).select(F.explode(F.regexp_extract_all("line", F.lit(r'"([^"\\]{4,})"'), F.lit(1))).alias("pattern")).distinct()
    return redos.analyse(lits).groupBy("complexity", "anchored", "severity").agg(F.count(F.lit(1)).alias("patterns"), F.sum("quantifiers").alias("quantifiers"))


def regex_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions of the source files that can backtrack badly, with the line each stands on."""
    return redos.findings(file_lines(spark, sf_dir)).select("path", "line_no", "pattern", "complexity", "severity", "description")


def route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.extract_routes(file_lines(spark, sf_dir))


def nearest_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "findings").select(clean_path("file_path").alias("file_path"), "line_start").filter(F.col("line_start").isNotNull()).distinct()
    near = routes.nearest_routes(found, routes.extract_routes(file_lines(spark, sf_dir)))
    return near.filter(F.col("route_path").isNotNull())


def annotation_lints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lints.annotation_lints(file_lines(spark, sf_dir))


def go_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lints.go_imports(delivered_files(spark, sf_dir)).groupBy("package", "note").agg(F.count(F.lit(1)).alias("files"))


def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routes.summary(routes.extract_routes(file_lines(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        line_inventory, path_classes, language_histogram, framework_files, rule_hits, rule_counts, excerpt_rule_counts, candidate_findings,
        named_secret_hits, entropy_literals, regex_complexity, regex_findings, route_table, nearest_route, annotation_lints, go_imports, route_summary,
    )
}

# ---- oracle SQL -------------------------------------------------------------------------------------------------------

_RULES = builtin_rows()
_SETS = sorted({r[0] for r in _RULES})
_RULE_VALUES = sql.values([(r[0], r[2], r[3], r[4], r[5], r[6], r[7]) for r in _RULES], ["language", "rule_id", "regex", "vuln_type", "confidence", "description", "severity"], "rules")
_HITS = (
    f"WITH {sql.FILE_LINES}, {_RULE_VALUES}, hits AS MATERIALIZED (SELECT l.path, l.line_no, l.line, r.rule_id, r.vuln_type, r.confidence, r.severity, r.description, "
    f"regexp_extract(l.line, '(?i)' || r.regex, 0) AS match FROM lines l JOIN rules r ON r.language = {sql.rule_set('l.language', _SETS)} "
    f"AND regexp_matches(l.line, '(?i)' || r.regex)) "
)
_FP = SQL_CLEAN_PATH.format("file_path")
_EXCERPTS = (
    f"excerpts AS (SELECT DISTINCT file_path, regexp_replace(line, '^(>>>)?\\s*\\d+ \\| ?', '') AS line FROM "
    f"(SELECT {_FP} AS file_path, unnest(string_split(code_snippet, chr(10))) AS line FROM findings))"
)
_SKIP = ", ".join(sql.text(d) for d in L.SKIP_DIRS)
_ENDS = " OR ".join(f"n LIKE {sql.text('%' + e.replace('_', chr(92) + '_'))} ESCAPE '\\'" for e in L.GENERATED_ENDS)
_MANIFESTS = ", ".join(sql.text(m) for m in L.MANIFESTS)
_SIGNS = sql.values([(lang, name, sign) for lang, fs in L.FRAMEWORKS.items() for name, signs in fs.items() for sign in signs], ["language", "framework", "sign"], "signs")


def _entropy(token: str) -> str:
    """Entropy over the three alphabets, the greatest; as in the engine, short remains count as 0."""
    one = lambda cls: (
        f"(SELECT CASE WHEN sum(n) < 16 OR sum(n) IS NULL THEN 0.0 ELSE -sum(n / t * log2(n / t)) END FROM "
        f"(SELECT c, count(*)::DOUBLE AS n, (sum(count(*)) OVER ())::DOUBLE AS t FROM (SELECT unnest(string_split(regexp_replace({token}, '{cls}', '', 'g'), '')) AS c) WHERE c <> '' GROUP BY c))"
    )
    return f"greatest({one('[^A-Za-z0-9+/=]')}, {one('[^0-9a-fA-F]')}, {one('[^A-Za-z0-9_-]')})"


def _mask(v: str) -> str:
    return f"CASE WHEN length({v}) <= 8 THEN '****' ELSE left({v}, least(4, length({v}) // 4)) || '****' || right({v}, 2) END"


_DETECT = sql.values([(k, n, s, rx) for k, (n, s, rx) in enumerate(DETECTORS)], ["k", "secret_type", "severity", "regex"], "detectors")
_CODE = f"code AS (SELECT * FROM excerpts WHERE NOT regexp_matches(line, {sql.text(secrets.COMMENT)}))"
_ROUTES = sql.values([(k, f, "(?i)" + rx, m, p) for k, (f, rx, m, p) in enumerate(routes.ROUTES)], ["k", "framework", "regex", "mg", "pg"], "defs")
_ROUTE_LANGS = sql.values([(f, x) for f, xs in routes.LANGUAGES.items() for x in xs], ["framework", "language"], "langs")
_ROUTE_CTE = (
    f"{sql.FILE_LINES}, {_ROUTES}, {_ROUTE_LANGS}, m AS (SELECT l.path AS file_path, l.line_no AS line, d.k, d.framework, d.regex, d.mg, d.pg, trim(l.line, ' ') AS code, "
    f"unnest(regexp_extract_all(l.line, d.regex, 0)) AS hit FROM lines l JOIN langs g ON g.language = l.language JOIN defs d ON d.framework = g.framework "
    f"WHERE regexp_matches(l.line, d.regex)), "
    f"e AS (SELECT *, trim(CASE WHEN pg = 1 THEN regexp_extract(hit, regex, 1) ELSE regexp_extract(hit, regex, 2) END) AS p, "
    f"upper(CASE WHEN mg = 1 THEN regexp_extract(hit, regex, 1) WHEN mg = 2 THEN regexp_extract(hit, regex, 2) ELSE '' END) AS v FROM m), "
    f"r AS (SELECT file_path, line, CASE WHEN regexp_matches(p, '^[/^]') THEN p ELSE '/' || p END AS path, k, "
    f"CASE WHEN v = '' THEN 'ANY' ELSE regexp_replace(v, '[''\"\\s]', '', 'g') END AS method, framework, code FROM e), "
    f"found AS (SELECT file_path, line, path, method, framework, code FROM (SELECT *, row_number() OVER (PARTITION BY file_path, line, path ORDER BY k, method) AS rn FROM r) WHERE rn = 1)"
)


def _replaced(text: str, steps: list[tuple[str, str]]) -> str:
    for a, b in steps:
        text = f"regexp_replace({text}, {sql.text(a)}, {sql.text(b)}, 'g')"
    return text


_ANALYSED = (
    f"sk AS (SELECT pattern, {_replaced('pattern', redos.ATOMS)} AS s FROM lits), "
    f"folded AS (SELECT pattern, list_reduce(list_prepend(s, list_transform(range(length(s) - length(replace(s, '(', '')) + 1), lambda x: '')), lambda acc, x: {_replaced('acc', redos.FOLDS)}) AS s FROM sk), "
    f"a AS (SELECT *, contains(s, '!') AS nested, "
    f"len(list_filter(list_transform(regexp_extract_all(pattern, {sql.text(redos.FLAT_GROUP)}, 1), lambda g: list_transform(list_filter(string_split(g, '|'), lambda x: x <> ''), lambda x: regexp_extract(x, {sql.text(redos.FIRST_ATOM)}, 1))), "
    f"lambda f: len(list_distinct(f)) < len(f))) > 0 AS shared, "
    f"len(regexp_extract_all(regexp_replace(pattern, '\\\\.[*+?]', '', 'g'), '[*+?]|\\{{\\d+,\\d*\\}}', 0)) AS quantifiers, "
    f"pattern LIKE '^%' AND pattern LIKE '%$' AS anchored FROM folded), "
    f"rated AS (SELECT *, CASE WHEN nested THEN 'catastrophic' WHEN shared THEN 'exponential' WHEN quantifiers >= 3 THEN 'polynomial' ELSE 'linear' END AS complexity FROM a), "
    f"t AS (SELECT *, CASE WHEN anchored THEN 'info' WHEN complexity = 'catastrophic' THEN 'high' WHEN complexity = 'exponential' THEN 'medium' WHEN complexity = 'polynomial' THEN 'low' ELSE 'info' END AS severity FROM rated)"
)

ORACLES = {
    "line_inventory": f"WITH {sql.FILE_LINES} SELECT language, count(DISTINCT path) AS files, count(*) AS lines, sum(length(line))::BIGINT AS chars, max(line_no)::BIGINT AS longest_file FROM lines GROUP BY language",
    "path_classes": f"""
        WITH {sql.FILES}, p AS (SELECT DISTINCT path, lower(regexp_extract(path, '([^/]*)$', 1)) AS n, string_split(path, '/') AS parts FROM files)
        SELECT path, {sql.language_of('path')} AS language,
          len(list_intersect(list_transform(parts, lambda x: lower(x)), ['test', 'tests', 'spec', '__tests__'])) > 0
            OR regexp_matches(regexp_replace(n, '\\.[^.]*$', ''), '^(test|spec)_|_(test|spec)$|\\.(test|spec)$') AS test,
          n LIKE '%.generated.%' OR {_ENDS} AS generated,
          len(list_filter(parts[:-2], lambda x: lower(x) LIKE '.%' OR lower(x) IN ({_SKIP}))) > 0 AS skipped,
          parts[-1] IN ({_MANIFESTS}) OR n LIKE '%.csproj' AS manifest
        FROM p""",
    "language_histogram": f"WITH {sql.FILES} SELECT language, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY language",
    "framework_files": f"WITH {sql.FILES}, {_SIGNS}, hit AS (SELECT DISTINCT f.path, f.size, f.is_test, f.content, s.framework FROM files f JOIN signs s ON f.language = s.language AND contains(f.content, s.sign)) SELECT framework, count(*) AS files FROM hit GROUP BY framework",
    "rule_hits": _HITS + "SELECT path, line_no, rule_id, vuln_type, confidence, severity, match FROM hits",
    "rule_counts": _HITS + "SELECT vuln_type, count(*) AS n FROM hits GROUP BY vuln_type",
    "excerpt_rule_counts": f"""WITH {_EXCERPTS}, {_RULE_VALUES}, l AS (SELECT *, {sql.language_of('file_path')} AS language FROM excerpts)
        SELECT l.language, r.rule_id, r.vuln_type, count(*) AS n FROM l JOIN rules r ON r.language = {sql.rule_set('l.language', _SETS)}
        AND regexp_matches(l.line, '(?i)' || r.regex) GROUP BY ALL""",
    "named_secret_hits": f"""WITH {_EXCERPTS}, {_CODE}, {_DETECT}, h AS (SELECT file_path, secret_type, severity, regexp_extract(line, regex, 0) AS raw FROM code JOIN detectors ON regexp_matches(line, regex))
        SELECT file_path, secret_type, severity, {_mask('raw')} AS evidence, round({_entropy('raw')}, 4) AS entropy, count(*) AS n FROM h
        WHERE NOT regexp_matches(raw, {sql.text(PLACEHOLDER)}) GROUP BY ALL""",
    "entropy_literals": f"""WITH {_EXCERPTS}, {_CODE}, t AS (SELECT file_path, unnest(regexp_extract_all(line, {sql.text(secrets.QUOTED)}, 1)) AS token FROM code),
        e AS (SELECT file_path, token, {_entropy('token')} AS h FROM t WHERE NOT regexp_matches(token, {sql.text(PLACEHOLDER)}))
        SELECT file_path, {_mask('token')} AS evidence, round(h, 4) AS entropy, count(*) AS n FROM e WHERE h >= {THRESHOLD} GROUP BY ALL""",
    "regex_complexity": f"""WITH {_EXCERPTS}, lits AS (SELECT DISTINCT unnest(regexp_extract_all(line, '"([^"\\\\]{{4,}})"', 1)) AS pattern FROM excerpts), {_ANALYSED}
        SELECT complexity, anchored, severity, count(*) AS patterns, sum(quantifiers)::BIGINT AS quantifiers FROM t GROUP BY ALL""",
    "annotation_lints": f"WITH {sql.FILE_LINES}, {sql.values(lints.ANNOTATIONS, ['annotation', 'argument', 'note'], 'ann')} SELECT path, line_no, annotation, note, 'medium' AS severity FROM lines JOIN ann ON regexp_matches(line, '@' || annotation || '\\b') AND NOT regexp_matches(line, argument || '\\s*=') WHERE language IN ('java', 'kotlin')",
    "go_imports": f"""WITH {sql.FILES}, {sql.values(list(lints.WATCHED_IMPORTS.items()), ['package', 'note'], 'watched')}, g AS (SELECT path, content, array_to_string(regexp_extract_all(content, '(?m)^import\\s*\\(([^)]*)\\)', 1), chr(10)) AS block FROM files WHERE language = 'go'),
        i AS (SELECT DISTINCT path, unnest(list_concat(regexp_extract_all(content, '(?m)^import\\s+(?:[\\w.]+\\s+)?"([^"\\n]+)"', 1), regexp_extract_all(block, '(?m)^\\s*(?:[\\w.]+\\s+)?"([^"\\n]+)"', 1))) AS package FROM g)
        SELECT package, note, count(*) AS files FROM i LEFT JOIN watched USING (package) GROUP BY ALL""",
    "route_summary": f"WITH {_ROUTE_CTE} SELECT '| ' || method || ' | ' || path || ' | ' || framework || ' | ' || count(*) || ' |' AS row FROM found GROUP BY method, path, framework",
    "route_table": f"WITH {_ROUTE_CTE} SELECT * FROM found",
    "nearest_route": f"""WITH {_ROUTE_CTE}, f AS (SELECT DISTINCT {_FP} AS file_path, line_start FROM findings WHERE line_start IS NOT NULL),
        ranked AS (SELECT f.file_path, f.line_start, r.path AS route_path, r.method AS route_method, r.line AS route_line,
          row_number() OVER (PARTITION BY f.file_path, f.line_start ORDER BY (r.line > f.line_start), CASE WHEN r.line <= f.line_start THEN -r.line ELSE r.line END, r.path) AS rn
          FROM f JOIN found r ON f.file_path = r.file_path)
        SELECT file_path, line_start, route_path, route_method, route_line FROM ranked WHERE rn = 1""",
}
