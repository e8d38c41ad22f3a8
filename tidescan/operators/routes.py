"""HTTP routes in source lines, and the route nearest to a finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidescan.functions.text import alternation, extract, literal_table

# Framework, expression, group of the method (0: none), group of the path.
ROUTES = [
    ("flask", r"""@(?:app|bp|blueprint)\s*\.\s*route\s*\(\s*['"]([^'"]+)['"](?:[^)]*methods\s*=\s*\[([^\]]+)\])?""", 2, 1),
    ("flask", r"""@(?:app|bp)\s*\.\s*(get|post|put|delete|patch)\s*\(\s*['"]([^'"]+)['"]""", 1, 2),
    ("fastapi", r"""@(?:app|router)\s*\.\s*(get|post|put|delete|patch|options|head)\s*\(\s*['"]([^'"]+)['"]""", 1, 2),
    ("django", r"""\b(?:re_)?path\s*\(\s*r?['"]([^'"]*)['"]""", 0, 1),
    ("django", r"""\burl\s*\(\s*r?['"]([^'"]*)['"]""", 0, 1),
    ("express", r"""(?:app|router)\s*\.\s*(get|post|put|delete|patch|use)\s*\(\s*['"`]([^'"` ]+)['"`]""", 1, 2),
    ("spring", r"""@(?:Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?['"]([^'"]+)['"]""", 0, 1),
    ("gin", r"""\b(?:r|router)\s*\.\s*(GET|POST|PUT|DELETE|PATCH)\s*\(\s*["']([^"']+)["']""", 1, 2),
    ("rails", r"""\b(?:get|post|put|delete|patch|resources|match)\s+['"]([^'"]+)['"]""", 0, 1),
]
LANGUAGES = {"flask": ["python"], "fastapi": ["python"], "django": ["python"], "express": ["javascript", "typescript"], "spring": ["java", "kotlin"], "gin": ["go"], "rails": ["ruby"]}


def extract_routes(lines: DataFrame, frameworks: list[str] | None = None) -> DataFrame:
    """file_path, line, path, method, framework, code of each route; per file, line and path the first rule counts.

    ``lines``: path, language, line_no, line. The method is upper case or ANY; a path gets a
    leading slash unless it starts with one or with ^. Routes that span lines are seen on
    the line where they begin.
    """
    rows = [(k, f, lang, "(?i)" + rx, m, p) for k, (f, rx, m, p) in enumerate(ROUTES) if not frameworks or f in frameworks for lang in LANGUAGES[f]]
    defs = literal_table(rows, ["k", "framework", "lang", "regex", "mg", "pg"])
    mine = lines.filter(F.col("language").isin(sorted({r[2] for r in rows})) & F.col("line").rlike("(?i)" + alternation([rx for _, rx, _, _ in ROUTES])))
    each = mine.select("path", "language", "line_no", "line", F.explode(defs).alias("d")).filter((F.col("d.lang") == F.col("language")) & F.regexp_like("line", F.col("d.regex")))
    hits = each.select("path", "line_no", "line", "d", F.explode(F.regexp_extract_all("line", F.col("d.regex"), F.lit(0))).alias("m"))
    route = F.trim(extract(F.col("m"), F.col("d.regex"), F.col("d.pg")))
    verb = F.when(F.col("d.mg") > 0, F.upper(extract(F.col("m"), F.col("d.regex"), F.col("d.mg")))).otherwise("")
    found = hits.select(
        F.col("d.k").alias("k"), F.col("path").alias("file_path"), F.col("line_no").alias("line"),
        F.when(route.rlike(r"^[/^]"), route).otherwise(F.concat(F.lit("/"), route)).alias("path"),
        F.when(verb == "", "ANY").otherwise(F.regexp_replace(verb, r"""['"\s]""", "")).alias("method"), F.col("d.framework").alias("framework"), F.trim("line").alias("code"),
    )
    first = F.min(F.struct("k", "method", "framework", "code")).alias("f")
    return found.groupBy("file_path", "line", "path").agg(first).select("file_path", "line", "path", "f.method", "f.framework", "f.code")


def nearest_routes(findings: DataFrame, routes: DataFrame) -> DataFrame:
    """``findings`` (file_path, line_start, ..) plus the route at or before the line, else the first after it; null if none.

    An as-of join by one sort: findings and routes share a window per file, so nothing is
    compared pairwise. Of routes on one line the least path counts.
    """
    marks = routes.groupBy("file_path", F.col("line").alias("pos")).agg(F.min(F.struct("path", "method", "framework", "line")).alias("r"))
    marks = marks.select("file_path", "pos", F.lit(0).alias("kind"), F.struct("r.path", "r.method", "r.framework", F.col("r.line").alias("route_line")).alias("route"), *[F.lit(None).cast(t).alias(f"_{c}") for c, t in findings.dtypes])
    asks = findings.select("file_path", F.col("line_start").alias("pos"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["route"].dataType).alias("route"), *[F.col(c).alias(f"_{c}") for c in findings.columns])
    w = W.partitionBy("file_path").orderBy("pos", "kind")
    before = F.last("route", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("route", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    both = marks.unionByName(asks).withColumn("near", F.coalesce(before, after))
    return both.filter(F.col("kind") == 1).select(*[F.col(f"_{c}").alias(c) for c in findings.columns], F.col("near.path").alias("route_path"), F.col("near.method").alias("route_method"), F.col("near.route_line").alias("route_line"))


def summary(routes: DataFrame) -> DataFrame:
    """Rows of a Markdown table of the routes (method, path, framework, places), ordered by path and method."""
    counts = routes.groupBy("path", "method", "framework").agg(F.count(F.lit(1)).alias("n")).orderBy("path", "method", "framework")
    return counts.select(F.format_string("| %s | %s | %s | %s |", "method", "path", "framework", F.col("n").cast("string")).alias("row"))


def project_framework(files: DataFrame, order: tuple[str, ...] = tuple(LANGUAGES)) -> str | None:
    """The first framework, in a fixed order, that any file of the project shows; its rules then serve for all files. One row is collected."""
    from tidescan.functions.languages import detect_frameworks

    each = files.select(F.explode(detect_frameworks(F.col("content"), F.col("language"))).alias("framework"))
    rank = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("framework"))
    first = each.filter(rank > 0).agg(F.min(F.struct(rank.alias("k"), "framework")).alias("f")).first()[0]
    return first["framework"] if first else None


def framework_histogram(files: DataFrame) -> DataFrame:
    """Files per framework, over all files."""
    from tidescan.functions.languages import detect_frameworks

    each = files.select(F.explode(detect_frameworks(F.col("content"), F.col("language"))).alias("framework"))
    return each.groupBy("framework").agg(F.count(F.lit(1)).alias("files"))
