r"""Generated, minified, vendored and data files among source files.

Three sources of evidence, strongest first:

1. *Declared.* Repository attribute files (``.gitattributes``) mark paths with
   ``linguist-generated`` or ``linguist-vendored`` (or unset them). Their glob lines become
   rules; a file meets the rules of all its ancestor directories by an equi-join on the
   directory, and the deepest directory, then the last line, wins.
2. *Mined patterns* equivalent to such lines, applied to files no attribute file speaks
   about: compound suffixes, name ends, name starts and directories whose files show
   content evidence far more often than the files of their extensions do, over enough
   checkouts; and directories named like a library whose header stands in files of
   several checkouts.
3. *Content.* A generator's banner or a copied library's header among the first comment
   lines, or most characters in minified lines or in rows of data. Where the content is
   absent, the snippets of the file's findings stand in for it. This evidence is also what
   the patterns are mined from.
4. *Seeds.* A fixed list of well-known paths, for what the data at hand are too few to show.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions.normalize import clean_path
from tidescan.session import materialise
from tidescan.sources.tables import table

# Well-known directories of third-party copies, wherever they stand in a path.
VENDOR_DIRS = [
    "vendor", "node_modules", "bower_components", "jspm_packages", "third_party", "third-party", "thirdparty",
    "3rdparty", "Godeps", "Pods", "Carthage", "site-packages", "dist-packages", "deps", "external", "extern",
    "libs", "web_modules", "_vendor", "_workspace", ".yarn",
]
# Directories that hold tool output.
GENERATED_DIRS = ["gen", "generated", "autogen", "generated-sources", "generated-src", "__generated__", "auto_generated"]
# Ends of file names that tools write.
GENERATED_NAMES = [
    r"\.pb(-c)?\.[a-z]+$", r"_pb2(_grpc)?\.pyi?$", r"_pb\.(js|rb|d\.ts)$", r"_grpc\.py$", r"\.gen(erated)?\.[a-z]+$", r"_gen\.go$",
    r"_generated\.[a-z]+$", r"^zz_generated\.", r"\.g\.(cs|dart|ts)$", r"\.designer\.cs$", r"\.tab\.[ch]$",
    r"^lex\.[^/]*\.c$", r"grpc\.java$", r"outerclass\.java$", r"_generated\.java$", r"[.\-_]min\.(js|css|mjs)$",
    r"\.bundle\.(js|mjs)$", r"\.chunk\.js$",
]

KINDS = ["generated", "minified", "vendored", "data"]

#: Marks at the start of a line that make it a comment.
_COMMENT = r"^[\s/#*;!%\-]*"
#: A generator's banner. Anchored at the start of the comment, so that text which only talks about generated files does not match.
BANNER = (
    r"(?i)" + _COMMENT + r"(?:@generated\b|<auto-?generated>|auto-?generated (?:file|code|bindings|source|by|from)\b"
    r"|(?:code|source|file|automatically|machine)[ -](?:is |was )?(?:generated|written)\b(?: by| from| on| output|[.,])"
    r"|(?:this|the) (?:file|module|code|source|class|document) (?:was|is|has been) (?:auto-?|automatically |machine )?(?:generated|emitted|produced|created|written)(?: by\b| from\b|[. ])"
    r"|generated (?:by|from|on|with|at|code|file|using)\b"
    r"|(?:produced|emitted|created|written) by \S+.*(?:regen|refresh|edit|modif|overwrit)"
    r"|source: ?\S+\s+tool: )"
)
#: The header of a module that was copied in.
BUNDLED = (
    r"(?i)^[\s/#*;!%\-]*(?:(?:bundled|vendored|embedded|imported|copied) third[- ]party|vendored (?:from|copy)|copied from (?:https?:|[\w.\-]+ v?\d+\.\d))|^/\*!\s*[\w.\-]+ v?\d+\.\d+"
    r"|^\s*(?:#|//|/\*|\*|--|;|%)[\s/#*;!%\-]*[a-z][\w.\-]{1,60}(?: library,)? (?:version )?v?\d+\.\d[^\n]{0,120}\b(?:licen[cs]ed?|redistribution|https?://)"
)
#: The library named in such a header.
LIBRARY = r"(?i)([a-z][\w.\-]{1,60}?)(?:@| library, version | v?)\d+\.\d"
#: A line of data: numbers, bytes, or a long encoded string, and nothing else.
DATA_LINE = r'^\s*(?:(?:-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?)(?:\s*,\s*|\s+|$)){4,}|["\'][A-Za-z0-9+/=\\]{40,}["\']?\s*[+,.;)\\]*)\s*$'
#: Prefix of a numbered excerpt's line.
NUMBERED = r"^(?:>>>)?\s*\d+ \| ?"
#: A line this long with almost no blanks is minified; the leading comment lines may hold the banner, but at least so many lines.
MINIFIED_CHARS, HEAD_LINES = 180, 10
COMMENT_LINE = r"^\s*(?:#|//|/?\*|--|;|%|!|<!--|<\?|\"{3}|'{3}|$)"

# Mining: files, checkouts and share of evidence that a pattern needs, and how far the files with evidence must exceed what the
# extensions of its files make expect: so many times (or nearly all), and so many standard deviations.
MIN_FILES, MIN_ROOTS, MIN_SHARE, MIN_LIFT, MIN_SIGMA = 12, 4, 0.3, 2.5, 4.0
#: Checkouts in whose files a library's header must stand.
MIN_LIBRARY_ROOTS = 3


def text_lines(text: Column) -> Column:
    """Lines without the numbering of an excerpt; null gives null."""
    return F.transform(F.split(text, "\r\n|\r|\n"), lambda s: F.regexp_replace(s, NUMBERED, ""))


def content_measures(lines: Column) -> dict[str, Column]:
    """Characters in all, minified and data lines, and whether a banner or header opens the text."""

    def chars(keep) -> Column:
        kept = F.filter(lines, keep)
        return F.coalesce(F.aggregate(kept, F.lit(0), lambda a, s: a + F.length(F.trim(s))), F.lit(0))

    code = F.array_position(F.transform(lines, lambda s: ~s.rlike(COMMENT_LINE)), F.lit(True))
    head = F.slice(lines, F.lit(1), F.greatest(F.when(code > 0, code).otherwise(F.size(lines)), F.lit(HEAD_LINES)).cast("int"))
    header = F.try_element_at(F.filter(head, lambda s: s.rlike(BUNDLED)), F.lit(1))
    return {
        "all_chars": chars(lambda s: F.length(F.trim(s)) > 3),
        "minified_chars": chars(
            lambda s: (F.length(s) >= MINIFIED_CHARS) & (F.length(F.regexp_replace(s, r"\s", "")) > 0.9 * F.length(s)) & ~s.rlike(DATA_LINE)
        ),
        "data_chars": chars(lambda s: s.rlike(DATA_LINE)),
        "banner": F.coalesce(F.exists(head, lambda s: s.rlike(BANNER)), F.lit(False)),
        "bundled": F.coalesce(F.exists(head, lambda s: s.rlike(BUNDLED)), F.lit(False)),
        "library": F.lower(F.nullif(F.regexp_extract(header, LIBRARY, 1), F.lit(""))),
    }


def evidence(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file_path, content_kind (null: none) and the library named in its header. ``files``: path, content; ``rows``: file_path, code_snippet, line_start.

    Every file of ``rows`` comes out once. Rows are summed where they are read; only the
    sums are shuffled, so a file with a third of all rows costs no task more.
    """
    def measured(df: DataFrame, path: str, text: str, mine: str) -> DataFrame:
        m = content_measures(F.col("_lines"))
        return df.withColumn("_lines", text_lines(F.col(text))).select(F.col(path).alias("file_path"), F.lit(mine).alias("of"), *[e.alias(n) for n, e in m.items()])

    # A banner in an excerpt counts only where the excerpt shows the top of the file.
    top = F.coalesce(F.col("line_start") <= HEAD_LINES, F.lit(False))
    found = measured(rows, "file_path", "code_snippet", "row")
    from_rows = measured(rows.filter(top), "file_path", "code_snippet", "top").select("file_path", F.lit("row").alias("of"), F.lit(0).alias("all_chars"), F.lit(0).alias("minified_chars"), F.lit(0).alias("data_chars"), "banner", "bundled", "library")
    parts = found.withColumn("banner", F.lit(False)).withColumn("bundled", F.lit(False)).withColumn("library", F.lit(None).cast("string")).unionByName(from_rows)
    of_files = measured(files.filter(F.col("content").isNotNull()), "path", "content", "file")
    sums = parts.unionByName(of_files).groupBy("file_path")
    total = lambda c, of: F.sum(F.when(F.col("of") == of, F.col(c)))
    both = sums.agg(
        *[total(c, of).alias(f"{of}_{c}") for of in ("row", "file") for c in ("all_chars", "minified_chars", "data_chars")],
        F.max("banner").alias("banner"), F.max("bundled").alias("bundled"), F.max("library").alias("library"), F.max(F.col("of") == "row").alias("wanted"),
    )
    use = lambda c: F.when(F.coalesce(F.col("file_all_chars"), F.lit(0)) > 0, F.col(f"file_{c}")).otherwise(F.col(f"row_{c}"))
    kind = (
        F.when(F.col("banner"), "generated").when(F.col("bundled"), "vendored")
        .when(use("minified_chars") * 2 > use("all_chars"), "minified")
        .when(use("data_chars") * 2 > use("all_chars"), "data")
    )
    return both.filter("wanted").select("file_path", kind.alias("content_kind"), F.when(kind == "vendored", F.col("library")).alias("library"))


def glob_regex(pattern: Column) -> Column:
    """A glob of an attribute file as a regular expression over the path below its directory.

    ``*`` and ``?`` stay within a name, ``**`` crosses directories, a pattern without an
    inner slash matches at any depth, and a pattern that names a directory covers what lies in it.
    ``[!..]`` and ``[^..]`` are negated classes.
    """
    p = F.regexp_replace(pattern, r"/$", "/**")
    anchored = F.instr(F.regexp_replace(p, r"(/\*\*)?$", ""), "/") > 0
    body = F.regexp_replace(F.regexp_replace(p, "^/", ""), r"([.+^${}()|\\])", r"\\$1")
    body = F.regexp_replace(body, r"\[(?:!|\\\^)", "[^")
    body = F.regexp_replace(body, r"\*\*/", "\u0001")
    body = F.regexp_replace(body, r"/?\*\*", "\u0002")
    body = F.regexp_replace(body, r"\*", "[^/]*")
    body = F.regexp_replace(body, r"\?", "[^/]")
    body = F.regexp_replace(F.regexp_replace(body, "\u0001", "(?:.*/)?"), "\u0002", "(?:/.*|.+)")
    return F.concat(F.lit("^"), F.when(anchored, F.lit("")).otherwise(F.lit("(?:.*/)?")), body, F.lit("$"))


def attribute_rules(files: DataFrame) -> DataFrame:
    """Rules of all attribute files: dir, line_no, regex, attr (generated or vendored), state."""
    name = r"(^|/)\.gitattributes$"
    lines = (
        files.filter(F.col("path").rlike(name) & F.col("content").isNotNull())
        .select(F.regexp_replace("path", name, "").alias("dir"), F.posexplode(F.split("content", "\r\n|\r|\n")).alias("line_no", "line"))
        .withColumn("line", F.trim("line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
    )
    quoted = F.regexp_extract("line", r'^"((?:[^"\\]|\\.)*)"', 1)
    name_of = F.when(quoted != "", F.regexp_replace(quoted, r"\\(.)", "$1")).otherwise(F.regexp_extract("line", r"^(\S+)", 1))
    rest = F.regexp_replace("line", r'^(?:"(?:[^"\\]|\\.)*"|\S+)\s*', "")
    lines = lines.select("dir", "line_no", glob_regex(name_of).alias("regex"), F.explode(F.split(rest, r"\s+")).alias("a"))
    what = F.regexp_extract("a", r"^[-!]?linguist-(generated|vendored)(?:=|$)", 1)
    off = F.col("a").rlike(r"^[-!]") | F.lower("a").endswith("=false")
    return lines.withColumn("attr", what).filter(F.col("attr") != "").select("dir", "line_no", "regex", "attr", (~off).alias("state"))


def declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """file_path, declared_kind, and whether attribute files say it is not generated or not vendored."""
    steps = F.split("file_path", "/")
    walks = paths.select("file_path", F.explode(F.sequence(F.lit(0), F.size(steps) - 1)).alias("d"))
    walks = walks.select("file_path", "d", F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), F.col("d")), "/").alias("dir"))
    below = F.when(F.col("dir") == "", F.col("file_path")).otherwise(F.expr("substring(file_path, length(dir) + 2)"))
    hits = walks.join(rules, "dir").filter(F.regexp_like(below, F.col("regex")))
    last = hits.groupBy("file_path", "attr").agg(F.max(F.struct("d", "line_no", "state")).alias("r"))
    on, off = F.col("r.state"), ~F.col("r.state")
    return last.groupBy("file_path").agg(
        F.max(F.when(on, F.col("attr"))).alias("declared_kind"), F.max(off & (F.col("attr") == "generated")).alias("written"), F.max(off & (F.col("attr") == "vendored")).alias("own"),
    )


def parent_dirs(path: Column) -> Column:
    """The directories between the checkout and the file."""
    steps = F.split(path, "/")
    return F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 2, F.lit(0)))


def known_kind(path: Column) -> Column:
    """Kind by the fixed patterns, or null."""
    parents = parent_dirs(path)
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    within = lambda names: F.arrays_overlap(parents, F.array(*[F.lit(n) for n in names]))
    return (
        F.when(within(VENDOR_DIRS), "vendored")
        .when(name.rlike(r"[.\-_]min\.(js|css|mjs)$"), "minified")
        .when(within(GENERATED_DIRS), "generated")
        .when(name.rlike("|".join(f"(?:{p})" for p in GENERATED_NAMES)), "generated")
    )


def name_shapes(path: Column) -> Column:
    """Candidate patterns of a path: compound suffix, marked name end and start, and its directories."""
    name = F.element_at(F.split(path, "/"), -1)
    found = F.array(
        F.regexp_extract(name, r"(\.[A-Za-z\-]+\.[A-Za-z0-9]+)$", 1),
        F.regexp_extract(name, r"([_\-][A-Za-z0-9]+\.[A-Za-z0-9]+)$", 1),
        F.concat(F.lit("^"), F.regexp_extract(name, r"^([A-Za-z]+[._\-])[^.]*\.[^.]*\.", 1)),
    )
    dirs = F.transform(parent_dirs(path), lambda d: F.concat(F.lit("/"), d, F.lit("/")))
    return F.array_distinct(F.filter(F.concat(found, dirs), lambda s: F.length(s) > 2))


def mined_patterns(paths: DataFrame) -> DataFrame:
    """shape, mined_kind: patterns whose files show evidence far more often than the files of their extensions.

    ``paths``: file_path, content_kind. Counts are grouped; no pattern's files are gathered.
    """
    paths = paths.withColumn("ext", F.regexp_extract(F.lower("file_path"), r"\.([^./]*)$", 1))
    usual = paths.groupBy("ext").agg((F.count("content_kind") / F.count(F.lit(1))).alias("usual"))
    shaped = paths.select("content_kind", "ext", F.split("file_path", "/")[0].alias("root"), F.explode(name_shapes(F.col("file_path"))).alias("shape"))
    by_ext = shaped.groupBy("shape", "ext").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("content_kind") == k).alias(k) for k in KINDS])
    roots = shaped.groupBy("shape").agg(F.approx_count_distinct("root").alias("roots"))
    stats = by_ext.join(usual, "ext").groupBy("shape").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("usual")).alias("expected"), *[F.sum(k).alias(k) for k in KINDS])
    hits = sum((F.col(k) for k in KINDS), F.lit(0))
    kind = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(k).alias("kind")) for k in KINDS]))["kind"]
    share, beyond = hits / F.col("n"), hits - F.col("expected")
    enough = (F.col("n") >= MIN_FILES) & (F.col("roots") >= MIN_ROOTS) & (share >= MIN_SHARE) & (beyond >= MIN_SIGMA * F.sqrt("expected"))
    return stats.join(roots, "shape").filter(enough & ((hits >= MIN_LIFT * F.col("expected")) | (share >= 0.95))).select("shape", kind.alias("mined_kind"))


def mined_libraries(seen: DataFrame) -> DataFrame:
    """shape, mined_kind: directories named like a library whose header stands in files of several checkouts."""
    named = seen.filter(F.col("library").isNotNull()).groupBy("library").agg(F.approx_count_distinct(F.split("file_path", "/")[0]).alias("roots"))
    return named.filter(F.col("roots") >= MIN_LIBRARY_ROOTS).select(F.concat(F.lit("/"), "library", F.lit("/")).alias("shape"), F.lit("vendored").alias("mined_kind"))


def classify(files: DataFrame, rows: DataFrame) -> DataFrame:
    """file_path, kind (generated, minified, vendored, data) and ``by`` of every file of ``rows`` nobody wrote by hand.

    ``files``: path, content; ``rows``: file_path, code_snippet, line_start, all with
    canonical paths. A null path is dropped; null or empty content gives no content
    evidence; repeated rows change nothing but their weight in the snippet shares. What an attribute file
    denies (generated or vendored) is not concluded from anything else.
    """
    seen = materialise(evidence(files, rows.filter(F.col("file_path").isNotNull())), "file-evidence")
    says = declared(seen.select("file_path"), attribute_rules(files))
    mined = mined_patterns(seen.select("file_path", "content_kind")).unionByName(mined_libraries(seen)).distinct()
    by_shape = (
        seen.select("file_path", F.explode(name_shapes(F.col("file_path"))).alias("shape"))
        .join(mined, "shape").groupBy("file_path").agg(F.min("mined_kind").alias("mined_kind"))
    )
    joined = seen.join(says, "file_path", "left").join(by_shape, "file_path", "left")
    written, own = F.coalesce("written", F.lit(False)), F.coalesce("own", F.lit(False))

    def allowed(kind: Column) -> Column:
        return F.when(~F.when(kind == "vendored", own).otherwise(written), kind)

    each = [("declared", F.col("declared_kind")), ("mined", allowed(F.col("mined_kind"))), ("content", allowed(F.col("content_kind"))), ("seed", allowed(known_kind(F.col("file_path"))))]
    by = F.coalesce(*[F.when(k.isNotNull(), F.lit(name)) for name, k in each])
    return joined.select("file_path", F.coalesce(*[k for _, k in each]).alias("kind"), by.alias("by")).filter(F.col("kind").isNotNull())


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, sf_dir, "source_files").select(clean_path("path").alias("path"), "content").dropDuplicates()
    rows = table(spark, sf_dir, "findings").select(clean_path("file_path").alias("file_path"), "code_snippet", "line_start")
    return files, rows


def unwritten_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(*inputs(spark, sf_dir))
