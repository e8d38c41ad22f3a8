"""Data flow from sources to sinks inside a file, as joins over facts.

Lines become facts: assignments (target and the words of the right side), sources, sinks,
sanitizers. Taint spreads over assignments by repeated equality joins on (file, word)
until nothing changes; a word that was tainted on an earlier line taints the target of a
later one. Python files that parse give their facts by the syntax tree instead, with calls
and returns as further assignments.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidescan.functions.text import alternation, tokens
from tidescan.session import materialise

ASSIGN = r"^\s*(?:[\w<>\[\].]+\s+)*[$@]{0,2}(\w+)(?:\s*:\s*\w+)?\s*:?=\s*([^=>].*)$"
#: Several names taken out of one value.
DESTRUCT = r"^\s*(?:(?:const|let|var)\s+)?[\[{]([^\]}=]*)[\]}]\s*=\s*([^=>].*)$"
# Where values from outside enter, by language.
SOURCES = {
    "python": [r"request\.(args|form|json|values|cookies|headers|data|files|GET|POST|params)", r"\binput\s*\(", r"sys\.argv", r"os\.environ"],
    "javascript": [r"req(uest)?\.(query|body|params|cookies|headers|files)", r"ctx\.(query|body|params|request)", r"location\.(search|hash|href)", r"document\.(cookie|referrer|URL)", r"process\.argv\b", r"event\.data\b"],
    "php": [r"\$_(GET|POST|REQUEST|COOKIE|FILES|SERVER)", r"php://input", r"getallheaders\s*\("],
    "ruby": [r"\bparams\b", r"\bcookies\b", r"request\.(body|headers|env|query_string)", r"\bgets\b", r"\bARGV\b"],
    "csharp": [r"Request\.(Query|Form|Headers|Cookies|Body|Params|QueryString)", r"request\.getParameter", r"Console\.ReadLine", r"\[From(Query|Body|Route)\]"],
    "go": [r"r\.URL\.(Query|Path|RawQuery)", r"r\.(FormValue|PostFormValue|Header\.Get|Body)\b", r"c\.(Query|Param|PostForm|GetHeader|BindJSON|ShouldBindJSON)\s*\(", r"os\.(Args|Getenv)\b"],
    "java": [r"\.getParameter\w*\s*\(", r"\.get(Header|Cookies|QueryString|InputStream|Reader)\s*\(", r"@(RequestParam|PathVariable|RequestBody)", r"System\.getenv\s*\("],
}
# Where they do harm, by language and type.
SINKS = {
    "python": {"sqli": r"\b(execute|executemany|raw|RawSQL)\s*\(", "cmdi": r"\bos\.(system|popen)\s*\(|subprocess\.\w+\s*\(", "path_traversal": r"\b(open|send_file)\s*\(|shutil\.\w+\s*\(", "ssrf": r"\b(requests|httpx)\.\w+\s*\(|urlopen\s*\(", "deserialization": r"pickle\.loads?\s*\(|yaml\.load\s*\(", "ssti": r"render_template_string\s*\(", "open_redirect": r"\bredirect\s*\(", "xss": r"\b(Markup|mark_safe)\s*\("},
    "javascript": {"xss": r"\.(innerHTML|outerHTML)\s*=|document\.write\s*\(|insertAdjacentHTML\s*\(", "eval": r"\beval\s*\(|new\s+Function\s*\(", "sqli": r"\.(query|raw)\s*\(|\bdb\.run\s*\(", "cmdi": r"\bexec(Sync)?\s*\(|\.spawn(Sync)?\s*\(", "path_traversal": r"fs\.\w+\s*\(|path\.join\s*\(|sendFile\s*\(", "ssrf": r"\bfetch\s*\(|axios\.\w+\s*\(|https?\.(get|request)\s*\(", "open_redirect": r"res\.redirect\s*\(|location(\.href)?\s*=", "proto_pollution": r"Object\.assign\s*\(|\b_\.(merge|defaultsDeep|set)\s*\(|\[\s*\w+\s*\]\s*\[\s*\w+\s*\]\s*="},
    "php": {"sqli": r"(mysqli?_query|pg_query|->query|->exec)\s*\(", "cmdi": r"\b(system|exec|shell_exec|passthru|popen)\s*\(", "xss": r"\b(echo|print|printf)\b", "path_traversal": r"\b(include|require)(_once)?\b|\b(fopen|file_get_contents|readfile|unlink)\s*\("},
    "ruby": {"sqli": r"\.(where|find_by_sql|execute|order)\b", "cmdi": r"\b(system|exec|spawn)\b|IO\.popen|`", "xss": r"\.html_safe|\braw\b", "path_traversal": r"\bFile\.\w+|send_file", "deserialization": r"Marshal\.load|YAML\.load", "open_redirect": r"redirect_to", "ssrf": r"Net::HTTP\.\w+|\b(HTTParty|RestClient|Faraday|URI)\.(get|post|put|open|new)\b"},
    "csharp": {"sqli": r"SqlCommand\s*\(|ExecuteSql\w+\s*\(|FromSqlRaw\s*\(|CommandText\s*=", "cmdi": r"Process\.Start\s*\(", "path_traversal": r"\bFile\.\w+\s*\(|Path\.Combine\s*\(", "deserialization": r"\.Deserialize\s*\(", "open_redirect": r"\bRedirect\s*\(", "xss": r"Html\.Raw\s*\(|Response\.Write\s*\(", "ssrf": r"\.(GetAsync|PostAsync|GetStringAsync|DownloadString)\s*\(|WebRequest\.Create\s*\(", "xxe": r"\.LoadXml\s*\(|XmlReader\.Create\s*\(|new\s+XmlTextReader\s*\("},
    "go": {"sqli": r"\.(Query|QueryRow|Exec|Raw)\w*\s*\(", "cmdi": r"exec\.Command\w*\s*\(|syscall\.Exec\s*\(", "ssrf": r"\b(http|client)\.(Get|Post|Head|NewRequest|Do)\s*\(", "path_traversal": r"os\.(Open|ReadFile|Create)\s*\(|filepath\.Join\s*\(", "xss": r"fmt\.Fprintf?\s*\(\s*w|w\.Write\s*\(|template\.HTML\s*\(", "ssti": r"template\.(New|Must)\s*\(.*\.Parse\s*\("},
    "java": {"sqli": r"\.(executeQuery|executeUpdate|execute|createQuery|createNativeQuery)\s*\(", "cmdi": r"\.exec\s*\(|ProcessBuilder\s*\(", "path_traversal": r"new\s+(File\w*)\s*\(|Paths\.get\s*\(", "xxe": r"\.parse\s*\(|saxReader\.read\s*\(", "deserialization": r"\.readObject\s*\(|xstream\.fromXML\s*\(|\.readValue\s*\(", "ssrf": r"new\s+URL\s*\(", "xss": r"getWriter\(\)\.\w+\s*\(", "ssti": r"\.(evaluate|mergeTemplate|parseExpression)\s*\(|new\s+Template\s*\(", "ldap": r"\b(ctx|context|ldapTemplate)\.search\s*\("},
}
# Calls that make a value safe; for all types, on the right side of an assignment.
SANITIZERS = {
    "python": r"shlex\.quote\s*\(|html\.escape\s*\(|bleach\.clean\s*\(|secure_filename\s*\(|\bint\s*\(|os\.path\.basename\s*\(",
    "javascript": r"DOMPurify\.sanitize\s*\(|escapeHtml\s*\(|encodeURIComponent\s*\(|parse(Int|Float)\s*\(|\bNumber\s*\(",
    "php": r"htmlspecialchars\s*\(|htmlentities\s*\(|strip_tags\s*\(|basename\s*\(|realpath\s*\(|->prepare\s*\(|real_escape_string\s*\(|intval\s*\(|floatval\s*\(",
    "ruby": r"sanitize\w*\s*\(|Shellwords\.escape|\.to_i\b|File\.basename|CGI\.escapeHTML",
    "csharp": r"HtmlEncode\s*\(|int\.Parse\s*\(|Path\.GetFileName\s*\(|Parameters\.Add",
    "go": r"html\.EscapeString\s*\(|filepath\.Clean\s*\(|url\.QueryEscape\s*\(|strconv\.Atoi\s*\(|\.Prepare\s*\(",
    "java": r"escapeHtml\d?\s*\(|Encode\.for\w+\s*\(|Integer\.parseInt\s*\(|getCanonicalPath\s*\(|prepareStatement\s*\(|setString\s*\(",
}
# Calls that make a value safe for one type of sink, on the sink's own line.
INLINE = {
    "php": {"xss": r"htmlspecialchars\s*\(|htmlentities\s*\(|strip_tags\s*\(|urlencode\s*\(", "sqli": r"->prepare\s*\(|real_escape_string\s*\(|intval\s*\(", "path_traversal": r"\bbasename\s*\(|realpath\s*\("},
    "javascript": {"xss": r"DOMPurify\.sanitize\s*\(|escapeHtml\s*\(|encodeURIComponent\s*\("},
}
# Query builders that bind their values. In Java a "+" in the line takes that back.
BOUND = {"go": r"\.(Where|First|Find|Take|Last)\s*\(", "java": r"setParameter\s*\(|\.createQuery\s*\(\s*\"[^\"]*:\w+|CriteriaBuilder|@Query\s*\("}
NEAR = 20


def kin(language: Column) -> Column:
    return F.when(language == "typescript", "javascript").otherwise(language)


def _of(language: Column, text: Column, regexes: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(False))
    for name, rx in regexes.items():
        out = out.when(language == name, text.rlike(rx))
    return F.coalesce(out, F.lit(False))


def line_facts(lines: DataFrame) -> DataFrame:
    """path, line_no, target (several names with commas between), words (right side), is_source, safe, sinks (array of types), tokens; lines without any fact are dropped."""
    lang = F.col("lang")
    mine = lines.withColumn("lang", kin(F.col("language"))).filter(F.col("lang").isin(sorted(SOURCES)))
    inner = F.when(lang == "javascript", F.regexp_extract("line", DESTRUCT, 1)).otherwise("")
    several = F.array_join(F.filter(F.transform(F.split(inner, ","), lambda t: F.regexp_extract(t, r"(\w+)\s*$", 1)), lambda t: t != ""), ",")
    target = F.when(several != "", several).otherwise(F.regexp_extract("line", ASSIGN, 1))
    rhs = F.when(several != "", F.regexp_extract("line", DESTRUCT, 2)).otherwise(F.regexp_extract("line", ASSIGN, 2))

    def sink(name: str, kind: str, rx: str) -> Column:
        hit = (lang == name) & F.col("line").rlike(rx)
        if kind in INLINE.get(name, {}):
            hit = hit & ~F.col("line").rlike(INLINE[name][kind])
        if kind == "sqli" and name in BOUND:
            bound = F.col("line").rlike(BOUND[name])
            hit = hit & ~(bound & ~F.col("line").contains("+") if name == "java" else bound)
        return F.when(hit, F.lit(kind))

    each = [sink(name, t, rx) for name, types in SINKS.items() for t, rx in types.items()]
    facts = mine.select(
        "path", "line_no", "lang", target.alias("target"), tokens(rhs).alias("words"),
        _of(lang, F.col("line"), {k: alternation(v) for k, v in SOURCES.items()}).alias("is_source"), _of(lang, F.col("line"), SANITIZERS).alias("safe"),
        F.array_compact(F.array(*each)).alias("sinks"), tokens(F.col("line")).alias("tokens"),
    )
    return facts.filter((F.col("target") != "") | F.col("is_source") | (F.size("sinks") > 0))


def spread(facts: DataFrame, ordered: bool = True) -> DataFrame:
    """path, var, since, origin: every tainted name of a file, from which line, and the line of its source.

    Safe assignments pass nothing on; a name once tainted stays so. With ``ordered`` a word
    must be tainted on an earlier line. Of several ways the earliest line counts, then the
    earliest source. Repeats until a round changes nothing.
    """
    stored = materialise(facts.filter((F.col("target") != "") & ~F.col("safe")).select("path", "line_no", F.explode(F.split("target", ",")).alias("target"), "words", "is_source"), "assignments")
    uses = stored.filter(~F.col("is_source")).select("path", F.col("line_no").alias("m"), "target", F.explode("words").alias("var"))

    def earliest(df: DataFrame) -> DataFrame:
        return df.groupBy("path", "var").agg(F.min(F.struct("since", "origin")).alias("t")).select("path", "var", "t.since", "t.origin")

    taint = new = materialise(earliest(stored.filter("is_source").select("path", F.col("target").alias("var"), F.col("line_no").alias("since"), F.col("line_no").alias("origin"))), "taint")
    while True:
        # Only what the last round changed is followed; a name comes out again only if its line or source is earlier than known.
        hit = uses.join(new, ["path", "var"])
        if ordered:
            hit = hit.filter(F.col("since") < F.col("m"))
        found = earliest(hit.select("path", F.col("target").alias("var"), F.col("m").alias("since"), "origin"))
        old = taint.select("path", "var", F.struct("since", "origin").alias("known"))
        better = F.col("known").isNull() | (F.struct("since", "origin") < F.col("known"))
        new = materialise(found.join(old, ["path", "var"], "left").filter(better).select("path", "var", "since", "origin"), "taint-new")
        if new.isEmpty():
            return taint
        taint = materialise(earliest(taint.unionByName(new)), "taint")


def variable_paths(facts: DataFrame, ordered: bool = True) -> DataFrame:
    """path, source_line, sink_line, sink_type, var, confidence: sinks whose line names a tainted variable.

    A sanitizer on a line from source to sink lowers likely to possible. One row per sink
    and type: the variable tainted first, then the least name.
    """
    taint = spread(facts, ordered)
    sinks = facts.filter(~F.col("safe")).select("path", F.col("line_no").alias("sink_line"), F.explode("sinks").alias("sink_type"), "tokens")
    asked = sinks.select("path", "sink_line", "sink_type", F.explode("tokens").alias("var"))
    hit = asked.join(taint, ["path", "var"])
    if ordered:
        hit = hit.filter(F.col("since") <= F.col("sink_line"))
    best = hit.groupBy("path", "sink_line", "sink_type").agg(F.min(F.struct("since", "var", "origin")).alias("b"))
    out = best.select("path", F.col("b.origin").alias("source_line"), "sink_line", "sink_type", F.col("b.var").alias("var"))
    safe = facts.filter("safe").groupBy("path").agg(F.array_sort(F.collect_set("line_no")).alias("safe_lines"))
    between = F.exists("safe_lines", lambda n: (n >= F.col("source_line")) & (n <= F.col("sink_line")))
    return out.join(safe, "path", "left").select("path", "source_line", "sink_line", "sink_type", "var", F.when(F.coalesce(between, F.lit(False)), "possible").otherwise("likely").alias("confidence"))


def near_paths(facts: DataFrame, distance: int = NEAR) -> DataFrame:
    """path, source_line, sink_line, sink_type: every source and sink at most ``distance`` lines apart.

    A band join: lines are put in buckets as wide as the band and meet the three next to
    their own by equality, so no file is crossed with itself.
    """
    bucket = lambda c: F.floor(F.col(c) / distance)
    sources = facts.filter("is_source").select("path", F.col("line_no").alias("source_line"))
    sinks = facts.select("path", F.col("line_no").alias("sink_line"), F.explode("sinks").alias("sink_type"))
    left = sources.withColumn("b", F.explode(F.array(*[bucket("source_line") + d for d in (-1, 0, 1)])))
    right = sinks.withColumn("b", bucket("sink_line"))
    near = left.join(right, ["path", "b"]).filter(F.abs(F.col("source_line") - F.col("sink_line")) <= distance)
    return near.select("path", "source_line", "sink_line", "sink_type")


FACT = "path string, line_no int, lang string, target string, words array<string>, is_source boolean, safe boolean, sinks array<string>, tokens array<string>"


def parse(content: str, lenient: bool) -> ast.AST | None:
    """The syntax tree; of a text that does not parse None, or with ``lenient`` the lines that are whole statements."""
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError):
        if not lenient:
            return None
    body: list[ast.stmt] = []
    for k, line in enumerate(content.splitlines()):
        try:
            found = ast.parse(line.strip()).body
        except (SyntaxError, ValueError, RecursionError):
            continue
        body += [ast.increment_lineno(node, k) for node in found]
    return ast.Module(body=body, type_ignores=[])


def tree_facts(content: str, lenient: bool = False) -> list[tuple]:
    """Facts of a Python file: names carry their function, so equal names in two functions stay apart.

    A file that does not parse has none, unless ``lenient`` (for fragments of files). A return assigns to ``name()``, an argument to the
    parameter of a function of the file, so taint passes through calls both ways.
    """
    import re

    tree = parse(content, lenient)
    if tree is None:
        return []
    source, safe_rx = re.compile(alternation(SOURCES["python"])), re.compile(SANITIZERS["python"])
    sinks = {t: re.compile(rx) for t, rx in SINKS["python"].items()}
    params = {f.name: [a.arg for a in f.args.args] for f in ast.walk(tree) if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)}
    out: list[tuple] = []

    def names(node: ast.AST, scope: str) -> list[str]:
        found = {f"{scope}.{n.id}" for n in ast.walk(node) if isinstance(n, ast.Name)}
        return sorted(found | {f"{n.func.id}()" for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in params})

    def add(line: int, target: str, value: ast.AST, scope: str) -> None:
        text = ast.unparse(value)
        out.append((line, "python", target, names(value, scope), bool(source.search(text)), bool(safe_rx.search(text)), [], []))

    def visit(node: ast.AST, scope: str) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            scope = node.name
        if isinstance(node, ast.Assign):
            for t in node.targets:
                if isinstance(t, ast.Name):
                    add(node.lineno, f"{scope}.{t.id}", node.value, scope)
        elif isinstance(node, ast.Return) and node.value is not None:
            add(node.lineno, f"{scope}()", node.value, scope)
        elif isinstance(node, ast.Call):
            if isinstance(node.func, ast.Name) and node.func.id in params:
                for p, a in zip(params[node.func.id], node.args, strict=False):
                    add(node.lineno, f"{node.func.id}.{p}", a, scope)
            types = [t for t, rx in sinks.items() if rx.search(ast.unparse(node.func) + "(")]
            given = [a for a in [*node.args, *[k.value for k in node.keywords]] if not safe_rx.search(ast.unparse(a))]
            if types and given:
                direct = any(source.search(ast.unparse(a)) for a in given)
                words = sorted({n for a in given for n in names(a, scope)} | ({f"@{node.lineno}"} if direct else set()))
                if direct:
                    out.append((node.lineno, "python", f"@{node.lineno}", [], True, False, [], []))
                out.append((node.lineno, "python", "", [], False, False, types, words))
        for child in ast.iter_child_nodes(node):
            visit(child, scope)

    visit(tree, "")
    return out


def python_facts(files: DataFrame, lenient: bool = False) -> DataFrame:
    """Facts of Python files (path, content) by their syntax trees, for ``variable_paths(.., ordered=False)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *f) for p, c in zip(pdf["path"], pdf["content"], strict=True) if c for f in tree_facts(c, lenient)]
            yield pd.DataFrame(rows, columns=["path", "line_no", "lang", "target", "words", "is_source", "safe", "sinks", "tokens"])

    return files.select("path", "content").mapInPandas(run, FACT)
