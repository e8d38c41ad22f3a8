"""Pieces of oracle SQL shared by the query modules (DuckDB dialect)."""

from __future__ import annotations

from tidescan.functions import languages as L
from tidescan.functions.normalize import SQL_CLEAN_PATH

BREAK = "\\r\\n|\\n|\\r"


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], columns: list[str], name: str) -> str:
    """``name(columns) AS (VALUES ..)`` for a WITH clause."""
    cell = lambda v: text(v) if isinstance(v, str) or v is None else repr(v)
    return f"{name}({', '.join(columns)}) AS (VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


def language_of(path: str) -> str:
    name = f"lower(regexp_extract({path}, '([^/]*)$', 1))"
    ext = f"lower(regexp_extract({path}, '[^/.](\\.[^./]+)$', 1))"
    cases = "".join(f" WHEN {ext} IN ({', '.join(text(e) for e in ends)}) THEN '{lang}'" for lang, ends in L.EXTENSIONS.items())
    return (
        f"CASE WHEN {name} = 'dockerfile' THEN 'dockerfile' WHEN {name} = '.env' OR {name} LIKE '.env.%' THEN 'dotenv' "
        f"WHEN {name} IN ('gemfile', 'gemfile.lock') THEN 'ruby' WHEN {name} IN ('makefile', 'gnumakefile') THEN 'make'{cases} ELSE 'unknown' END"
    )


def spelled_language(column: str) -> str:
    low = f"lower(trim({column}))"
    return f"CASE {''.join(f' WHEN {low} = {text(a)} THEN {text(b)}' for a, b in L.LANGUAGE_ALIASES.items())} ELSE {low} END"


_PATH = SQL_CLEAN_PATH.format("path")
FILES = (
    f"files AS (SELECT DISTINCT p AS path, coalesce({spelled_language('language')}, {language_of('p')}) AS language, size, is_test, content "
    f"FROM (SELECT *, {_PATH} AS p FROM source_files))"
)


def lines_of(source: str, content: str, keep: str, name: str = "lines") -> str:
    """``name AS (..)``: the columns ``keep``, line_no, line; a trailing empty line is dropped."""
    return (
        f"_{name} AS (SELECT {keep}, string_split_regex({content}, '{BREAK}') AS _l FROM {source} WHERE {content} IS NOT NULL), "
        f"{name} AS (SELECT {keep}, generate_subscripts(_c, 1) AS line_no, unnest(_c) AS line FROM "
        f"(SELECT {keep}, CASE WHEN _l[-1] = '' THEN _l[:-2] ELSE _l END AS _c FROM _{name}))"
    )


FILE_LINES = FILES + ", " + lines_of("files", "content", "path, language")


def rule_set(language: str, known: list[str]) -> str:
    return (
        f"CASE WHEN {language} IN ({', '.join(text(k) for k in known)}) THEN {language} WHEN {language} = 'typescript' THEN 'javascript' "
        f"WHEN {language} = 'cpp' THEN 'c' WHEN {language} IN ('github_actions', 'gitlab_ci', 'docker_compose', 'kubernetes') THEN 'yaml' ELSE 'generic' END"
    )
