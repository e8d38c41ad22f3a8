"""Canonical forms of ids, paths and scores as native column expressions (null in, null out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_id(c: ColumnOrName) -> Column:
    return F.lower(F.trim(_col(c)))


def clean_path(c: ColumnOrName) -> Column:
    """``.\\a\\\\b//c.py`` -> ``a/b/c.py``."""
    slashes = F.regexp_replace(F.translate(_col(c), "\\", "/"), "/+", "/")
    return F.regexp_replace(slashes, r"^(?:\./)+", "")


def clean_root(c: ColumnOrName) -> Column:
    """Checkout paths compare without trailing slashes."""
    return F.regexp_replace(_col(c), "/+$", "")


def one_decimal(c: ColumnOrName) -> Column:
    return F.round(_col(c), 1)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: The five severity words in order; anything else ranks with the last.
SEVERITIES = ["critical", "high", "medium", "low", "informational"]


def severity_rank(c: ColumnOrName) -> Column:
    """critical 0 .. low 3; informational, null and any other word 4."""
    col = clean_id(c)
    expr = F.when(col == SEVERITIES[0], 0)
    for rank, word in enumerate(SEVERITIES[1:4], 1):
        expr = expr.when(col == word, rank)
    return expr.otherwise(4)


#: DuckDB equivalents, for the oracle queries.
SQL_CLEAN_PATH = "regexp_replace(regexp_replace(replace({0}, '\\', '/'), '/+', '/', 'g'), '^(\\./)+', '')"
SQL_LATEST_FINDINGS = (
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY ingested_at DESC) AS _rn "
    "FROM findings) WHERE _rn = 1)"
)
SQL_LATEST_RUNS = (
    "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(id)) ORDER BY ingested_at DESC) AS _rn "
    "FROM scan_runs) WHERE _rn = 1)"
)
