"""Version numbers and ranges as native expressions (arrays compare element by element)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = 4


def parse_version(version: Column) -> Column:
    """Four integers: everything but digits and dots is dropped, missing or bad parts are 0 (so 1.0rc1 is 1.01)."""
    parts = F.transform(F.split(F.regexp_replace(version, "[^0-9.]", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array(*[F.lit(0)] * PARTS)), 1, PARTS)


def _holds(current: Column, condition: Column) -> Column:
    op = F.regexp_extract(condition, r"^\s*([<>]=?|==)\s*[\d.]+", 1)
    target = parse_version(F.regexp_extract(condition, r"^\s*(?:[<>]=?|==)\s*([\d.]+)", 1))
    return (
        F.when(op == "<", current < target).when(op == "<=", current <= target).when(op == ">", current > target)
        .when(op == ">=", current >= target).when(op == "==", current == target).otherwise(False)
    )


def version_in_range(version: Column, range_: Column, first_only: bool = False) -> Column:
    """Whether a version lies in ``a|b|..`` (any part), each part a comma list of conditions (all of them).

    ``first_only`` reads only the condition before the first comma of a part, the way
    older reports did. A condition that can't be read never holds; null gives null.
    """
    current = parse_version(version)

    def part_holds(part: Column) -> Column:
        conditions = F.split(part, ",")
        return _holds(current, conditions[0]) if first_only else F.forall(conditions, lambda c: _holds(current, c))

    return F.exists(F.split(range_, r"\|"), part_holds)


def severity_of_score(cvss: Column) -> Column:
    """critical from 9, high from 7, medium from 4, low above 0, else informational; null for null."""
    return F.when(cvss >= 9, "critical").when(cvss >= 7, "high").when(cvss >= 4, "medium").when(cvss > 0, "low").when(cvss.isNotNull(), "informational")
