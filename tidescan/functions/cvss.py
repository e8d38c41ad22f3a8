"""CVSS 3.1 base scores of vector strings, after the public specification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidescan.functions.normalize import let

# The metric weights of the specification.
WEIGHTS = {
    "AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2},
    "AC": {"L": 0.77, "H": 0.44},
    "UI": {"N": 0.85, "R": 0.62},
    "C": {"H": 0.56, "L": 0.22, "N": 0.0},
    "I": {"H": 0.56, "L": 0.22, "N": 0.0},
    "A": {"H": 0.56, "L": 0.22, "N": 0.0},
}
PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}


METRICS = ["AV", "AC", "PR", "UI", "S", "C", "I", "A"]


def _weight(value: Column, weights: dict[str, float]) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for letter, w in weights.items():
        out = out.when(value == letter, w)
    return out


def _raw(m: Column) -> Column:
    """struct(score before rounding, impact) of the metrics' letters."""
    changed = m["S"] == "C"
    pr = F.when(changed, _weight(m["PR"], PRIVILEGES["C"])).when(m["S"] == "U", _weight(m["PR"], PRIVILEGES["U"]))
    exploit = 8.22 * _weight(m["AV"], WEIGHTS["AV"]) * _weight(m["AC"], WEIGHTS["AC"]) * pr * _weight(m["UI"], WEIGHTS["UI"])
    iss = 1 - (1 - _weight(m["C"], WEIGHTS["C"])) * (1 - _weight(m["I"], WEIGHTS["I"])) * (1 - _weight(m["A"], WEIGHTS["A"]))
    impact = let(iss, lambda x: F.when(changed, 7.52 * (x - 0.029) - 3.25 * F.pow(x - 0.02, F.lit(15))).otherwise(6.42 * x))
    both = let(F.struct(impact.alias("i"), exploit.alias("e")), lambda p: F.struct(F.when(changed, 1.08 * (p["i"] + p["e"])).otherwise(p["i"] + p["e"]).alias("score"), p["i"].alias("impact")))
    return both


def base_score(vector: Column) -> Column:
    """Base score of a vector; null if the vector is null or lacks a base metric."""
    letters = F.struct(*[F.regexp_extract(vector, rf"(?:^|/){m}:([A-Z])", 1).alias(m) for m in METRICS])

    def rounded(p: Column) -> Column:
        # Rounding up to one decimal on integers, as the specification asks.
        up = let(F.round(F.least(p["score"], F.lit(10.0)) * 100000).cast("bigint"), lambda w: F.when(w % 10000 == 0, w / 100000.0).otherwise((F.floor(w / 10000) + 1) / 10.0))
        return F.when(p["score"].isNull(), None).when(p["impact"] <= 0, F.lit(0.0)).otherwise(F.round(up, 1))

    return let(let(letters, _raw), rounded)
