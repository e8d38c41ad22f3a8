"""Secrets in lines: named detectors, high-entropy literals, masking.

The secret itself never leaves this module; only its masked form does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescan.functions.entropy import THRESHOLD, best_entropy, is_placeholder, mask
from tidescan.functions.text import alternation, extract, literal_table
from tidescan.sources.detectors import DETECTORS

#: Lines that are a comment are not read.
COMMENT = r"^\s*(#|//|\*|<!--|-- )"
#: A quoted literal long enough to measure.
QUOTED = r"""["']([A-Za-z0-9+/=_\-]{20,})["']"""


def code_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("line").isNotNull() & ~F.col("line").rlike(COMMENT))


def named_secrets(lines: DataFrame) -> DataFrame:
    """One row per line and detector that matches: secret_type, severity, evidence (masked), entropy, charset.

    The first match of each detector in a line counts; placeholders do not.
    """
    line = F.col("line")
    any_of = line.rlike(alternation([rx for _, _, rx in DETECTORS]))
    each = literal_table([(k, *d) for k, d in enumerate(DETECTORS)], ["k", "secret_type", "severity", "regex"])
    rest = [c for c in lines.columns if c != "line"]
    hit = code_lines(lines).filter(any_of).select(*rest, "line", F.explode(each).alias("d")).filter(F.regexp_like("line", F.col("d.regex")))
    raw = extract(F.col("line"), F.col("d.regex")).alias("raw")
    found = hit.select(*rest, F.struct("d.k", "d.secret_type", "d.severity", raw).alias("h")).filter(~is_placeholder(F.col("h.raw")))
    return found.select(
        *rest, "h.secret_type", "h.severity", mask(F.col("h.raw")).alias("evidence"), F.round(best_entropy(F.col("h.raw"))["entropy"], 4).alias("entropy"),
        F.lit("pattern").alias("detection_method"), F.col("h.k").alias("detector"),
    )


def entropy_secrets(lines: DataFrame) -> DataFrame:
    """One row per quoted literal whose entropy reaches the threshold, except placeholders."""
    rest = [c for c in lines.columns if c != "line"]
    token = code_lines(lines).select(*rest, F.explode(F.regexp_extract_all("line", F.lit(QUOTED), F.lit(1))).alias("token"))
    scored = token.filter(~is_placeholder(F.col("token"))).withColumn("e", best_entropy(F.col("token")))
    return scored.filter(F.col("e.entropy") >= THRESHOLD).select(
        *rest, F.lit("high_entropy_string").alias("secret_type"), F.lit("medium").alias("severity"), mask(F.col("token")).alias("evidence"),
        F.round("e.entropy", 4).alias("entropy"), F.lit("entropy").alias("detection_method"), F.lit(-1).alias("detector"),
    )


def scan_secrets(lines: DataFrame) -> DataFrame:
    return named_secrets(lines).unionByName(entropy_secrets(lines))


def history_secrets(diff_lines: DataFrame) -> DataFrame:
    """Secrets in added lines of a history (commit, file_path, line_no, line): one row per commit, file, line and type."""
    return scan_secrets(diff_lines).dropDuplicates(["commit", "file_path", "line_no", "secret_type"])
