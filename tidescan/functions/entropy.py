"""Shannon entropy, masking and placeholder tests of token columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shortest token measured, the threshold, and the alphabets (characters outside are ignored).
MIN_LENGTH, THRESHOLD = 16, 4.5
CHARSETS = {"base64": "[^A-Za-z0-9+/=]", "hex": "[^0-9a-fA-F]", "url_safe": "[^A-Za-z0-9_-]"}
# Marks of a placeholder, matched in any case.
PLACEHOLDERS = [
    r"your[-_\s]?(?:api[-_\s]?)?key", "<YOUR", "example", "placeholder", "changeme", r"replace[-_\s]?me", "todo", r"\$\{", r"\$\(",
    r"process\.env\.", r"os\.environ", r"os\.getenv", r"ENV\[", r"secrets\.", r"\bFAKE\b", r"\bDUMMY\b",
]
PLACEHOLDER = "(?i)" + "|".join(PLACEHOLDERS)


def shannon_entropy(token: Column, charset: str) -> Column:
    """Bits per character over the characters of an alphabet; 0 for fewer than MIN_LENGTH of them, null for null."""
    kept = F.regexp_replace(token, CHARSETS[charset], "")
    n = F.length(kept)
    share = lambda c: F.length(F.regexp_replace(kept, F.concat(F.lit("[^"), c, F.lit("]")), "")) / n
    chars = F.array_distinct(F.filter(F.split(kept, ""), lambda c: c != ""))
    # A hyphen, plus, slash or equals sign stands for itself as the only member of a class.
    bits = F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(token.isNull(), None).when(n < MIN_LENGTH, F.lit(0.0)).otherwise(bits)


def best_entropy(token: Column) -> Column:
    """struct(entropy, charset): the greatest over the alphabets; on ties url_safe, then hex, then base64."""
    return F.array_max(
        F.array(*[F.struct(shannon_entropy(token, c).alias("entropy"), F.lit(k).alias("rank"), F.lit(c).alias("charset")) for k, c in enumerate(CHARSETS)])
    )


def is_high_entropy(token: Column) -> Column:
    return best_entropy(token)["entropy"] >= THRESHOLD


def is_placeholder(value: Column) -> Column:
    return value.rlike(PLACEHOLDER)


def mask(value: Column) -> Column:
    """At most 8 characters become ``****``; else the first quarter (at most 4), ``****``, the last 2."""
    n = F.length(value)
    head = F.least(F.lit(4), F.floor(n / 4).cast("int"))
    return F.when(n <= 8, "****").otherwise(F.concat(F.substring(value, F.lit(1), head), F.lit("****"), F.right(value, F.lit(2))))
