"""Lines, tokens and excerpts of text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Every line break that counts: CR LF, and the single characters that end a line.
BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"


def split_lines(text: Column) -> Column:
    """Array of lines without a trailing empty one; empty text gives an empty array, null gives null."""
    lines = F.split(text, BREAK)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def explode_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per line: all columns but the text, ``line_no`` from 1, ``line``."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(split_lines(F.col(text))).alias("_p", "line")).select(*rest, (F.col("_p") + 1).alias("line_no"), "line")


def tokens(line: Column) -> Column:
    """The words of a line, for equality joins in place of word-boundary searches."""
    return F.array_distinct(F.regexp_extract_all(line, F.lit(r"\w+"), F.lit(0)))


def has_word(line: Column, word: Column) -> Column:
    return F.array_contains(tokens(line), word)


def snippets(lines: DataFrame, key: list[str], context: int = 3) -> DataFrame:
    """``lines`` (key, line_no, line) plus ``snippet``: the lines around each, numbered, ``>>>`` before its own."""
    w = W.partitionBy(*key).orderBy("line_no")
    near = F.collect_list(F.struct("line_no", "line")).over(w.rowsBetween(-context, context))
    mark = lambda n: F.when(n == F.col("line_no"), ">>>").otherwise("   ")
    numbered = F.transform(near, lambda r: F.concat(mark(r["line_no"]), F.lit(" "), F.lpad(r["line_no"].cast("string"), 4, " "), F.lit(" | "), r["line"]))
    return lines.withColumn("snippet", F.array_join(numbered, "\n"))


def snippet_at(line_array: Column, line_no: Column, context: int = 3) -> Column:
    """The same excerpt from a file's array of lines; '' where the line does not exist."""
    first = F.greatest(line_no - context, F.lit(1))
    last = F.least(line_no + context, F.size(line_array))
    spots = F.when((line_no >= 1) & (line_no <= F.size(line_array)), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.array_join(
        F.transform(spots, lambda n: F.concat(F.when(n == line_no, ">>> ").otherwise("    "), F.lpad(n.cast("string"), 4, " "), F.lit(" | "), F.element_at(line_array, n))), "\n"
    )


def extract(text: Column, regex: Column, group: Column | int = 0) -> Column:
    """``regexp_extract`` with an expression and a group that may be columns."""
    return F.call_function("regexp_extract", text, regex, F.lit(group) if isinstance(group, int) else group)


def literal_table(rows: list[tuple], names: list[str]) -> Column:
    """Rows as a constant array of structs, to be exploded beside a few preselected lines."""
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])


def alternation(regexes: list[str]) -> str:
    return "|".join(f"(?:{r})" for r in regexes)
