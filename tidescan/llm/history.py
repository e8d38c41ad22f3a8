r"""Deduplicating new batches against all history by a segment index for edit distance.

A finding's excerpt is reduced to its code tokens: numbering, comments, quotes and layout
go; names are numbered by first appearance and numbers masked, so that one renamed name or
changed number leaves the form as it is. Each form is kept whole and without its first and
last line (a context line at the edge may differ). Forms are strings of tokens; a string
is cut into ``EDITS + 1`` segments, of which at least one stands unchanged in any string
within ``EDITS`` edits. The index stores segments by (file, type, length, number); a new
item probes it with the few substrings that could match and each candidate is verified on
the real tokens. The index is a folder of tables that outlives the call: history goes into it
once, judged items are appended, and a later batch tokenises only its own texts.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions.normalize import clean_path
from tidescan.session import materialise, scratch_path
from tidescan.sources.tables import table

#: Edits between forms that the index tolerates, and edits between real tokens beyond one name and one number.
EDITS = 1
#: Forms shorter than this many tokens say too little; they match only if equal.
LEAST_TOKENS = 6

NUMBERED = re.compile(r"^\s*(?:>>>)?\s*\d+ \| ?")
COMMENT_LINE = re.compile(r"^\s*(?:#(?!\s*(?:include|define|if|endif|else|pragma|undef|import)\b)|//|/\*.*\*/\s*$|\*(?:\s|/|$)|/\*|--\s|<!--|;)")
TAIL_COMMENT = re.compile(r"\s+(?://|#|--)\s[^\"'`]*$|\s*/\*[^\"'`]*\*/\s*$")
TOKENS = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|[^\s\w\"'`\\$@]|[^\W\d_]\w*")
NAME = re.compile(r"^[^\W\d]")


def token_lines(snippet: str | None) -> list[list[str]]:
    """Code tokens by line; lines without code are dropped, null gives none."""
    raw = (snippet or "").split("\n")
    if sum(bool(NUMBERED.match(s)) for s in raw) * 2 > len(raw):
        raw = [NUMBERED.sub("", s) for s in raw]
    out = []
    for s in raw:
        s = s.strip()
        if not s or COMMENT_LINE.match(s):
            continue
        toks = TOKENS.findall(TAIL_COMMENT.sub("", s))
        if toks:
            out.append(toks)
    return out


def variants(lines: list[list[str]]) -> list[list[str]]:
    """The whole, and what is left without the first or the last line (if two lines or more are)."""
    out = [[t for s in lines for t in s]]
    if len(lines) >= 3:
        out += [[t for s in lines[1:] for t in s], [t for s in lines[:-1] for t in s]]
    return [v for v in out if v]


def form(tokens: list[str]) -> list[int]:
    """Small numbers for the tokens: names by first appearance, all numbers alike, marks by code."""
    seen: dict[str, int] = {}
    return [
        1000 + seen.setdefault(t, len(seen)) if NAME.match(t) else 1 if t[0].isdigit() else 2 + ord(t[0]) % 900
        for t in tokens
    ]


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and size of each of ``parts`` segments of a string."""
    small, long = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        size = small + (k >= parts - long)
        out.append((at, size))
        at += size
    return out


def code(key: str, length: int, number: int, part: list[int]) -> int:
    return xxhash.xxh64_intdigest(struct.pack(f"<{len(part)}H", *(x & 0xFFFF for x in part)), xxhash.xxh64_intdigest(f"{key}|{length}|{number}")) - 2**63


def stored_segments(key: str, f: list[int], edits: int = EDITS) -> set[int]:
    n = len(f)
    return {code(key, n, i, f[p : p + size]) for i, (p, size) in enumerate(bounds(n, edits + 1))}


def probed_substrings(key: str, f: list[int], edits: int = EDITS) -> set[int]:
    """Substrings that could equal a stored segment of a string within ``edits`` edits."""
    n, parts = len(f), edits + 1
    out = set()
    for length in range(max(parts, n - edits), n + edits + 1):
        gap = n - length
        for i, (p, size) in enumerate(bounds(length, parts)):
            lo = max(0, p - i, p + gap - (edits - i))
            hi = min(n - size, p + i, p + gap + (edits - i))
            out |= {code(key, length, i, f[x : x + size]) for x in range(lo, hi + 1)}
    return out


def within(a: list[str], b: list[str], most: int) -> bool:
    """Edit distance of two token lists is at most ``most`` (banded)."""
    if abs(len(a) - len(b)) > most:
        return False
    wide = most + 1
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, wide) + 1, new.get(j - 1, wide) + 1, (row.get(j - 1, wide) + (x != b[j - 1])) if j else wide)
        if min(new.values()) > most:
            return False
        row = new
    return row.get(len(b), wide) <= most


def same_code(a: list[str], b: list[str], edits: int = EDITS) -> bool:
    """Equal but for one name, one number and ``edits`` tokens."""
    if len(a) == len(b):
        pairs = {(x, y) for x, y in zip(a, b, strict=True) if x != y}
        names = [p for p in pairs if NAME.match(p[0]) and NAME.match(p[1])]
        numbers = [p for p in pairs if p[0][0].isdigit() and p[1][0].isdigit()]
        if len(names) + len(numbers) == len(pairs) and len(names) <= 1 and len(numbers) <= 1:
            return True
    return min(len(a), len(b)) >= LEAST_TOKENS and within(a, b, edits)


def same_defect(a: list[list[str]], b: list[list[str]]) -> bool:
    return any(same_code(x, y) for x in variants(a) for y in variants(b))


def plain_text(snippet):
    """Excerpt as a column without numbering, carriage returns and outer blanks, so that equal code is equal text."""
    text = F.regexp_replace(snippet, "\r", "")
    text = F.regexp_replace(text, r"(?m)^(?:>>>)?[ \t]*\d+ \| ?", "")
    return F.regexp_replace(text, r"(?m)^[ \t]+|[ \t]+$", "")


def code_groups(rows: DataFrame) -> DataFrame:
    """One row for each (file, type, text): grp, place, text, first and last order, ``fresh`` if an item is in it.

    ``rows``: file_path, vuln_type, code_snippet, ord (-1 for history). Copies, however
    many, are folded before anything else. Rows without file, type or code are dropped.
    """
    place = F.concat_ws("\n", "file_path", "vuln_type")
    keyed = (
        rows.filter(F.col("file_path").isNotNull() & F.col("vuln_type").isNotNull() & F.col("code_snippet").isNotNull())
        .select(place.alias("place"), plain_text(F.col("code_snippet")).alias("text"), "ord")
        .select(F.md5(F.concat_ws("\n\n", "place", "text")).alias("grp"), "place", "text", "ord")
    )
    return keyed.groupBy("grp").agg(
        F.first("place").alias("place"), F.first("text").alias("text"), F.min("ord").alias("first"), F.max("ord").alias("last"),
    )


def segments(groups: DataFrame, edits: int = EDITS) -> DataFrame:
    """The index rows of the groups: code, grp, first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (c, g, first)
                for g, place, text, first in zip(pdf["grp"], pdf["place"], pdf["text"], pdf["first"], strict=True)
                for c in {c for v in variants(token_lines(text)) for c in stored_segments(place, form(v), edits)}
            ]
            yield pd.DataFrame(rows, columns=["code", "grp", "first"])

    return groups.select("grp", "place", "text", "first").mapInPandas(run, "code bigint, grp string, first bigint")


def probes(groups: DataFrame, edits: int = EDITS) -> DataFrame:
    """The lookups of the groups: code, probe, last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (c, g, last)
                for g, place, text, last in zip(pdf["grp"], pdf["place"], pdf["text"], pdf["last"], strict=True)
                for c in {c for v in variants(token_lines(text)) for c in probed_substrings(place, form(v), edits)}
            ]
            yield pd.DataFrame(rows, columns=["code", "probe", "last"])

    return groups.select("grp", "place", "text", "last").mapInPandas(run, "code bigint, probe string, last bigint")


def verify(pairs: DataFrame) -> DataFrame:
    """Of pairs (probe, first, text, other) those whose code is the same: probe, first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [same_defect(token_lines(a), token_lines(b)) for a, b in zip(pdf["text"], pdf["other"], strict=True)]
            yield pdf.loc[keep, ["probe", "first"]]

    return pairs.mapInPandas(run, "probe string, first bigint")


GROUPS = "grp string, place string, text string, first bigint, last bigint"
SEGMENTS = "code bigint, grp string, first bigint"


def append(state: str, rows: DataFrame) -> DataFrame:
    """Add rows (file_path, vuln_type, code_snippet, ord) to the stored index: their groups and the segments of each. Returns the groups added."""
    groups = materialise(code_groups(rows), "code-groups")
    groups.write.mode("append").parquet(f"{state}/groups")
    segments(groups).write.mode("append").parquet(f"{state}/segments")
    return groups


def judge(items: DataFrame, state: str) -> DataFrame:
    """item_id of each item whose defect is in the stored index or in an item with a smaller item_id; the items are appended.

    Only the items are tokenised; of the history the stored segments are probed, and the texts of candidates read. An item
    without file, type or code is never a repeat. Item ids grow from batch to batch.
    """
    spark = items.sparkSession
    fresh = append(state, items.select("file_path", "vuln_type", "code_snippet", F.col("item_id").alias("ord")))
    groups = spark.read.schema(GROUPS).parquet(f"{state}/groups")
    index = spark.read.schema(SEGMENTS).parquet(f"{state}/segments")
    since = groups.select("grp", F.col("first").alias("seen")).join(fresh.select("grp"), "grp", "left_semi").groupBy("grp").agg(F.min("seen").alias("seen"))
    fresh = materialise(fresh.join(since, "grp"), "fresh-groups")
    # A text that is in the index already is known as it is; every other new text probes it.
    hits = (
        probes(fresh.filter(F.col("seen") == F.col("first"))).join(index, "code")
        .filter((F.col("probe") != F.col("grp")) & (F.col("first") < F.col("last")))
        .select("probe", "grp", "first").distinct()
    )
    texts = groups.select("grp", "first", F.col("text").alias("other"))
    pairs = (
        hits.join(texts, ["grp", "first"])
        .join(fresh.select(F.col("grp").alias("probe"), "text"), "probe")
        .select("probe", "first", "text", "other")
    )
    earliest = verify(pairs).groupBy("probe").agg(F.min("first").alias("similar"))
    known = fresh.select("grp", "seen").join(earliest.withColumnRenamed("probe", "grp"), "grp", "left").select("grp", F.least("seen", "similar").alias("since"))
    keyed = items.filter(F.col("file_path").isNotNull() & F.col("vuln_type").isNotNull() & F.col("code_snippet").isNotNull()).select(
        "item_id", F.md5(F.concat_ws("\n\n", F.concat_ws("\n", "file_path", "vuln_type"), plain_text(F.col("code_snippet")))).alias("grp")
    )
    return keyed.join(known, "grp").filter(F.col("since") < F.col("item_id")).select("item_id")


def repeats(items: DataFrame, history: DataFrame, state: str | None = None) -> DataFrame:
    """``judge`` of the items against an index made of the whole ``history`` in ``state`` (a new folder by default).

    ``items``: item_id, file_path, vuln_type, code_snippet; ``history``: the last three,
    all with canonical paths.
    """
    state = state or scratch_path(items.sparkSession, "segment-index")
    append(state, history.select("file_path", "vuln_type", "code_snippet", F.lit(-1).cast("bigint").alias("ord")))
    return judge(items, state)


def repeated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = clean_path("file_path").alias("file_path")
    items = table(spark, sf_dir, "finding_batches").select("item_id", path, "vuln_type", "code_snippet").distinct()
    history = table(spark, sf_dir, "findings").select(path, "vuln_type", "code_snippet")
    return repeats(items, history)
