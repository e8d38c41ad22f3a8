"""What changed between consecutive full snapshots of a table.

Keys get persistent ordinals from a sorted dictionary that is stored as a table, so the
keys of one scope (here a checkout) lie next to each other. Each snapshot becomes a
sparse bitmap of 64-bit words over these ordinals (only words with a bit are stored)
plus, beside each word, the attribute vector aligned to its bits. Additions and removals
are AND-NOTs of the words of neighbouring snapshots; changes are differences of the
vectors within the AND. The bulk of the rows, which did not change, is never
joined back to its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidescan.session import materialise
from tidescan.sources.tables import finding_columns, findings_latest, runs_latest

WORD = 64


def ordinal_dictionary(keys: DataFrame, columns: list[str], known: DataFrame | None = None) -> DataFrame:
    """A stored table ``columns + ordinal`` with one ordinal for each distinct key.

    Ordinals of ``known`` (an earlier dictionary) never change; keys not in it are
    appended after its greatest ordinal. Keys are range-partitioned, so no scope,
    however large, is numbered in one task. Nulls are keys like any other value.
    """
    new = keys.select(*columns).distinct()
    base = F.lit(0).cast("bigint")
    if known is not None:
        same = [new[c].eqNullSafe(known[c]) for c in columns]
        new = new.join(known, same, "left_anti")
        start = known.agg(((F.coalesce(F.max("ordinal"), F.lit(-1)) / WORD).cast("bigint") + 1) * WORD).first()[0]
        base = F.lit(start).cast("bigint")
    numbered = (
        new.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumn("ordinal", base + F.monotonically_increasing_id())
    )
    stored = materialise(numbered, "ordinals")
    return stored if known is None else known.select(*columns, "ordinal").unionByName(stored)


def bits(word: Column) -> Column:
    """Positions of the set bits of a 64-bit word, ascending."""
    every = F.array(*[F.lit(i) for i in range(WORD)])
    return F.filter(every, lambda i: F.expr("0").cast("bigint") != word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))


def snapshot_words(encoded: DataFrame) -> DataFrame:
    """(scope, snap, ordinal, attrs, last_snap) -> one row per scope, word and snapshot."""
    pos = F.col("ordinal").bitwiseAND(F.lit(WORD - 1).cast("bigint")).cast("int")
    return (
        encoded.select(
            "scope", "snap", "last_snap", F.shiftright("ordinal", 6).alias("word_no"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), pos).alias("bit"),
            F.concat(F.lpad(pos.cast("string"), 2, "0"), F.col("attrs")).alias("entry"),
        )
        .groupBy("scope", "word_no", "snap")
        .agg(F.bit_or("bit").alias("word"), F.collect_list("entry").alias("vector"), F.max("last_snap").alias("last_snap"))
    )


def word_changes(words: DataFrame) -> DataFrame:
    """Changed ordinals: (scope, snap, ordinal, change_kind), ``snap`` being the later snapshot."""
    w = W.partitionBy("scope", "word_no").orderBy("snap")
    zero = F.lit(0).cast("bigint")
    near = words.select(
        "*",
        F.lag("snap").over(w).alias("p_snap"),
        F.lag("word").over(w).alias("p_word"),
        F.lag("vector").over(w).alias("p_vector"),
        F.lead("snap").over(w).alias("n_snap"),
    ).withColumn("follows", F.coalesce(F.col("p_snap") == F.col("snap") - 1, F.lit(False)))
    before = F.when(F.col("follows"), F.col("p_word")).otherwise(zero)
    both = F.col("word").bitwiseAND(before)
    differ = F.transform(
        F.array_except("vector", F.when(F.col("follows"), F.col("p_vector")).otherwise(F.array().cast("array<string>"))),
        lambda e: e.substr(1, 2).cast("int"),
    )
    in_both = F.filter(differ, lambda i: both.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)) != zero)
    later = F.col("snap") > 1
    empty = F.array().cast("array<int>")
    gone = (F.col("snap") < F.col("last_snap")) & (F.coalesce("n_snap", zero) != F.col("snap") + 1)
    parts = F.array(
        F.struct(F.lit("added").alias("kind"), F.col("snap").alias("snap"), F.when(later, bits(F.col("word").bitwiseAND(F.bitwise_not(before)))).otherwise(empty).alias("pos")),
        F.struct(F.lit("removed").alias("kind"), F.col("snap").alias("snap"), F.when(later, bits(before.bitwiseAND(F.bitwise_not(F.col("word"))))).otherwise(empty).alias("pos")),
        F.struct(F.lit("changed").alias("kind"), F.col("snap").alias("snap"), F.when(later, in_both).otherwise(empty).alias("pos")),
        F.struct(F.lit("removed").alias("kind"), (F.col("snap") + 1).alias("snap"), F.when(gone, bits(F.col("word"))).otherwise(empty).alias("pos")),
    )
    return (
        near.select("scope", "word_no", F.explode(F.filter(parts, lambda p: F.size(p["pos"]) > 0)).alias("p"))
        .select("scope", F.col("p.snap").alias("snap"), F.col("p.kind").alias("change_kind"), "word_no", F.explode("p.pos").alias("pos"))
        .select("scope", "snap", "change_kind", (F.col("word_no") * WORD + F.col("pos")).alias("ordinal"))
    )


def encode_attributes(columns: list[str]) -> Column:
    """A string that is equal exactly when all columns are (null equals only null)."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def diff_snapshots(rows: DataFrame, snapshots: DataFrame, key: list[str], attrs: list[str]) -> DataFrame:
    """Changes between consecutive snapshots of each scope.

    ``rows``: snapshot_id, key and attribute columns. ``snapshots``: scope, snapshot_id,
    snap (1, 2, .. in order within the scope), last_snap. A snapshot without rows is
    empty: all keys of the one before are removed. Rows of other snapshots are ignored.
    If a key is repeated within a snapshot its least attribute set counts. Result:
    snapshot_id (the later one), key columns, change_kind added, removed or changed.
    """
    keyed = materialise(
        rows.withColumn("attrs", encode_attributes(attrs))
        .join(snapshots, "snapshot_id")
        .groupBy("scope", *key, "snap", "last_snap")
        .agg(F.min("attrs").alias("attrs")),
        "snapshot-rows",
    )
    words_of = ["scope", *key]
    dictionary = ordinal_dictionary(keyed, words_of)
    same = [keyed[c].eqNullSafe(dictionary[c]) for c in words_of]
    encoded = keyed.join(dictionary, same).select(keyed["scope"], "snap", "last_snap", "ordinal", "attrs")
    changes = word_changes(snapshot_words(encoded))
    return (
        changes.join(dictionary.drop("scope"), "ordinal")
        .join(snapshots.select("scope", "snap", "snapshot_id"), ["scope", "snap"])
        .select("snapshot_id", *key, "change_kind")
    )


def scan_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that are full snapshots, numbered per checkout by (ts, id)."""
    runs = runs_latest(spark, sf_dir).filter(F.col("status").isin("complete", "pending_review") & F.col("purged_at").isNull())
    w = W.partitionBy("path")
    return runs.select(
        F.col("path").alias("scope"),
        F.col("id").alias("snapshot_id"),
        F.row_number().over(w.orderBy("ts", "id")).alias("snap"),
        F.count(F.lit(1)).over(w).cast("int").alias("last_snap"),
    )


def finding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, file_path, line_start, vuln_type, change_kind over all runs and findings."""
    attrs = ["severity", "confidence", "status", "cvss_score"]
    key = ["file_path", "line_start", "vuln_type"]
    rows = findings_latest(spark, sf_dir, finding_columns("run_id", *key, *attrs)).withColumnRenamed("run_id", "snapshot_id")
    return diff_snapshots(rows, scan_snapshots(spark, sf_dir), key, attrs).withColumnRenamed("snapshot_id", "run_id")
