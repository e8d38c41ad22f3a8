"""Top N items within every group by statistics-guided skipping.

The table is clustered once: range-partitioned and sorted by (group, best first) and stored as
Parquet with row groups of bounded size, so a hot group spans many row groups and tasks. Spark
tasks read the footers; a row group whose least and greatest group are equal belongs to that
group alone and has its greatest score and least tie in its statistics. Row groups are then read in
descending greatest score: first those that hold the heads of groups and, of each group's own
ones, the best until N rows are covered. Their N-th row is the group's bar, and only row groups
that are not below it are read in the second wave. All others are skipped; neither file names nor rows
reach the driver. A stored layout can be asked again with any N.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidescan.functions.normalize import severity_rank
from tidescan.session import materialise, scratch_path
from tidescan.sources.tables import finding_columns, findings_latest

#: Rows of a row group. A parameter of the clustered layout, not of the result.
BLOCK_ROWS = 2_000


def cluster(df: DataFrame, group: str, score: str, tie: str, block_rows: int = BLOCK_ROWS) -> str:
    """Store ``df`` sorted by (group, score descending, tie) in row groups of ``block_rows``; returns the path."""
    path = scratch_path(df.sparkSession, "clustered")
    order = [F.col(group), F.col(score).desc(), F.col(tie)]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("parquet.block.row.count.limit", block_rows).parquet(path)
    return path


def parquet_file(uri: str) -> pq.ParquetFile:
    files, path = pyarrow.fs.FileSystem.from_uri(unquote(uri))
    return pq.ParquetFile(files.open_input_file(path))


def block_statistics(layout: DataFrame, group: str, score: str, tie: str) -> DataFrame:
    """One row for each row group, by its footer: file, block, n, own (a single group), grp, most, least, first_tie."""
    kind = {f.name: f.dataType.simpleString() for f in layout.schema.fields}
    files = layout.select(F.col("_metadata.file_path").alias("file")).distinct()
    schema = f"file string, block int, n bigint, own boolean, grp {kind[group]}, most {kind[score]}, least {kind[score]}, first_tie {kind[tie]}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for file in pdf["file"]:
                with parquet_file(file) as f:
                    at = {f.metadata.schema.column(k).path: k for k in range(f.metadata.num_columns)}
                    for k in range(f.metadata.num_row_groups):
                        part = f.metadata.row_group(k)
                        g, s, t = (part.column(at[c]).statistics for c in (group, score, tie))
                        nulls = g.null_count if g is not None and g.has_null_count else 0
                        # Without full statistics the row group is taken as mixed, so it is read.
                        known = s is not None and s.has_min_max and g is not None
                        alone = known and (nulls == part.num_rows or nulls == 0 and g.has_min_max and g.min == g.max)
                        first = t.min if alone and t is not None and t.has_min_max and not t.null_count else None
                        rows.append((file, k, part.num_rows, alone, g.min if alone and not nulls else None, s.max if known else None, s.min if known else None, first))
            yield pd.DataFrame(rows, columns=["file", "block", "n", "own", "grp", "most", "least", "first_tie"])

    return files.mapInPandas(read, schema)


def read_blocks(blocks: DataFrame, schema) -> DataFrame:
    """The rows of the row groups (file, block), read by the tasks they are dealt to."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, mine in pdf.groupby("file"):
                with parquet_file(file) as f:
                    for k in sorted(mine["block"]):
                        yield f.read_row_group(int(k), columns=schema.names).to_pandas(types_mapper=pd.ArrowDtype)

    wide = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.select("file", "block").repartition(wide, "file", "block").mapInPandas(read, schema)


def first_wave(blocks: DataFrame, n: int) -> DataFrame:
    """``blocks`` plus ``first``: mixed row groups, and of a group's own ones the best until ``n`` rows are covered."""
    best_first = W.partitionBy("own", "grp").orderBy(F.col("most").desc(), F.col("least").desc(), "file", "block")
    before = F.sum("n").over(best_first) - F.col("n")
    return blocks.withColumn("first", ~F.col("own") | (before < n))


def second_wave(marked: DataFrame, bar: DataFrame) -> DataFrame:
    """The other row groups that are not below the bar (g, bar, bar_tie) of their group; of equal scores those that can hold a lesser tie."""
    rest = marked.filter(~F.col("first"))
    near = rest.join(bar, rest["grp"].eqNullSafe(bar["g"]))
    tied = (F.col("most") == F.col("bar")) & (F.col("first_tie").isNull() | F.col("bar_tie").isNull() | (F.col("first_tie") <= F.col("bar_tie")))
    return near.filter((F.col("most") > F.col("bar")) | tied)


def top_n_stored(spark: SparkSession, path: str, group: str, score: str, tie: str, n: int) -> DataFrame:
    """``top_n`` of a stored layout; only row groups that can hold one of the first ``n`` rows of a group are read."""
    layout = spark.read.parquet(path)
    marked = materialise(first_wave(block_statistics(layout, group, score, tie), n), "block-stats")

    def ranked(rows: DataFrame) -> DataFrame:
        order = W.partitionBy(group).orderBy(F.col(score).desc(), tie)
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    wave1 = materialise(ranked(read_blocks(marked.filter("first"), layout.schema)), "top-wave1")
    bar = wave1.filter(F.col("rank") == n).select(F.col(group).alias("g"), F.col(score).alias("bar"), F.col(tie).alias("bar_tie"))
    return ranked(wave1.drop("rank").unionByName(read_blocks(second_wave(marked, bar), layout.schema)))


def top_n(df: DataFrame, group: str, score: str, tie: str, n: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The first ``n`` rows of every group by (score descending, tie ascending); adds ``rank``.

    ``score`` must not be null (callers encode nulls into it). A null group is a group;
    a null tie comes first; rows equal in all three rank in any order. Groups smaller than
    ``n`` are kept whole; an empty table gives no rows.
    """
    return top_n_stored(df.sparkSession, cluster(df, group, score, tie, block_rows), group, score, tie, n)


def severity_score() -> Column:
    """Severity before cvss_score, nulls last, as one number: higher is worse."""
    return ((4 - severity_rank("severity")) * 1000 + F.coalesce((F.col("cvss_score") * 10).cast("int"), F.lit(-1))).cast("int")


def worst_findings(spark: SparkSession, sf_dir: str, n: int = 10) -> DataFrame:
    """The ``n`` worst current findings of every run id, known or not."""
    rows = findings_latest(spark, sf_dir, finding_columns("run_id", "severity", "cvss_score"))
    scored = rows.select("run_id", "id", severity_score().alias("score"))
    return top_n(scored, "run_id", "score", "id", n)
