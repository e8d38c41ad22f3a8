"""References to records that do not exist, kept up to date period by period.

The state lies in a folder of tables and outlives the call: the references by period and hash bucket of
the referenced key, the index of parents (key, arrival, deletion) by period, and the events of each
period, whose ``pending`` ones are the references that still wait. A new period appends its own
references and parents; its distinct keys probe the index; its arriving parents resolve the
references that wait for them; its deletions reopen, and look for earlier references only in the buckets of the
deleted keys, in periods that delete at all. Nothing else of the history is read or written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions.normalize import clean_id
from tidescan.session import materialise, scratch_path
from tidescan.sources.tables import finding_columns, findings_latest, latest_versions, runs_latest, table

#: Hash buckets of the stored references.
BUCKETS = 8
KEYS = ["parent_table", "ref"]
REFERENCE = ["child_table", "child_id", *KEYS, "first_seen"]
REFS = "child_table string, child_id string, parent_table string, ref string, first_seen timestamp_ntz"
PARENTS = "parent_table string, ref string, parent_seen timestamp_ntz, deleted_in string"
STATE = REFS + ", event string"


def bucket() -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")


def advance(state: str, refs: DataFrame, parents: DataFrame, period: str, before: str | None) -> None:
    """Bring the state from the end of ``before`` to the end of ``period``.

    ``refs`` (REFS) and ``parents`` (parent_table, parent_id, parent_seen, deleted_in) are what arrived in the period;
    a deletion that falls in it is given by ``deleted_in`` of a parent that arrived in it or earlier. Written are
    ``pending`` for each reference that waits at its end, ``late`` for each that a later parent resolved, ``deleted``
    for each whose parent is deleted. A period done again gives the same tables.
    """
    spark = refs.sparkSession
    refs.select(*REFERENCE).withColumn("bucket", bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/refs/period={period}")
    parents.select("parent_table", F.col("parent_id").alias("ref"), "parent_seen", "deleted_in").write.mode("overwrite").parquet(f"{state}/parents/period={period}")
    index = spark.read.schema(PARENTS + ", period string").parquet(f"{state}/parents").filter(F.col("period") <= period)
    stored = spark.read.schema(REFS + ", period string, bucket int").parquet(f"{state}/refs")
    gone = F.col("deleted_in") <= period
    event = F.when(F.col("parent_seen").isNull(), "pending").when(gone, "deleted").when(F.col("parent_seen") > F.col("first_seen"), "late")

    new = stored.filter(F.col("period") == period).select(*REFERENCE)
    # However many references name a parent, the index is probed once for it.
    asked = index.join(new.select(*KEYS).distinct(), KEYS, "left_semi").groupBy(*KEYS).agg(F.min("parent_seen").alias("parent_seen"), F.min("deleted_in").alias("deleted_in"))
    parts = [new.join(asked, KEYS, "left").select(*REFERENCE, event.alias("event"))]
    if before is not None:
        waiting = spark.read.schema(STATE).parquet(f"{state}/events/at={before}").filter(F.col("event") == "pending").select(*REFERENCE)
        arrived = index.filter(F.col("period") == period).drop("period")
        parts.append(waiting.join(arrived, KEYS, "left").select(*REFERENCE, event.alias("event")))
        dropped = materialise(index.filter(F.col("deleted_in") == period).select(*KEYS, bucket().alias("bucket")), "orphan-dropped")
        if not dropped.isEmpty():
            earlier = stored.filter(F.col("period") < period).join(dropped, ["bucket", *KEYS], "left_semi")
            parts.append(earlier.select(*REFERENCE, F.lit("deleted").alias("event")))
    reduce(DataFrame.unionByName, parts).filter(F.col("event").isNotNull()).write.mode("overwrite").parquet(f"{state}/events/at={period}")


def orphan_events(refs: DataFrame, parents: DataFrame, state: str | None = None, after: str | None = None) -> DataFrame:
    """All events of all periods: the columns of STATE and ``at``.

    ``refs``: REFS and ``period``. ``parents``: parent_table, parent_id, parent_seen, period, deleted_in (null: never).
    With ``state``, the folder of an earlier call whose last period was ``after``, only later periods are added to it.
    The periods (months of the data) are the only thing collected. A deletion that becomes
    known later comes as another row of the parent, in the period in which it is deleted.
    """
    spark = refs.sparkSession
    refs = materialise(refs.select(*REFERENCE, "period"), "orphan-refs", ("period",))
    parents = materialise(parents, "orphan-parents", ("period",))
    # Only a handful of distinct months come to the driver, never rows.
    months = sorted(r[0] for r in refs.select("period").union(parents.select("period")).union(parents.select("deleted_in")).distinct().collect() if r[0])
    state = state or scratch_path(spark, "orphan-state")
    for month in (m for m in months if after is None or m > after):
        advance(state, refs.filter(F.col("period") == month), parents.filter(F.col("period") == month), month, after)
        after = month
    if after is None:
        return spark.createDataFrame([], STATE + ", at string")
    return spark.read.schema(STATE + ", at string").parquet(f"{state}/events")


def current_orphans(events: DataFrame) -> DataFrame:
    """child_table, child_id, ref_state, period (month of the child's first arrival).

    A deletion outweighs a late arrival, and either the wait that came before.
    """
    rank = F.when(F.col("event") == "deleted", 2).when(F.col("event") == "late", 1).otherwise(0)
    return (
        events.groupBy("child_table", "child_id")
        .agg(F.max(rank).alias("r"), F.min("first_seen").alias("first_seen"))
        .select(
            "child_table", "child_id",
            F.when(F.col("r") == 2, "deleted").when(F.col("r") == 1, "late").otherwise("missing").alias("ref_state"),
            F.date_format("first_seen", "yyyy-MM").alias("period"),
        )
    )


def period_counts(events: DataFrame) -> DataFrame:
    """The periodic snapshot: orphans waiting, resolved late and reopened at the end of each period."""
    return events.groupBy(F.col("at").alias("period"), "child_table", "event").agg(F.count(F.lit(1)).alias("n"))


def finding_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of ``findings.run_id`` against ``scan_runs`` and ``reviews.finding_id`` against ``findings``.

    Null or blank references are no case. A review's finding counts as existing even if its run was purged.
    """
    month = lambda c: F.date_format(c, "yyyy-MM")
    findings = findings_latest(spark, sf_dir, finding_columns("run_id"))
    reviews = latest_versions(
        table(spark, sf_dir, "reviews").select(clean_id("id").alias("id"), clean_id("finding_id").alias("finding_id"), "ingested_at"),
        "id", "ingested_at", ["finding_id"],
    )

    def references(child: str, parent: str, df: DataFrame, ref: str) -> DataFrame:
        return df.select(
            F.lit(child).alias("child_table"), F.col("id").alias("child_id"), F.lit(parent).alias("parent_table"),
            F.col(ref).alias("ref"), "first_seen", month("first_seen").alias("period"),
        ).filter(F.col("ref") != "")

    refs = references("findings", "scan_runs", findings, "run_id").unionByName(references("reviews", "findings", reviews, "finding_id"))
    runs = runs_latest(spark, sf_dir).select(
        F.lit("scan_runs").alias("parent_table"), F.col("id").alias("parent_id"), F.col("first_seen").alias("parent_seen"),
        month("first_seen").alias("period"), month(F.when(F.col("purged_at").isNotNull(), F.greatest("purged_at", "first_seen"))).alias("deleted_in"),
    )
    known = findings.select(
        F.lit("findings").alias("parent_table"), F.col("id").alias("parent_id"), F.col("first_seen").alias("parent_seen"),
        month("first_seen").alias("period"), F.lit(None).cast("string").alias("deleted_in"),
    )
    return orphan_events(refs, runs.unionByName(known))
