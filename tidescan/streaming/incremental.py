"""Scanning files as they arrive: a file stream whose batches are swept and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidescan.operators.sweep import candidates

SCHEMA = "path string, language string, size bigint, is_test boolean, content string"


def scan_arrivals(spark: SparkSession, source: str, out: str, state: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Sweep the Parquet files of SCHEMA that appear below ``source``; append candidates to ``out``.

    ``state`` keeps what was read, so a restarted stream goes on where it ended. Each batch is written under its
    number, so a batch that is run again replaces its own output.
    """
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def sweep(batch: DataFrame, number: int) -> None:
        candidates(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(sweep).option("checkpointLocation", state).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, time: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Findings per window and severity of a stream of findings with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "severity").agg(F.count(F.lit(1)).alias("n"))
