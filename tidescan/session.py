"""Session helpers: a local session for tests and benches, and the shared scratch folder.

On a cluster the folder is the one named in ``spark.checkpoint.dir``; it is only
chosen here when the session names none (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "tidescan") -> SparkSession:
    """A local session with the settings the library expects (UTC, AQE, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDESCAN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``.

    Only if that is unset (local master) a fresh folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="spark-tidescan-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once.

    The archive lies in the shared folder. Where that is an object store, deploy the package with the job
    (``--py-files``) instead; nothing is done then.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidescan_shipped", False):
        return
    folder = shared_dir(spark)
    if "://" in folder.replace("file://", "", 1) or not folder.replace("file://", "", 1).startswith("/"):
        return
    package = Path(__file__).resolve().parent
    target = Path("/" + folder.removeprefix("file:").lstrip("/"), f"tidescan-{uuid.uuid4().hex}", "tidescan.zip")
    target.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, Path(package.name, f.relative_to(package)))
    sc.addPyFile(str(target))
    sc._tidescan_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/tidescan-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage with a copy that outlives any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
