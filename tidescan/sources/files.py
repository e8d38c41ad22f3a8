"""Source files: from a directory tree, or from the delivered table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidescan.functions import languages as L
from tidescan.functions.normalize import clean_path
from tidescan.sources.tables import table

#: Files larger than this many bytes are not scanned.
MAX_BYTES = 2 * 1024 * 1024


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """path below the root, size and content of every file; content is only read where it is used."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    cut = F.regexp_extract("path", "^(?:[a-z0-9]+:/*)?/?" + re.escape(base.split(":", 1)[-1].strip("/")) + "/(.*)$", 1)
    return found.select(cut.alias("path"), F.col("length").alias("size"), "content")


def enumerate_files(
    spark: SparkSession, root: str, languages: list[str] | None = None, exclude_dirs: list[str] | None = None, tests: bool = False, config: bool = True
) -> DataFrame:
    """Scannable files below ``root``: path, language, size, is_test, content (decoded, bad bytes replaced).

    Hidden and skipped directories (of the path below the root), files over MAX_BYTES,
    unknown languages and generated files are left out, and tests unless asked for. With
    ``languages`` only those, and configuration files if ``config``.
    """
    files = _listing(spark, root).filter((F.col("size") <= MAX_BYTES) & ~L.skipped(F.col("path"), exclude_dirs))
    files = files.withColumn("language", L.detect_language(F.col("path"))).withColumn("is_test", L.is_test(F.col("path")))
    keep = (F.col("language") != "unknown") & ~L.is_generated(F.col("path"))
    if languages:
        keep &= F.col("language").isin(languages) | (F.lit(config) & L.extension(F.col("path")).isin(L.CONFIG_EXTENSIONS))
    if not tests:
        keep &= ~F.col("is_test")
    return files.filter(keep).select("path", "language", "size", "is_test", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def enumerate_iac(spark: SparkSession, root: str) -> DataFrame:
    """Infrastructure files: path, language (their kind), size, content. Hidden directories count here."""
    files = _listing(spark, root).withColumn("language", L.iac_language(F.col("path"))).filter(F.col("language").isNotNull())
    kept = files.filter(~F.exists(L.parents(F.col("path")), lambda d: d.isin(L.SKIP_DIRS)))
    return kept.select("path", "language", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def merge_iac(files: DataFrame, iac: DataFrame) -> DataFrame:
    """``files`` and those of ``iac`` whose path is not among them."""
    return files.unionByName(iac.join(files.select("path"), "path", "left_anti"), allowMissingColumns=True)


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Dependency manifests below ``root``: manifest, content."""
    files = _listing(spark, root).filter(L.is_manifest(F.col("path")) & ~F.exists(L.parents(F.col("path")), lambda d: d.isin(L.SKIP_DIRS)))
    return files.select(F.col("path").alias("manifest"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def delivered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_files`` with canonical paths: path, language (delivered or by path), size, is_test, content; equal rows once."""
    raw = table(spark, sf_dir, "source_files")
    path = clean_path("path")
    return raw.select(
        path.alias("path"), F.coalesce(L.canonical_language(F.col("language")), L.detect_language(path)).alias("language"), "size", "is_test", "content"
    ).distinct()
