"""Small facts of single languages: Java annotations that leave something open, imports of Go files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Annotation, the argument it should have, and what its absence means.
ANNOTATIONS = [("CrossOrigin", "origins", "any origin may call"), ("RequestMapping", "method", "any method is accepted")]
# Packages of Go that deserve a look, and why.
WATCHED_IMPORTS = {"text/template": "templates without escaping", "os/exec": "runs commands"}


def annotation_lints(lines: DataFrame) -> DataFrame:
    """path, line_no, annotation, note, severity for each annotation in a Java or Kotlin line that lacks its argument. A null line has none."""
    each = F.array_compact(F.array(*[
        F.when(F.col("line").rlike(rf"@{name}\b") & ~F.col("line").rlike(rf"{argument}\s*="), F.struct(F.lit(name).alias("annotation"), F.lit(note).alias("note")))
        for name, argument, note in ANNOTATIONS
    ]))
    mine = lines.filter(F.col("language").isin("java", "kotlin") & F.col("line").contains("@"))
    return mine.select("path", "line_no", F.explode(each).alias("a")).select("path", "line_no", "a.annotation", "a.note", F.lit("medium").alias("severity"))


def go_imports(files: DataFrame) -> DataFrame:
    """path, package, note: every package a Go file imports, alone or in a block, once. A null or empty file imports none."""
    block = F.array_join(F.regexp_extract_all("content", F.lit(r"(?m)^import\s*\(([^)]*)\)"), F.lit(1)), "\n")
    inner = F.regexp_extract_all(block, F.lit(r"(?m)^\s*(?:[\w.]+\s+)?\"([^\"\n]+)\""), F.lit(1))
    alone = F.regexp_extract_all("content", F.lit(r"(?m)^import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\""), F.lit(1))
    found = files.filter(F.col("language") == "go").select("path", F.explode(F.array_distinct(F.concat(alone, inner))).alias("package")).distinct()
    note = F.coalesce(*[F.when(F.col("package") == p, F.lit(why)) for p, why in WATCHED_IMPORTS.items()])
    return found.select("path", "package", note.alias("note"))
