"""Security analytics over source code, manifests and free text as PySpark DataFrames."""
