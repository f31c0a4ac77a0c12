"""Reading documents and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, file_hash, size, text) of the UTF-8 text files under ``path``; the hash is that of the bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; dates in ISO form."""
    df.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated with a header; nested columns as JSON."""
    nested = [c for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("header", "true").csv(path)


def safe_file_name(name):
    """A file name without illegal characters or blanks, 80 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"(?U)\s+", "_"), 1, 80)
