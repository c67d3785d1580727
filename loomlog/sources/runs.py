"""Sorted runs on Parquet with a manifest of key ranges: readers that skip files, row groups and Bloom-filtered pages.

A run is written sorted by key (persist.write_run). The manifest has a row for each file with its least and
greatest key, so a reader opens only files that can hold what it looks for; the predicate on the stored key
column then reaches the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .persist import write_run

MANIFEST = "level int, file string, min_key string, max_key string, entries long"


def file_ranges(spark: SparkSession, path: str, level: int) -> DataFrame:
    """MANIFEST of a run's files."""
    at = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"))
    return at.select(F.lit(level).alias("level"), "file", "min_key", "max_key", "entries")


def flush(rows: DataFrame, path: str, manifest: str, level: int = 0, keys: int | None = None) -> None:
    """Write rows as a run of a level and enter its files in the manifest."""
    write_run(rows, path, keys)
    file_ranges(rows.sparkSession, path, level).coalesce(1).write.mode("append").parquet(manifest)


def read_manifest(spark: SparkSession, manifest: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(manifest)


def level_stats(entries: DataFrame) -> DataFrame:
    """level, files, entries, min_key, max_key."""
    return entries.groupBy("level").agg(F.count("*").alias("files"), F.sum("entries").alias("entries"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def files_between(entries: DataFrame, start: str | None, end: str | None) -> list[str]:
    """Files that may hold keys from start to end (both in the range). Only their names come to the driver."""
    if start is not None:
        entries = entries.where(F.col("max_key") >= start)
    if end is not None:
        entries = entries.where(F.col("min_key") <= end)
    return [r["file"] for r in entries.select("file").distinct().collect()]


def scan_runs(spark: SparkSession, entries: DataFrame, schema, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of all runs from start to end (both in the range), unmerged; no file outside of it is opened."""
    found = files_between(entries, start, end)
    rows = spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)
    if start is not None:
        rows = rows.where(F.col("key") >= start)
    return rows if end is None else rows.where(F.col("key") <= end)


def get_from_runs(spark: SparkSession, entries: DataFrame, schema, key: str) -> DataFrame:
    return scan_runs(spark, entries, schema, key, key)
