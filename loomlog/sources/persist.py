"""Durable logs, snapshots and runs on Parquet, with checksums and a catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.fold import latest_wins


def checksum() -> Column:
    return F.crc32(F.concat(F.coalesce("key", F.lit("")), F.lit("\x00"), F.coalesce("value", F.lit(""))).cast("binary"))


def append_log(log: DataFrame, path: str, rows_per_file: int = 1_000_000, bytes_per_file: int | None = None) -> None:
    """Append log rows with their checksums; files rotate by number of rows, or by about a number of bytes of keys and values."""
    if bytes_per_file:
        size = log.agg(F.avg(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)))).first()[0]
        rows_per_file = max(1, int(bytes_per_file / max(size or 1, 1)))
    log.withColumn("checksum", checksum()).write.mode("append").option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_log(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The log's rows; a row whose checksum is wrong raises when it is read."""
    rows = spark.read.parquet(path)
    if verify:
        rows = rows.where(F.when(F.col("checksum") == checksum(), True).otherwise(F.raise_error(F.lit("checksum mismatch")).cast("boolean")))
    return rows.drop("checksum")


def compact_log(spark: SparkSession, path: str, out: str) -> None:
    """A new base: one row for each live key."""
    latest_wins(read_log(spark, path)).withColumn("op", F.lit("SET")).withColumn("checksum", checksum()).sortWithinPartitions("key").write.parquet(out)


def write_run(rows: DataFrame, path: str, keys: int | None = None) -> None:
    """A sorted run with row-group statistics and a Bloom filter on the key."""
    writer = rows.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true")
    if keys:
        writer = writer.option("parquet.bloom.filter.expected.ndv#key", str(keys))
    writer.parquet(path)


def write_snapshot(state: DataFrame, root: str, term: int, index: int) -> str:
    """state as `root/snapshot/term=T/index=I`; returns the path."""
    path = f"{root}/snapshot/term={term}/index={index}"
    state.withColumn("checksum", checksum()).write.mode("overwrite").parquet(path)
    return path


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's folders, by the file system that Spark uses for it; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()) if fs.exists(at) else []


def snapshot_names(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(index, term) of all snapshots, the newest first: by index, then term. No data is read."""
    found = [(int(i.partition("=")[2]), int(t.partition("=")[2])) for t in folder_names(spark, f"{root}/snapshot") for i in folder_names(spark, f"{root}/snapshot/{t}")]
    return sorted(found, reverse=True)


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """term, index, entries of all snapshots; entries from the files' footers."""
    rows = spark.read.option("basePath", f"{root}/snapshot").parquet(f"{root}/snapshot")
    return rows.groupBy("term", "index").agg(F.count("*").alias("entries"))


def snapshot_stats(spark: SparkSession, root: str) -> dict[str, int]:
    """How many snapshots there are, and their bytes on disk."""
    jvm, names = spark.sparkContext._jvm, snapshot_names(spark, root)
    paths = [jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot/term={t}/index={i}") for i, t in names]
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return {"snapshots": len(names), "bytes": sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)}


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the snapshot with the greatest index, then term."""
    index, term = snapshot_names(spark, root)[0]
    return read_log(spark, f"{root}/snapshot/term={term}/index={index}")


def prunable(spark: SparkSession, root: str, keep: int) -> DataFrame:
    """term, index of all snapshots but the newest `keep`."""
    return spark.createDataFrame([(t, i) for i, t in snapshot_names(spark, root)[keep:]], "term long, index long")


def prune(spark: SparkSession, root: str, keep: int) -> int:
    """Delete all snapshots but the newest `keep`; returns how many went."""
    jvm, gone = spark.sparkContext._jvm, snapshot_names(spark, root)[keep:]
    for index, term in gone:
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot/term={term}/index={index}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)


def snapshot_with(state: DataFrame, save: Callable[[DataFrame], None]) -> int:
    """Hand the state to a caller's own writer; returns the number of entries that it was given."""
    seen = Observation()
    save(state.observe(seen, F.count("*").alias("entries")))
    return seen.get["entries"]


def to_json_state(state: DataFrame, entries: int = 10_000) -> DataFrame:
    """json: the state as objects of about `entries` keys each, dealt by a hash of the key."""
    parts = max(1, -(-state.count() // entries))
    return state.groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("p")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("json")).select("json")


def from_json_state(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.from_json("json", "map<string,string>")).alias("key", "value"))
