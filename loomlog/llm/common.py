"""What the operators of this subpackage share: tables, sizes and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that an operator broadcasts by itself; beyond it each operator has another way.
BROADCAST_BYTES = 16 * 1024 * 1024
BATCH_BYTES = 4 * 1024 * 1024


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (or one row), so that Python workers hold little at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"[bB]$", "", spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's reader only, so any store that Spark reads will do."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode; on a cluster that is an
    error, as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomlog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it again.

    The files outlive lost executors. They stay until the shared folder is emptied, or clean_up() is called when no
    result is read any more.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of tables that this process has written and not yet removed.
_WRITTEN: list[str] = []


def clean_up(spark: SparkSession) -> int:
    """Remove all tables that written() has left; results that still read them can't be read after it. Returns how many went."""
    jvm, gone = spark.sparkContext._jvm, len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def text_bytes(df: DataFrame, column: str) -> int:
    """Bytes of a text column over all rows."""
    bounded_batches(df.sparkSession)
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names close to those asked for that clash with no column of df, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def by_ids(df: DataFrame, ids: DataFrame, how: str = "left_semi", key: str = "doc_id", max_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """Semi or anti join of wide rows with ids (a written table of one long column).

    While the ids take at most max_broadcast bytes they travel to the rows, which then aren't shuffled; beyond
    that Spark shuffles both sides.
    """
    small = 16 * ids.count() <= max_broadcast
    return df.join(F.broadcast(ids) if small else ids.hint("shuffle_merge"), key, how)


#: What a Python worker keeps from one task to the next: one owner's things at a time.
_KEPT: dict[str, object] = {}


def kept_in_worker(owner: str, make) -> object:
    """make(), once in a worker process for as long as no other owner asks, so memory holds one cache at most."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = make()
    return _KEPT[owner]
