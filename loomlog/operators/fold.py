"""Log folding: latest and first wins, folds with MOD, batches, merges of runs, as-of reads, compaction.

All are map-side combined aggregates on the key, so a hot key reaches the shuffle as one row a task. The fold
with MOD needs only the operations after a key's last SET or DEL that starts or ends its life, which it selects
by aggregates too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import DEL, MOD, SET


def last_ops(log: DataFrame) -> DataFrame:
    """key, value, op, seq: the last operation of each key."""
    return log.groupBy("key").agg(F.max_by(F.struct("value", "op", "seq"), "seq").alias("last")).select("key", "last.value", "last.op", "last.seq")


def latest_wins(log: DataFrame) -> DataFrame:
    """State (key, value, seq) of a log of SETs and DELs."""
    return last_ops(log).where(F.col("op") != DEL).select("key", "value", "seq")


def first_wins(log: DataFrame) -> DataFrame:
    """State in which a SET of a live key changes nothing: the first SET after a key's last DEL holds."""
    deleted = log.groupBy("key").agg(F.max(F.when(F.col("op") == DEL, F.col("seq"))).alias("gone"))
    alive = log.where(F.col("op") == SET).join(deleted, "key").where("gone IS NULL OR seq > gone")
    return alive.groupBy("key").agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))


def fold_with_mod(log: DataFrame) -> DataFrame:
    """State of a log in which MOD changes a value only if its key is live.

    A key is live at its end if its last SET is after its last DEL; its value is that of the last SET or MOD,
    as every MOD after that SET found it live. So no ordered fold over a key's operations is needed.
    """
    at = {name: F.max(F.when(F.col("op") == name, F.col("seq"))).alias(name) for name in (SET, DEL)}
    written = F.col("op").isin(SET, MOD)
    ends = log.groupBy("key").agg(*at.values(), F.max_by(F.when(written, F.col("value")), F.when(written, F.col("seq"))).alias("value"), F.max(F.when(written, F.col("seq"))).alias("seq"))
    return ends.where(f"{SET} IS NOT NULL AND ({DEL} IS NULL OR {SET} > {DEL})").select("key", "value", "seq")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """State as a reader at seq sees it."""
    return latest_wins(log.where(F.col("seq") <= seq))


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """One run of the last operations of several, with tombstones: a level's compaction."""
    return last_ops(reduce(DataFrame.unionByName, runs))


def compact(runs: list[DataFrame]) -> DataFrame:
    """A bottom-level compaction: tombstones go."""
    return latest_wins(reduce(DataFrame.unionByName, runs))


def incremental(log: DataFrame, after: int, upto: int) -> DataFrame:
    """The part of a log in (after, upto]."""
    if after >= upto:
        raise ValueError("an incremental snapshot needs after < upto")
    return log.where((F.col("seq") > after) & (F.col("seq") <= upto))


def apply_batch(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a batch (pos, key, value, op), in which each key's last operation counts; MOD needs the key."""
    ops = batch.groupBy("key").agg(F.max_by(F.struct("op", F.col("value").alias("new")), "pos").alias("o")).select("key", "o.op", "o.new", F.lit(True).alias("asked"))
    joined = state.select("key", "value", F.lit(True).alias("had")).join(ops, "key", "full")
    keep = F.col("asked").isNull() | (F.col("op") == SET) | ((F.col("op") == MOD) & F.col("had"))
    return joined.where(keep).select("key", F.when(F.col("asked"), F.col("new")).otherwise(F.col("value")).alias("value"))


def set_status(log: DataFrame) -> DataFrame:
    """key, seq, status: whether an operation found its key: created, replaced, deleted or missing."""
    before = F.lag("op").over(Window.partitionBy("key").orderBy("seq"))
    live = before.isNotNull() & (before != DEL)
    status = F.when(F.col("op") == DEL, F.when(live, "deleted").otherwise("missing")).otherwise(F.when(live, "replaced").otherwise("created"))
    return log.select("key", "seq", status.alias("status"))


def batch_limits(batch: DataFrame, max_ops: int, max_bytes: int) -> DataFrame:
    """pos, group, accepted: operations of each group in order until one of the limits is reached."""
    order = Window.partitionBy("group").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    ok = (F.count("*").over(order) <= max_ops) & (F.sum(size).over(order) <= max_bytes)
    return batch.select("pos", "group", ok.alias("accepted"))


def batch_order(batch: DataFrame) -> DataFrame:
    """A batch (key, pos, ...) as engines write it: by the bytes of the key, then by arrival."""
    return batch.orderBy("key", "pos")


def bounds(log: DataFrame) -> DataFrame:
    """first, last, term: the ends of a log (idx, term), and its last term."""
    return log.agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.max_by("term", "idx").alias("term"))


def entries(log: DataFrame, first: int, last: int) -> DataFrame:
    """Entries from one index to another, both in the range."""
    return log.where(F.col("idx").between(first, last))
