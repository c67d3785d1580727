"""Replicated logs and shards: batches for replicas, repair, conflicts, apply, migration, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import commit_index
from .fold import latest_wins
from .lookup import diverging, first_conflict


def batches(log: DataFrame, replicated: int, size: int) -> DataFrame:
    """batch, first, last, entries, bytes: the part of a log (idx from 1 without gaps, key, value) after an index, in batches of `size`."""
    rows = log.where(F.col("idx") > replicated).withColumn("batch", F.expr(f"(idx - {replicated} - 1) div {size}"))
    length = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return rows.groupBy("batch").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("entries"), F.sum(length).alias("bytes"))


def repaired(primary: DataFrame, replica: DataFrame, key: str) -> DataFrame:
    """The replica with the primary's entries that it lacks."""
    return replica.unionByName(diverging(primary, replica, key))


def overridden(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """The follower's log (idx, term, ...) after the leader's: cut from the first conflict on, then the leader's entries beyond."""
    conflict = first_conflict(leader, follower)
    end = follower.agg(F.max("idx").alias("end"))
    cut = F.broadcast(conflict.crossJoin(end).select(F.coalesce("idx", F.col("end") + 1, F.lit(0)).alias("_cut")))  # one row
    kept = follower.crossJoin(cut).where("idx < _cut").drop("_cut")
    return kept.unionByName(leader.crossJoin(cut).where("idx >= _cut").drop("_cut"))


def applied(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """State of the committed part of a log (seq, key, value, op): up to what a majority of nodes (node, matched) has."""
    commit = F.broadcast(commit_index(nodes))  # one row
    return latest_wins(log.crossJoin(commit).where("seq <= commit").drop("commit"))


def migrated(state: DataFrame, start: str, end: str, target: Column) -> DataFrame:
    """state (key, value, shard) with the keys from start to end (exclusive) under another shard."""
    return state.withColumn("shard", F.when((F.col("key") >= start) & (F.col("key") < end), target).otherwise(F.col("shard")))


def migration_progress(tasks: DataFrame) -> DataFrame:
    """task, percent, rate: of tasks (task, total, moved, bytes, seconds); none of nothing, nothing in no time."""
    percent = F.coalesce(F.try_divide(F.col("moved") * F.lit(100.0).cast("double"), F.col("total")), F.lit(0.0))
    rate = F.coalesce(F.try_divide(F.col("bytes").cast("double"), F.col("seconds")), F.lit(0.0))
    return tasks.select("task", F.round(percent, 6).alias("percent"), F.round(rate, 6).alias("rate"))


def shard_states(changes: DataFrame) -> DataFrame:
    """shard, state, progress, primary: the last change of each shard (shard, version, state, progress, primary, target); the target
    is the primary once all has been moved."""
    last = changes.groupBy("shard").agg(F.max_by(F.struct("state", "progress", "primary", "target"), "version").alias("l")).select("shard", "l.*")
    done = (F.col("state") == "migrating") & (F.col("progress") >= 100)
    return last.select("shard", F.when(done, "active").otherwise(F.col("state")).alias("state"), "progress", F.when(done, F.col("target")).otherwise(F.col("primary")).alias("primary"))


def replication_stats(sent: DataFrame) -> DataFrame:
    """dc, batches, entries, mean_ms, success: of batches (dc, entries, ms, ok); mean and share over all of them."""
    return sent.groupBy("dc").agg(F.count("*").alias("batches"), F.sum("entries").alias("entries"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("success"))


def consistency_score(dcs: DataFrame) -> DataFrame:
    """score: the share of data centres (dc, consistent) that agree with the primary."""
    return dcs.agg(F.round(F.avg(F.col("consistent").cast("int")), 6).alias("score"))
