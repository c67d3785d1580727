"""Placement: validated shard configurations, strategies, changes of the number of shards, membership, sharded batches."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import fnv1a, shard_of
from . import routing
from .fold import apply_batch
from .lookup import ring, ring_lookup

STRATEGIES = ("hash", "range", "consistent")


@dataclass(frozen=True)
class ShardConfig:
    """How keys are dealt to shards 0 to shards - 1: by a hash, by ranges between split points, or on a ring."""

    shards: int
    strategy: str = "hash"
    replicas: int = 1
    splits: tuple[str, ...] = field(default=())
    vnodes: int = 200

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if not 1 <= self.shards <= 1024:
            raise ValueError("shards must be from 1 to 1024")
        if not 1 <= self.replicas <= self.shards:
            raise ValueError("replicas must be from 1 to the number of shards")
        if self.strategy == "range" and (len(self.splits) != self.shards - 1 or list(self.splits) != sorted(set(self.splits))):
            raise ValueError("a range strategy needs shards - 1 rising split points")
        if self.vnodes < 1:
            raise ValueError("vnodes must be positive")


def placed(keys: DataFrame, config: ShardConfig) -> DataFrame:
    """keys (key, ...) with their shard."""
    spark = keys.sparkSession
    if config.strategy == "hash":
        return keys.withColumn("shard", shard_of(fnv1a(F.col("key")), config.shards).cast("int"))
    if config.strategy == "range":
        ends = [None, *config.splits, None]
        ranges = spark.createDataFrame([(i, ends[i], ends[i + 1]) for i in range(config.shards)], "shard int, start string, end string")
        return routing.key_shard(keys, ranges)
    nodes = spark.createDataFrame([(f"shard{i}", 1.0) for i in range(config.shards)], "node string, weight double")
    found = ring_lookup(keys, ring(nodes, config.vnodes))
    return found.withColumn("shard", F.expr("CAST(substr(node, 6) AS INT)")).drop("node", "hash")


def moves(keys: DataFrame, before: ShardConfig, after: ShardConfig) -> DataFrame:
    """source, target, n: how many of keys (key, distinct) go from one shard to another when the configuration changes."""
    at = placed(keys.select("key"), before).withColumnRenamed("shard", "source")
    now = placed(keys.select("key"), after).withColumnRenamed("shard", "target")
    return at.join(now, "key").where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def rebalance_plan(loads: DataFrame) -> DataFrame:
    """shard, load, excess: what each of a small set of shards (shard, load) has above or below an even share."""
    ends = F.broadcast(loads.agg(F.avg("load").alias("even")))  # one row
    return loads.crossJoin(ends).select("shard", "load", F.round(F.col("load") - F.col("even"), 6).alias("excess"))


def members(changes: DataFrame) -> DataFrame:
    """node, address, state: of membership changes (node, version, kind: join, leave or update; address) the nodes that are in."""
    last = changes.groupBy("node").agg(F.max_by(F.struct("kind", "address"), "version").alias("l"))
    return last.where("l.kind <> 'leave'").select("node", F.col("l.address").alias("address"))


def sharded_batch(state: DataFrame, ops: DataFrame, config: ShardConfig) -> DataFrame:
    """key, value, shard: a state after a batch (pos, key, value, op), each key in its shard."""
    return placed(apply_batch(state, ops), config)
