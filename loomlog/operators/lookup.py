"""Keyed lookups: batches, shards, the consistent-hash ring, replicas, routing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import U64, sha64, sha64_hex

RING = 1 << 64


def batch_get(keys: DataFrame, state: DataFrame) -> DataFrame:
    """key, value, found: a row for each requested key."""
    return keys.join(state.select("key", "value", F.lit(True).alias("_found")), "key", "left").select("key", "value", F.coalesce("_found", F.lit(False)).alias("found"))


def missing(keys: DataFrame, state: DataFrame) -> DataFrame:
    return keys.join(state, "key", "left_anti")


def existing(keys: DataFrame, state: DataFrame) -> DataFrame:
    return keys.join(state, "key", "left_semi")


def equal_shard(h: Column, shards: int) -> Column:
    """The shard of a 64-bit hash among equal ranges: arithmetic in place of a range join."""
    width = F.lit(str(RING // shards)).cast(U64)
    return F.least(F.floor(h / width).cast("int"), F.lit(shards - 1))


def shard_table(spark: SparkSession, shards: int, nodes: int, replicas: int) -> DataFrame:
    """shard, first, last (both in the range), primary, replicas: equal ranges, the primary by number, then the next nodes."""
    width = RING // shards
    rows = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    first = (F.col("shard").cast(U64) * F.lit(str(width)).cast(U64)).cast(U64)
    last = F.when(F.col("shard") == shards - 1, F.lit(str(RING - 1)).cast(U64)).otherwise((first + F.lit(str(width - 1)).cast(U64)).cast(U64))
    return rows.select("shard", first.alias("first"), last.alias("last"), F.pmod("shard", F.lit(nodes)).alias("primary"), F.transform(F.sequence(F.lit(1), F.lit(replicas - 1)), lambda i: F.pmod(F.col("shard") + i, F.lit(nodes)).cast("int")).alias("replicas"))


def ring(nodes: DataFrame, vnodes: int) -> DataFrame:
    """vnode, node, weight: positions of `node:i` for i below vnodes. The weight moves no position."""
    at = nodes.select("node", "weight", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("i"))
    return at.select(sha64(F.concat_ws(":", "node", F.col("i").cast("string"))).alias("vnode"), "node", "weight")


#: Leading hexadecimal digits of a hash that name its arc of the ring; a key is compared with the vnodes of its own arc only.
ARC_DIGITS = 2


def ring_hex(vnode: Column) -> Column:
    return F.lpad(F.lower(F.conv(vnode.cast("string"), 10, 16)), 16, "0")


def ring_lookup(keys: DataFrame, vnodes: DataFrame) -> DataFrame:
    """keys (key, ...) with their hash and the node of the first vnode at or after the key's hash, around the ring.

    Each vnode owns the interval from the one before it; intervals are laid out by arc, which makes the range
    join an equi-join, and compared as hexadecimal digits. The ring is small (nodes times vnodes) and its window
    runs over it alone.
    """
    order = Window.orderBy("vnode")
    owned = vnodes.select("node", ring_hex(F.col("vnode")).alias("hi"), F.coalesce(ring_hex(F.lag("vnode").over(order)), F.lit("")).alias("before"))
    first = vnodes.agg(F.min_by("node", "vnode").alias("node"), F.max("vnode").alias("top"))
    rows = owned.union(first.select("node", F.lit("g").alias("hi"), ring_hex(F.col("top"))))  # what is above all vnodes
    number = lambda h: F.conv(F.substring(F.when(h == "", "0").when(h == "g", "f" * 16).otherwise(h), 1, ARC_DIGITS), 16, 10).cast("int")
    arcs = rows.withColumn("arc", F.explode(F.sequence(number(F.col("before")), number(F.col("hi")))))
    hashed = keys.withColumn("hex", sha64_hex(F.col("key"))).withColumn("arc", number(F.col("hex")))
    return hashed.join(arcs, "arc").where("hex > before AND hex <= hi").withColumn("hash", F.conv("hex", 16, 10).cast(U64)).drop("arc", "before", "hi", "hex")


def replica_lists(vnodes: DataFrame, n: int) -> DataFrame:
    """vnode, node (JSON list): of each vnode the first n distinct nodes clockwise, itself included.

    One pass back over the ring, twice around; the ring is metadata (nodes times vnodes), not data."""

    def walk(ring: pd.DataFrame) -> pd.DataFrame:
        ring = ring.sort_values("vnode")
        nodes, ahead, out = ring["node"].tolist(), [], [""] * len(ring)
        for i in [*reversed(range(len(nodes)))] * 2:
            ahead = [nodes[i], *(x for x in ahead if x != nodes[i])][:n]
            out[i] = json.dumps(ahead)
        return pd.DataFrame({"vnode": ring["vnode"], "node": out})

    return vnodes.select("vnode", "node").groupBy().applyInPandas(walk, f"vnode {U64}, node string")


def replica_set(keys: DataFrame, vnodes: DataFrame, n: int, active: DataFrame | None = None) -> DataFrame:
    """key, replicas: the first n distinct nodes clockwise from the key; of active ones (node) alone, if they are told."""
    if active is not None:
        vnodes = vnodes.join(active.select("node").distinct(), "node", "left_semi")
    found = ring_lookup(keys, replica_lists(vnodes, n))
    return found.select("key", F.from_json("node", "array<string>").alias("replicas"))


def moved_keys(keys: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """key, source, target: keys whose node differs between two rings."""
    at = ring_lookup(keys.select("key"), before).select("key", F.col("node").alias("source"))
    now = ring_lookup(keys.select("key"), after).select("key", F.col("node").alias("target"))
    return at.join(now, "key").where("source <> target")


def in_ranges(rows: DataFrame, h: Column, ranges: DataFrame, bins: int = 256) -> DataFrame:
    """rows with the columns of the range (first, last, both in it, unsigned 64 bits) that h lies in; rows in none go.

    A range counts in each bin of the hash space that it meets, which makes the range join an equi-join on the bin."""
    width = F.lit(str(RING // bins)).cast(U64)
    bin_of = lambda x: F.least(F.floor(x / width).cast("int"), F.lit(bins - 1))
    laid = ranges.withColumn("_bin", F.explode(F.sequence(bin_of(F.col("first")), bin_of(F.col("last")))))
    return rows.withColumn("_h", h).withColumn("_bin", bin_of(F.col("_h"))).join(laid, "_bin").where("_h >= first AND _h <= last").drop("_h", "_bin", "first", "last")


def diverging(primary: DataFrame, replica: DataFrame, key: str) -> DataFrame:
    """Entries of the primary's log that the replica lacks."""
    return primary.join(replica, key, "left_anti")


def first_conflict(leader: DataFrame, follower: DataFrame) -> DataFrame:
    """idx: the first index at which both logs have an entry of different terms."""
    both = leader.select("idx", "term").join(follower.select("idx", F.col("term").alias("other")), "idx")
    return both.where("term <> other").agg(F.min("idx").alias("idx"))


def nearest(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """requests (group, ...) with the healthy node of least latency in their group; nodes: group, node, latency, healthy."""
    best = nodes.where("healthy").groupBy("group").agg(F.min_by("node", F.struct("latency", "node")).alias("node"))
    return requests.join(best, "group", "left")


def numbered(requests: DataFrame, group: str, order: str, buckets: int = 64) -> DataFrame:
    """requests with nr: their number, from 1, within their group in the order of a long column.

    In two levels: each group is cut into ranges of the order column, numbered within a range, and the ranges' sums go
    before, so a large group is spread over tasks. Ranges are of equal width between the least and greatest value."""
    ends = requests.groupBy(group).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi")).withColumnRenamed(group, "_g")
    at = F.floor((F.col(order) - F.col("_lo")) * F.lit(buckets) / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    rows = requests.join(ends, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_bucket", at).drop("_lo", "_hi", "_g")
    sums = rows.groupBy(F.col(group).alias("_g"), F.col("_bucket").alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(order)))
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("nr", F.col("_rank") + F.col("_start")).drop("_bucket", "_rank", "_g", "_b", "_start")


def round_robin(requests: DataFrame, nodes: int, order: str) -> DataFrame:
    """requests (group, ...) with node = (their number within their group, from 1) mod nodes."""
    return numbered(requests, "group", order).withColumn("node", F.pmod("nr", F.lit(nodes))).drop("nr")
