"""Routes of requests: by key ranges of shards, by strategy, by data centre; and what nodes own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import numbered

STRATEGIES = ("primary", "replica", "nearest", "load_balance")


def key_shard(keys: DataFrame, shards: DataFrame, max_shards: int = 100_000) -> DataFrame:
    """keys with the shard whose range of strings (start, end exclusive; null: no bound) holds the key; the least shard if several do.

    The shards' bounds (a small table; more than max_shards raise) are cut into elementary ranges, sorted, and travel to the
    keys as one array, in which each key finds its range by bisection; no row is compared with all shards."""
    if shards.count() > max_shards:
        raise ValueError(f"more than {max_shards} shards")
    import bisect

    rows = [(r["shard"], r["start"] or "", r["end"]) for r in shards.select("shard", "start", "end").collect()]
    edges = sorted({"", *(s for _, s, _ in rows), *(e for _, _, e in rows if e is not None)}, key=str.encode)
    order = [e.encode() for e in edges]
    owner: list = [None] * len(edges)
    for shard, start, end in sorted(rows, reverse=True):
        lo, hi = bisect.bisect_left(order, start.encode()), len(order) if end is None else bisect.bisect_left(order, end.encode())
        owner[lo:hi] = [shard] * max(0, hi - lo)
    shared = keys.sparkSession.sparkContext.broadcast((order, owner))

    @F.pandas_udf(shards.schema["shard"].dataType)
    def find(key):
        bounds, owners = shared.value
        return key.map(lambda k: None if k is None else owners[bisect.bisect_right(bounds, k.encode()) - 1]).astype(object)

    return keys.withColumn("shard", find("key"))


def healthy_nodes(routed: DataFrame, shards: DataFrame, nodes: DataFrame) -> DataFrame:
    """routed (key, shard) with each healthy node of the shard; shards: shard, nodes (array); nodes: node, health."""
    members = shards.select("shard", F.explode("nodes").alias("node")).join(nodes.where("health = 'Healthy'").select("node"), "node")
    return routed.join(members, "shard")


def routed(requests: DataFrame, shards: DataFrame, order: str) -> DataFrame:
    """requests (shard, strategy, ...) with their node. shards: shard, primary, replicas (array), nearest.

    The primary, a replica in turn, the nearest node, or any node in turn; turns count a strategy's requests from 1."""
    asked = numbered(requests, "strategy", order).join(shards, "shard")
    all_nodes = F.concat(F.array("primary"), F.col("replicas"))
    turn = lambda nodes: F.get(nodes, F.pmod(F.col("nr"), F.size(nodes).cast("long")).cast("int"))
    node = F.when(F.col("strategy") == "primary", F.col("primary")).when(F.col("strategy") == "replica", turn(F.col("replicas"))).when(F.col("strategy") == "nearest", F.col("nearest")).when(F.col("strategy") == "load_balance", turn(all_nodes))
    return asked.withColumn("node", node).drop("primary", "replicas", "nearest", "nr")


def data_centre(requests: DataFrame, centres: DataFrame) -> DataFrame:
    """requests (kind, level, home, ...) with a data centre: writes, and strong or linearizable reads, go to the primary; other reads
    to their own centre if it is healthy, else to the healthy one of least latency. centres: dc, primary, healthy, latency; a small table."""
    healthy = centres.where("healthy")
    ends = centres.agg(F.max(F.when(F.col("primary"), F.col("dc"))).alias("_primary")).crossJoin(healthy.agg(F.min_by("dc", F.struct("latency", "dc")).alias("_nearest")))
    own = healthy.select(F.col("dc").alias("_own"))
    strong = (F.col("kind") == "write") | F.col("level").isin("strong", "linearizable")
    out = requests.join(F.broadcast(own), F.col("home") == F.col("_own"), "left").crossJoin(F.broadcast(ends))  # one row
    return out.withColumn("dc", F.when(strong, F.col("_primary")).otherwise(F.coalesce("_own", "_nearest"))).drop("_own", "_primary", "_nearest")


def node_ranges(shards: DataFrame) -> DataFrame:
    """node, ranges (sorted): what each node owns as primary or replica; shards: shard, first, last, primary, replicas."""
    members = shards.select(F.explode(F.array_distinct(F.concat(F.array(F.col("primary").cast("int")), F.col("replicas")))).alias("node"), "shard", "first", "last")
    return members.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("shard", "first", "last"))).alias("ranges"))


def route_stats(requests: DataFrame, group: str, hit: Column, latency: Column) -> DataFrame:
    """group, requests, hit_ratio, mean, greatest: of requests."""
    return requests.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("requests"), F.round(F.avg(hit.cast("int")), 6).alias("hit_ratio"), F.round(F.avg(latency), 6).alias("mean"), F.max(latency).alias("greatest"))
