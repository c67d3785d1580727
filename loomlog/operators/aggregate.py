"""Operational statistics: distributions, percentiles, rates, hot keys, load and imbalance, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges into which distinct values are cut for running sums.
RANGES = 64


def histogram(df: DataFrame, value: str, low: float, high: float, buckets: int) -> DataFrame:
    """bucket, n: fixed-width buckets; what is out of range counts in the first or last."""
    at = F.floor((F.col(value) - low) / ((high - low) / buckets))
    return df.where(F.col(value).isNotNull()).groupBy(F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def rank_percentiles(df: DataFrame, value: str, ranks: dict[str, Column]) -> DataFrame:
    """name, value: order statistics. Ranks (0-based) are expressions of n, the number of values.

    Values are counted first, so equal ones are one row; a running sum over distinct values in ranges, made in
    two levels (per range of the sorted values, then over the ranges), finds the ranks without a sort in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # the range is a column of the row, not of how Spark deals rows out: how many of the edges, quantiles of the values, it reaches
    edges = F.broadcast(counts.agg(F.percentile_approx("v", [i / RANGES for i in range(1, RANGES)], 100 * RANGES).alias("edges")))  # one row
    ranged = counts.crossJoin(edges).withColumn("part", F.size(F.filter("edges", lambda e: e <= F.col("v")))).drop("edges")
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("part").agg(F.sum("c").alias("total"))  # a row a range
    before = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    upto = ranged.withColumn("upto", F.sum("c").over(within)).join(F.broadcast(before), F.col("part") == F.col("p"))
    spans = upto.select("v", (F.col("before") + F.col("upto") - F.col("c")).alias("lo"), (F.col("before") + F.col("upto")).alias("hi"))
    total = counts.agg(F.sum("c").alias("n"))
    wanted = total.select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()))).alias("w")).select("w.name", "w.rank")
    return spans.join(F.broadcast(wanted), (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("name", F.col("v").alias("value"))


def floor_rank(p: float) -> Column:
    return F.floor(F.lit(p) * (F.col("n") - 1))


def scaled_rank(p: float) -> Column:
    """The other rule: floor(n * p), at most the last."""
    return F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1)


def summary(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("greatest"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("deviation"))


def meter(counts: DataFrame, time: str, count: str, alpha: float) -> DataFrame:
    """rate: exponentially weighted rate of a small ordered series of counts, from 0."""
    series = counts.agg(F.array_sort(F.collect_list(F.struct(time, count))).alias("s"))
    return series.select(F.round(F.aggregate("s", F.lit(0.0), lambda r, x: r + alpha * (x[count].cast("double") - r)), 6).alias("rate"))


def hot_keys(log: DataFrame, key: str, time: str, since: str, threshold: int, k: int) -> DataFrame:
    """key, n, last: the k keys with most accesses among those with more than threshold and one since a time."""
    counts = log.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"), F.max(time).alias("last"))
    return counts.where((F.col("n") > threshold) & (F.col("last") >= F.lit(since).cast("timestamp_ntz"))).orderBy(F.desc("n"), "key").limit(k)


def shard_distribution(df: DataFrame, shard: Column, shards: int) -> DataFrame:
    """shard, n, percent, variance: all shards, empty ones too."""
    counts = df.groupBy(shard.cast("int").alias("s")).agg(F.count("*").alias("c"))
    every = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    rows = every.join(counts, every.shard == counts.s, "left").select("shard", F.coalesce("c", F.lit(0)).alias("n"))
    all_ = Window.partitionBy()  # over one row a shard
    return rows.select("shard", "n", F.round(F.try_divide(F.col("n") * F.lit(100.0).cast("double"), F.sum("n").over(all_)), 6).alias("percent"), F.round(F.var_pop("n").over(all_), 6).alias("variance"))


def hottest_and_coldest(distribution: DataFrame) -> DataFrame:
    return distribution.agg(F.max_by("shard", F.struct("n", -F.col("shard"))).alias("hottest"), F.min_by("shard", F.struct("n", "shard")).alias("coldest"))


#: Weights of the load score; each part counts up to its norm.
LOAD_WEIGHTS = {"qps": 0.3, "storage": 0.2, "memory": 0.2, "cpu": 0.2, "network": 0.1}


def load_score(norms: dict[str, float]) -> Column:
    parts = [w * F.least(F.lit(1.0), F.col(k) / F.lit(float(norms[k]))) for k, w in LOAD_WEIGHTS.items()]
    return F.least(F.lit(1.0), sum(parts[1:], parts[0]))


def imbalance(nodes: DataFrame, threshold: float) -> DataFrame:
    """least, greatest, mean, ratio, overloaded, underloaded of nodes (node, score); one row for a bounded set of nodes."""
    mean = nodes.agg(F.avg("score").alias("mean"))
    rows = nodes.crossJoin(F.broadcast(mean))  # one row
    over, under = F.col("score") > F.col("mean") * (1 + threshold), F.col("score") < F.col("mean") * (1 - threshold)
    names = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("node").cast("string")))), ",")
    return rows.agg(F.round(F.min("score"), 6).alias("least"), F.round(F.max("score"), 6).alias("greatest"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.try_divide(F.max("score") - F.min("score"), F.avg("score")), 6).alias("ratio"), names(over).alias("overloaded"), names(under).alias("underloaded"))


def rebalanced_weights(nodes: DataFrame, limit: float) -> DataFrame:
    return nodes.where(F.col("score") > limit).select("node", F.round(1 / (1 + F.col("score")), 6).alias("weight"))


def failure_class(healthy: Column, total: Column, latency: Column, partition_ratio: float, slow: float) -> Column:
    ratio = F.try_divide(healthy, total)
    return F.when(ratio == 0, "DCFailure").when(ratio < partition_ratio, "NetworkPartition").when(latency > slow, "SlowNetwork").when(ratio < 1, "Partial").otherwise("Healthy")


def changes(log: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Rows at which a key's value differs from the one before, with it as `previous`."""
    previous = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return log.withColumn("previous", previous).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def commit_index(nodes: DataFrame) -> DataFrame:
    """commit: the greatest index that a majority of a bounded set of nodes (node, matched) has."""
    return nodes.agg(F.sort_array(F.collect_list("matched"), asc=False).alias("m")).select(F.expr("m[size(m) div 2]").alias("commit"))


def failover_target(dcs: DataFrame) -> DataFrame:
    """target: the data centre with the largest healthy ratio, ties by name."""
    return dcs.agg(F.max_by("dc", F.struct("ratio", -F.col("dc"))).alias("target"))


def counters(changes: DataFrame) -> DataFrame:
    """name, value: sums of a counter's changes (name, delta); a counter only rises, so negative ones don't count."""
    return changes.groupBy("name").agg(F.sum(F.greatest("delta", F.lit(0))).alias("value"))


def gauges(changes: DataFrame) -> DataFrame:
    """name, value: of changes (name, seq, kind: set, inc or dec; amount) the last set and what came after it."""
    last = changes.groupBy("name").agg(F.max(F.when(F.col("kind") == "set", F.col("seq"))).alias("since"))
    signed = F.when(F.col("kind") == "dec", -F.col("amount")).otherwise(F.col("amount"))
    after = changes.join(last, "name").where("since IS NULL OR seq >= since")
    return after.groupBy("name").agg(F.sum(signed).alias("value"))


#: Weights of the meters of one, five and fifteen minutes, for a tick of five seconds.
METERS = {"rate1": 0.08, "rate5": 0.016, "rate15": 0.005}


def meters(counts: DataFrame, key: str, time: str, count: str, seconds: float) -> DataFrame:
    """key, rate1, rate5, rate15, mean: exponentially weighted rates of a key's counts by tick, in order, from 0; seconds: of all ticks."""
    series = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(time, count))).alias("s"), F.sum(count).alias("total"))
    rate = lambda alpha: F.round(F.aggregate("s", F.lit(0.0), lambda r, x: r + alpha * (x[count].cast("double") - r)), 6)
    return series.select(F.col(key).alias("key"), *(rate(a).alias(name) for name, a in METERS.items()), F.round(F.col("total") / seconds, 6).alias("mean"))


def throughput(operations: Column, milliseconds: Column) -> Column:
    """Operations per second; none in no time."""
    return F.coalesce(F.try_divide(operations * F.lit(1000.0).cast("double"), milliseconds), F.lit(0.0))


def ring_load(nodes: DataFrame, threshold: float) -> DataFrame:
    """node, deviation: nodes (node, qps) whose share differs from the mean by more than a part of it; and the variance, beside each."""
    ends = F.broadcast(nodes.agg(F.avg("qps").alias("mean"), F.var_pop("qps").alias("variance")))  # one row
    deviation = F.try_divide(F.col("qps") - F.col("mean"), F.col("mean"))
    rows = nodes.crossJoin(ends).select("node", F.round(deviation, 6).alias("deviation"), F.round("variance", 6).alias("variance"))
    return rows.where(F.abs(F.col("deviation")) > threshold)


def health_pivot(nodes: DataFrame, group: str, status: str, states: list[str], value: str) -> DataFrame:
    """group, a count for each state, total, percent healthy (the first state) and the whole mean of a value."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in states]
    out = nodes.groupBy(F.col(group).alias("group")).agg(*counts, F.count("*").alias("total"), F.sum(value).alias("_sum"))
    return out.select("group", *states, "total", F.round(F.col(states[0]) * F.lit(100.0).cast("double") / F.col("total"), 6).alias("percent"), F.expr("CAST(floor(_sum) AS BIGINT) div total").alias("mean"))


def next_timers(timers: DataFrame, now: Column, k: int) -> DataFrame:
    """The k timers (deadline, id) that are due next, and whether they are due now."""
    return timers.orderBy("deadline", "id").limit(k).withColumn("due", F.col("deadline") <= now)


def allowed_failovers(events: DataFrame, key: str, time: str, cooldown: int, most: int, window: int) -> DataFrame:
    """Events with allowed: cooldown seconds after the event before, and with less than `most` events in the `window` seconds before."""
    seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    order = Window.partitionBy(key).orderBy("_s")
    gap = F.col("_s") - F.max("_s").over(order.rangeBetween(Window.unboundedPreceding, -1))
    recent = F.count("*").over(order.rangeBetween(-window, -1))
    rows = events.withColumn("_s", seconds)
    return rows.withColumn("allowed", (gap.isNull() | (gap >= cooldown)) & (recent < most)).drop("_s")
