"""Questions of one cache over a whole access log; top-k queries, which run within tasks first.

lru gives what a cache of bounded size holds in the end. fifo and lfu rank keys by first use and by uses over the
whole log, evicted in between or not; what a cache holds that forgets evicted keys is replayed in `eviction`. CLOCK
depends on the whole history of one cache and is simulated in order, for each cache (partition) by itself.
"""

from __future__ import annotations

from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lru(log: DataFrame, size: int) -> DataFrame:
    """key: the last used keys of log (key, at)."""
    return log.groupBy("key").agg(F.max("at").alias("last")).orderBy(F.desc("last"), "key").limit(size).select("key")


def fifo(log: DataFrame, size: int) -> DataFrame:
    """key: the last by their first use in the log."""
    return log.groupBy("key").agg(F.min("at").alias("first")).orderBy(F.desc("first"), "key").limit(size).select("key")


def lfu(log: DataFrame, size: int) -> DataFrame:
    """key: the most used in the log, the later used on ties."""
    return log.groupBy("key").agg(F.count("*").alias("n"), F.max("at").alias("last")).orderBy(F.desc("n"), F.desc("last"), "key").limit(size).select("key")


def unexpired(entries: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """Entries (created, ...) that live at now."""
    return entries.where(F.col("created") + F.make_interval(secs=F.lit(ttl_seconds)) > F.lit(now).cast("timestamp_ntz"))


def timed(ops: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """key, value: what a cache with a time to live answers at now, after operations (key, value, op, at, created)."""
    last = ops.groupBy("key").agg(F.max_by(F.struct("value", "op", "created"), "at").alias("l")).select("key", "l.*")
    return unexpired(last.where("op <> 'DEL'"), now, ttl_seconds).select("key", "value")


def decayed(frequencies: DataFrame) -> DataFrame:
    return frequencies.withColumn("n", F.expr("n div 2"))


def hit_ratio(log: DataFrame) -> DataFrame:
    return log.agg(F.round(F.try_divide(F.count_if("hit").cast("double"), F.count("*")), 6).alias("ratio"))


def clock(log: DataFrame, size: int) -> DataFrame:
    """cache, key: what each cache of log (cache, key, at) holds under second-chance replacement."""

    def simulate(rows: pd.DataFrame) -> pd.DataFrame:
        held: OrderedDict[str, bool] = OrderedDict()
        for key in rows.sort_values(["at", "key"])["key"]:
            if key in held:
                held[key] = True
                continue
            while len(held) >= size:
                old, used = held.popitem(last=False)
                if used:
                    held[old] = False
            held[key] = False
        return pd.DataFrame({"cache": rows["cache"].iloc[0], "key": list(held)})

    return log.groupBy("cache").applyInPandas(simulate, "cache long, key string")
