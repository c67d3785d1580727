"""Streams of log rows: folds, hot-key windows, heartbeats, smoothed rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import DEL


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of Parquet files as they come."""
    return spark.readStream.schema(schema).parquet(path)


def live_state(log: DataFrame) -> DataFrame:
    """key, value, op, seq: the last operation of each key so far; for complete or update output."""
    return log.groupBy("key").agg(F.max_by(F.struct("value", "op", "seq"), "seq").alias("last")).select("key", "last.*").where(F.col("op") != DEL)


def events_of(log: DataFrame, kinds: list[str], column: str = "op") -> DataFrame:
    return log.where(F.col(column).isin(*kinds))


def hot_windows(log: DataFrame, key: str = "key", time: str = "ts", size: str = "1 hour", late: str = "10 minutes", threshold: int = 1, slide: str | None = None) -> DataFrame:
    """start, key, n: keys with at least threshold accesses in a window, tumbling or (with slide) sliding. A stream drops what is later
    than the watermark. (An extension: there is event time here.)"""
    rows = log.withWatermark(time, late) if log.isStreaming else log
    return rows.groupBy(F.window(time, size, slide).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).where(F.col("n") >= threshold).select(F.col("w.start").alias("start"), "key", "n")


def sessions(log: DataFrame, key: str = "key", time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, start, end, n: stretches of a key's accesses without a gap."""
    rows = log.withWatermark(time, late) if log.isStreaming else log
    return rows.groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def retained(samples: DataFrame, time: str, now: str, seconds: int) -> DataFrame:
    """Samples of the last seconds before now."""
    return samples.where(F.col(time) >= F.lit(now).cast("timestamp_ntz") - F.make_interval(secs=F.lit(seconds)))


def fan_out(events: DataFrame, subscriptions: DataFrame, kind: str = "event_type") -> DataFrame:
    """A row for each event and subscriber (subscriptions: subscriber, kind; null: every kind). Subscriptions are a small table."""
    wanted = subscriptions.select("subscriber", F.col("kind").alias("_kind"))
    one = events.join(F.broadcast(wanted.where("_kind IS NOT NULL")), F.col(kind) == F.col("_kind")).drop("_kind")
    every = wanted.where("_kind IS NULL").agg(F.collect_list("subscriber").alias("s"))  # one row
    return one.unionByName(events.crossJoin(F.broadcast(every)).withColumn("subscriber", F.explode("s")).drop("s"))


def each_batch(log: DataFrame, path: str, f: Callable[[DataFrame, int], None]):
    """Start a stream that hands every micro-batch to a caller's function; path: its checkpoint. Returns the query."""
    return log.writeStream.foreachBatch(f).option("checkpointLocation", path).trigger(availableNow=True).start()


def silent(log: DataFrame, node: str, time: str, now: str, seconds: int) -> DataFrame:
    """node, last, offline: nodes by their last heartbeat."""
    last = log.groupBy(F.col(node).alias("node")).agg(F.max(time).alias("last"))
    return last.withColumn("offline", F.col("last") + F.make_interval(secs=F.lit(seconds)) < F.lit(now).cast("timestamp_ntz"))


def smoothed(log: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """key, rate: an exponentially weighted mean for each key, kept over micro-batches; values of a batch in order of seq."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rate = state.get[0] if state.exists else 0.0
        for x in pd.concat(batches).sort_values("seq")["value"]:
            rate += alpha * (x - rate)
        state.update((rate,))
        yield pd.DataFrame({"key": [k[0]], "rate": [rate]})

    rows = log.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"), "seq")
    return rows.groupBy("key").applyInPandasWithState(update, "key string, rate double", "rate double", "update", GroupStateTimeout.NoTimeout)


def breaker(log: DataFrame, node: str, failed: str, order: str, threshold: int) -> DataFrame:
    """node, order, open: whether a node's circuit is open after each call, i.e. its last `threshold` calls all failed."""
    from pyspark.sql import Window

    last = Window.partitionBy(node).orderBy(order).rowsBetween(1 - threshold, 0)
    return log.select(node, order, ((F.count("*").over(last) == threshold) & F.bool_and(failed).over(last)).alias("open"))


BREAKER = "node string, at long, state string, allowed boolean"


def breaker_states(calls: DataFrame, threshold: int, timeout: int) -> DataFrame:
    """BREAKER: the circuit of each node after each of its calls (node, at in seconds, failed), in order.

    Closed until `threshold` calls in a row failed; then open, refusing calls, for `timeout` seconds; the next call is let through
    half-open: success closes the circuit, failure opens it again. A node's calls are replayed in order by one task, in batches, and
    only its state is kept."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state, failures, since = None, "closed", 0, 0
        for batch in batches:
            out = []
            for name, at, failed in zip(batch["node"], batch["at"], batch["failed"], strict=True):
                if name != node:
                    node, state, failures, since = name, "closed", 0, 0
                allowed = True
                if state == "open":
                    if at - since >= timeout:
                        state = "half-open"
                    else:
                        allowed = False
                if allowed:
                    if not failed:
                        state, failures = "closed", 0
                    else:
                        failures += 1
                        if state == "half-open" or failures >= threshold:
                            state, failures, since = "open", 0, at
                out.append((name, at, state, allowed))
            yield pd.DataFrame(out, columns=["node", "at", "state", "allowed"])

    rows = calls.select(F.col("node").cast("string").alias("node"), F.col("at").cast("long").alias("at"), "failed")
    return rows.repartition("node").sortWithinPartitions("node", "at", "failed").mapInPandas(replay, BREAKER)
