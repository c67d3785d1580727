"""Queries of metrics, health and stream statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import read
from ..operators import aggregate
from ..streaming import streams
from .base import query


@query("SELECT event_type AS name, CAST(sum(CASE WHEN value > 50 THEN event_id % 7 ELSE 0 END) AS BIGINT) AS value FROM events GROUP BY 1")
def counter_values(spark, d):
    delta = F.when(F.col("value") > 50, F.col("event_id") % 7).otherwise(-1)
    return aggregate.counters(read(spark, d, "events").select(F.col("event_type").alias("name"), delta.alias("delta")))


@query("""
WITH e AS (SELECT user_id AS name, event_id AS seq, CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'dec' ELSE 'inc' END AS kind, event_id % 11 AS amount FROM events),
l AS (SELECT *, max(CASE WHEN kind = 'set' THEN seq END) OVER (PARTITION BY name) AS since FROM e)
SELECT name, CAST(sum(CASE WHEN kind = 'dec' THEN -amount ELSE amount END) AS BIGINT) AS value FROM l WHERE since IS NULL OR seq >= since GROUP BY name""")
def gauge_values(spark, d):
    kind = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "error", "dec").otherwise("inc")
    return aggregate.gauges(read(spark, d, "events").select(F.col("user_id").alias("name"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 11).alias("amount")))


def _decayed(alpha):
    """The rate as a weighted sum: what came i ticks before the end counts alpha * (1 - alpha) ** i."""
    return f"round(sum(n * {alpha} * pow(1 - {alpha}, back)), 6)"


@query(f"WITH m AS (SELECT event_type AS key, date_trunc('day', ts) AS m, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY m DESC) - 1 AS back FROM m) SELECT key, {_decayed(0.08)} AS rate1, {_decayed(0.016)} AS rate5, {_decayed(0.005)} AS rate15, round(sum(n) / 1000, 6) AS mean FROM b GROUP BY key")
def meter_rates(spark, d):
    days = read(spark, d, "events").groupBy(F.col("event_type").alias("k"), F.date_trunc("day", "ts").alias("m")).agg(F.count("*").alias("n"))
    return aggregate.meters(days, "k", "m", "n", 1000.0)


@query("SELECT user_id AS key, CASE WHEN max(event_id) = min(event_id) THEN 0 ELSE round(count(*) * 1000.0 / (max(event_id) - min(event_id)), 6) END AS rate FROM events GROUP BY 1")
def throughput(spark, d):
    ends = read(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n"), (F.max("event_id") - F.min("event_id")).alias("ms"))
    return ends.select("key", F.round(aggregate.throughput(F.col("n"), F.col("ms")), 6).alias("rate"))


@query("WITH n AS (SELECT user_id % 8 AS node, CAST(sum(value) AS DOUBLE) AS qps FROM events GROUP BY 1), s AS (SELECT *, avg(qps) OVER () AS mean, var_pop(qps) OVER () AS v FROM n) SELECT node, round((qps - mean) / mean, 6) AS deviation, round(v / 1000000, 3) AS variance FROM s WHERE abs(round((qps - mean) / mean, 6)) > 0.02")
def ring_load(spark, d):
    nodes = read(spark, d, "events").groupBy((F.col("user_id") % 8).alias("node")).agg(F.sum("value").alias("qps"))
    return aggregate.ring_load(nodes, 0.02).withColumn("variance", F.round(F.col("variance") / 1_000_000, 3))


@query("SELECT user_id % 4 AS \"group\", count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) AS total, round(100.0 * count(*) FILTER (event_type = 'view') / count(*), 6) AS percent, CAST(floor(sum(value)) AS BIGINT) // count(*) AS mean FROM events GROUP BY 1")
def health_pivot(spark, d):
    return aggregate.health_pivot(read(spark, d, "events").withColumn("g", F.col("user_id") % 4), "g", "event_type", ["view", "click", "error"], "value")


@query("SELECT event_type, user_id % 3 AS third, count(*) AS n FROM events GROUP BY CUBE (event_type, third)")
def events_cube(spark, d):
    return read(spark, d, "events").withColumn("third", F.col("user_id") % 3).cube("event_type", "third").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id % 3 AS third, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (third))")
def events_grouping_sets(spark, d):
    rows = read(spark, d, "events").withColumn("third", F.col("user_id") % 3)
    return rows.groupingSets([["event_type"], ["third"]], "event_type", "third").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id % 3 AS third FROM events GROUP BY ALL")
def events_distinct(spark, d):
    return read(spark, d, "events").select("event_type", (F.col("user_id") % 3).alias("third")).distinct()


@query("SELECT ts AS deadline, event_id AS id, ts <= TIMESTAMP '2024-01-01 06:00:00' AS due FROM events ORDER BY ts, event_id LIMIT 20")
def next_timers(spark, d):
    timers = read(spark, d, "events").select(F.col("ts").alias("deadline"), F.col("event_id").alias("id"))
    return aggregate.next_timers(timers, F.lit("2024-01-01 06:00:00").cast("timestamp_ntz"), 20)


@query("""
WITH e AS (SELECT event_id, user_id % 3 AS dc, epoch(ts)::BIGINT AS s FROM (SELECT *, date_trunc('second', ts) AS t FROM events) WHERE event_type = 'error')
SELECT a.event_id, coalesce(a.s - max(b.s) >= 3600, true) AND count(b.s) FILTER (b.s >= a.s - 86400) < 3 AS allowed FROM e a LEFT JOIN e b ON b.dc = a.dc AND b.s < a.s GROUP BY a.event_id, a.s""".replace("epoch(ts)", "epoch(t)"))
def failover_allowed(spark, d):
    errors = read(spark, d, "events").where("event_type = 'error'").select("event_id", (F.col("user_id") % 3).alias("dc"), "ts")
    return aggregate.allowed_failovers(errors, "dc", "ts", 3600, 3, 86400).select("event_id", "allowed")


# Streams, as batches


@query("SELECT user_id AS key, w AS start, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL HAVING count(*) >= 2")
def hot_key_sliding(spark, d):
    out = streams.hot_windows(read(spark, d, "events"), "user_id", threshold=2, slide="30 minutes")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH e AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(first) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM e)
SELECT key, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY key, nr""")
def key_sessions(spark, d):
    out = streams.sessions(read(spark, d, "events"), "user_id", gap="2 hours")
    return out.withColumns({x: F.col(x).cast("timestamp_ntz") for x in ("start", "end")})


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 3600 SECOND")
def retained_samples(spark, d):
    return streams.retained(read(spark, d, "events"), "ts", "2024-01-20 00:00:00", 3600).select("event_id")


@query("SELECT event_id, s.subscriber FROM events e JOIN (VALUES ('a', 'error'), ('a', 'view'), ('b', 'error'), ('c', NULL), ('d', NULL)) s(subscriber, kind) ON s.kind IS NULL OR s.kind = e.event_type")
def event_fan_out(spark, d):
    wanted = spark.createDataFrame([("a", "error"), ("a", "view"), ("b", "error"), ("c", None), ("d", None)], "subscriber string, kind string")
    return streams.fan_out(read(spark, d, "events").select("event_id", "event_type"), wanted).select("event_id", "subscriber")


@query("""
WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS node, event_id AS "at", event_type = 'error' OR event_id % 3 = 0 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nr FROM events),
f AS (SELECT node, CAST(0 AS BIGINT) AS nr, CAST(0 AS BIGINT) AS "at", 'closed' AS state, 0 AS bad, CAST(0 AS BIGINT) AS since, true AS allowed FROM (SELECT DISTINCT node FROM e)
  UNION ALL SELECT node, nr, "at",
    CASE WHEN NOT ok THEN 'open' WHEN NOT failed THEN 'closed' WHEN was = 'half-open' OR bad + 1 >= 2 THEN 'open' ELSE was END,
    CASE WHEN NOT ok THEN bad WHEN NOT failed THEN 0 WHEN was = 'half-open' OR bad + 1 >= 2 THEN 0 ELSE bad + 1 END,
    CASE WHEN ok AND failed AND (was = 'half-open' OR bad + 1 >= 2) THEN "at" ELSE since END, ok
  FROM (SELECT e.node, e.nr, e."at", e.failed, f.bad, f.since, f.state <> 'open' OR e."at" - f.since >= 300 AS ok, CASE WHEN f.state = 'open' AND e."at" - f.since >= 300 THEN 'half-open' ELSE f.state END AS was FROM f JOIN e ON e.node = f.node AND e.nr = f.nr + 1))
SELECT node, "at", state, allowed FROM f WHERE nr > 0""")
def breaker_half_open(spark, d):
    calls = read(spark, d, "events").select(F.col("user_id").cast("string").alias("node"), F.col("event_id").alias("at"), ((F.col("event_type") == "error") | (F.col("event_id") % 3 == 0)).alias("failed"))
    return streams.breaker_states(calls, 2, 300)
