"""Queries of routing, placement and replication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..model import events_log, orders_state, read
from ..operators import lookup, replication, routing
from .base import LAST, LOG, SHA64, STATE, query

HASHED = f"(SELECT key, {SHA64.format('key')} AS hash FROM {STATE})"
#: Uneven ranges of the hash space, as fractions of 16; they leave a gap.
UNEVEN = [("a", 0, 3), ("b", 3, 4), ("c", 4, 9), ("d", 11, 16)]


@query(f"SELECT key FROM {HASHED} WHERE hash >= CAST('17293822569102704640' AS DECIMAL(20,0)) OR hash < CAST('1152921504606846976' AS DECIMAL(20,0))")
def hash_range_wrap(spark, d):
    ends = [F.lit(str(i * 2**60)).cast(scalar.U64) for i in (15, 1)]
    return orders_state(spark, d).where(scalar.in_hash_range(scalar.sha64(F.col("key")), *ends)).select("key")


@query(f"SELECT key, name AS shard FROM {HASHED} JOIN (VALUES {', '.join(f'({n!r}, {a}, {b})' for n, a, b in UNEVEN)}) s(name, a, b) ON hash // CAST(1152921504606846976 AS DECIMAL(20,0)) >= a AND hash // CAST(1152921504606846976 AS DECIMAL(20,0)) < b")
def shard_by_ranges(spark, d):
    shards = spark.createDataFrame([(n, str(a * 2**60), str(b * 2**60 - 1)) for n, a, b in UNEVEN], "shard string, first string, last string").select("shard", *(F.col(x).cast(scalar.U64).alias(x) for x in ("first", "last")))
    return lookup.in_ranges(orders_state(spark, d).select("key"), scalar.sha64(F.col("key")), shards)


KEY_RANGES = [("s1", None, "order:00000400"), ("s2", "order:00000400", "order:00000900"), ("s3", "order:00000900", "order:00001200"), ("s4", "order:00001300", None)]
KEY_SQL = "(VALUES ('s1', '', 'order:00000400'), ('s2', 'order:00000400', 'order:00000900'), ('s3', 'order:00000900', 'order:00001200'), ('s4', 'order:00001300', 'p')) s(shard, a, b)"


@query(f"SELECT key, s.shard, n.node FROM {STATE} JOIN {KEY_SQL} ON key >= a AND key < b JOIN (VALUES ('s1', 1), ('s1', 2), ('s2', 2), ('s2', 3), ('s3', 3), ('s3', 1), ('s4', 4)) n(shard, node) ON n.shard = s.shard WHERE n.node <> 3")
def key_route_healthy(spark, d):
    shards = spark.createDataFrame([(*r, nodes) for r, nodes in zip(KEY_RANGES, ([1, 2], [2, 3], [3, 1], [4]), strict=True)], "shard string, start string, end string, nodes array<int>")
    nodes = spark.createDataFrame([(i, "Unhealthy" if i == 3 else "Healthy") for i in range(1, 5)], "node int, health string")
    return routing.healthy_nodes(routing.key_shard(orders_state(spark, d).select("key"), shards), shards, nodes).select("key", "shard", "node")


@query("""
WITH r AS (SELECT event_id, user_id % 6 AS shard, CASE event_type WHEN 'view' THEN 'primary' WHEN 'click' THEN 'replica' WHEN 'purchase' THEN 'nearest' ELSE 'load_balance' END AS strategy FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY event_id) AS nr FROM r)
SELECT event_id, strategy, CASE strategy WHEN 'primary' THEN 's' || shard || 'p' WHEN 'replica' THEN 's' || shard || 'r' || (nr % 2) WHEN 'nearest' THEN 's' || shard || 'r1'
  ELSE ['s' || shard || 'p', 's' || shard || 'r0', 's' || shard || 'r1'][CAST(nr % 3 AS INTEGER) + 1] END AS node FROM n""")
def route_strategies(spark, d):
    kind = F.col("event_type")
    strategy = F.when(kind == "view", "primary").when(kind == "click", "replica").when(kind == "purchase", "nearest").otherwise("load_balance")
    requests = read(spark, d, "events").select("event_id", (F.col("user_id") % 6).alias("shard"), strategy.alias("strategy"))
    shards = spark.createDataFrame([(i, f"s{i}p", [f"s{i}r0", f"s{i}r1"], f"s{i}r1") for i in range(6)], "shard long, primary string, replicas array<string>, nearest string")
    return routing.routed(requests, shards, "event_id").select("event_id", "strategy", "node")


@query("SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'dc0' WHEN event_type = 'click' THEN 'dc0' WHEN user_id % 4 <> 2 THEN 'dc' || (user_id % 4) ELSE 'dc3' END AS dc FROM events")
def read_write_route(spark, d):
    kind = F.col("event_type")
    requests = read(spark, d, "events").select("event_id", F.when(kind.isin("purchase", "signup"), "write").otherwise("read").alias("kind"), F.when(kind == "click", "strong").otherwise("eventual").alias("level"), F.concat(F.lit("dc"), F.col("user_id") % 4).alias("home"))
    centres = spark.createDataFrame([("dc0", True, True, 9.0), ("dc1", False, True, 5.0), ("dc2", False, False, 1.0), ("dc3", False, True, 2.0)], "dc string, primary boolean, healthy boolean, latency double")
    return routing.data_centre(requests, centres).select("event_id", "dc")


@query("WITH s AS (SELECT CAST(i AS INTEGER) AS shard FROM range(16) r(i)), m AS (SELECT shard, unnest([shard % 5, (shard + 1) % 5, (shard + 2) % 5]) AS node FROM s) SELECT CAST(node AS INTEGER) AS node, count(*) AS n, string_agg(CAST(shard AS VARCHAR), ',' ORDER BY shard) AS shards FROM m GROUP BY node")
def node_ranges(spark, d):
    owned = routing.node_ranges(lookup.shard_table(spark, 16, 5, 3))
    return owned.select("node", F.size("ranges").cast("long").alias("n"), F.array_join(F.transform("ranges", lambda r: r["shard"].cast("string")), ",").alias("shards"))


def _ring(spark, nodes):
    return lookup.ring(spark.createDataFrame([(f"node{i}", 1.0) for i in nodes], "node string, weight double"), 200)


def _vnodes(name, nodes):
    return f"{name} AS (SELECT {SHA64.format('node || chr(58) || CAST(i AS VARCHAR)')} AS vnode, node FROM (VALUES {', '.join(f'({chr(39)}node{i}{chr(39)})' for i in nodes)}) n(node), range(200) r(i))"


def _owner(name):
    return f"(SELECT key, coalesce(min_by(node, vnode) FILTER (vnode >= hash), min_by(node, vnode)) AS node FROM (SELECT * FROM {HASHED}) k, {name} GROUP BY key)"


@query(f"WITH {_vnodes('v', (1, 2, 3))}, {_vnodes('w', (1, 2, 3, 4))} SELECT a.key, a.node AS source, b.node AS target FROM {_owner('v')} a JOIN {_owner('w')} b ON a.key = b.key WHERE a.node <> b.node")
def ring_moved_keys(spark, d):
    return lookup.moved_keys(orders_state(spark, d), _ring(spark, (1, 2, 3)), _ring(spark, (1, 2, 3, 4)))


@query(f"WITH {_vnodes('v', (1, 3, 4))}, f AS (SELECT key, node, min(CASE WHEN vnode >= hash THEN CAST(vnode - hash AS HUGEINT) ELSE CAST(vnode AS HUGEINT) - CAST(hash AS HUGEINT) + CAST('18446744073709551616' AS HUGEINT) END) AS far FROM {HASHED}, v GROUP BY key, node), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY far) AS nr FROM f) SELECT key, string_agg(node, ',' ORDER BY nr) AS replicas FROM r WHERE nr <= 2 GROUP BY key")
def replica_set_of_active(spark, d):
    active = spark.createDataFrame([("node1",), ("node3",), ("node4",)], "node string")
    return lookup.replica_set(orders_state(spark, d), _ring(spark, (1, 2, 3, 4)), 2, active).select("key", F.array_join("replicas", ",").alias("replicas"))


@query("SELECT user_id % 5 AS \"group\", count(*) AS requests, round(avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 6) AS hit_ratio, round(avg(value), 6) AS mean, max(value) AS greatest FROM events GROUP BY 1")
def router_stats(spark, d):
    return routing.route_stats(read(spark, d, "events").withColumn("g", F.col("user_id") % 5), "g", F.col("event_type") == "view", F.col("value"))


# Replicated logs


def _log(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 3).alias("term"), F.col("o_orderpriority").alias("value"))


@query("SELECT o_orderkey AS idx, o_orderkey % 3 AS term, o_orderpriority AS value FROM orders")
def replica_repair(spark, d):
    log = _log(spark, d)
    return replication.repaired(log, log.where("idx % 7 <> 0"), "idx")


@query("WITH l AS (SELECT o_orderkey AS idx, o_orderkey % 3 AS term, o_orderpriority AS value FROM orders WHERE o_orderkey <= 900), f AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey > 500 THEN 9 ELSE o_orderkey % 3 END AS term, 'f' AS value FROM orders WHERE o_orderkey <= 1000), c AS (SELECT min(idx) AS cut FROM l JOIN f USING (idx) WHERE l.term <> f.term) SELECT f.* FROM f, c WHERE idx < cut UNION ALL SELECT l.* FROM l, c WHERE idx >= cut")
def log_override(spark, d):
    log = _log(spark, d)
    follower = log.where("idx <= 1000").select("idx", F.when(F.col("idx") > 500, 9).otherwise(F.col("term")).cast("long").alias("term"), F.lit("f").alias("value"))
    return replication.overridden(log.where("idx <= 900"), follower)


@query(f"WITH n AS (SELECT user_id % 5 AS node, max(event_id) AS matched FROM events WHERE event_id % (user_id % 5 + 2) = 0 GROUP BY 1), c AS (SELECT quantile_disc(matched, 0.5) AS m FROM n) SELECT key, value, seq FROM {LAST.format('(SELECT l.* FROM ' + LOG + ' l, c WHERE seq <= m)')} WHERE op <> 'DEL'")
def apply_committed(spark, d):
    node = F.col("user_id") % 5
    nodes = read(spark, d, "events").where(F.col("event_id") % (node + 2) == 0).groupBy(node.alias("node")).agg(F.max("event_id").alias("matched"))
    return replication.applied(events_log(spark, d), nodes)


@query("SELECT (idx - 201) // 64 AS batch, min(idx) AS first, max(idx) AS last, count(*) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT o_orderkey AS idx, octet_length(encode(o_orderpriority)) + length(CAST(o_custkey AS VARCHAR)) AS bytes FROM orders) WHERE idx > 200 GROUP BY 1")
def replication_batches(spark, d):
    log = read(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderpriority").alias("value"))
    return replication.batches(log, 200, 64)


@query(f"SELECT shard, count(*) AS n FROM (SELECT CASE WHEN key >= 'order:00000300' AND key < 'order:00000600' THEN 9 ELSE CAST(right(key, 1) AS INTEGER) % 4 END AS shard FROM {STATE}) GROUP BY 1")
def migrate_range(spark, d):
    state = orders_state(spark, d).withColumn("shard", F.substring("key", -1, 1).cast("int") % 4)
    return replication.migrated(state, "order:00000300", "order:00000600", F.lit(9)).groupBy("shard").agg(F.count("*").alias("n"))


@query("SELECT user_id AS task, CASE WHEN sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) + 0 = 0 THEN 0 ELSE round(100.0 * count_if(event_type = 'purchase') / count_if(event_type = 'view'), 6) END AS percent, CASE WHEN count_if(event_type = 'click') = 0 THEN 0 ELSE round(CAST(sum(length(props)) AS DOUBLE) / count_if(event_type = 'click'), 6) END AS rate FROM events GROUP BY 1")
def migration_progress(spark, d):
    kind = lambda x: F.count_if(F.col("event_type") == x)
    tasks = read(spark, d, "events").groupBy(F.col("user_id").alias("task")).agg(kind("view").alias("total"), kind("purchase").alias("moved"), F.sum(F.length("props")).alias("bytes"), kind("click").alias("seconds"))
    return replication.migration_progress(tasks)


@query("WITH e AS (SELECT user_id AS shard, event_id, event_id % 3 = 0 AS moving, event_id % 150 AS progress, event_id % 4 AS p, event_id % 5 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nr FROM events) SELECT shard, CASE WHEN moving AND progress < 100 THEN 'migrating' ELSE 'active' END AS state, progress, CASE WHEN moving AND progress >= 100 THEN t ELSE p END AS \"primary\" FROM e WHERE nr = 1")
def shard_states(spark, d):
    at = F.col("event_id")
    changes = read(spark, d, "events").select(F.col("user_id").alias("shard"), at.alias("version"), F.when(at % 3 == 0, "migrating").otherwise("active").alias("state"), (at % 150).alias("progress"), (at % 4).alias("primary"), (at % 5).alias("target"))
    return replication.shard_states(changes)


@query("SELECT user_id % 3 AS dc, count(*) AS batches, CAST(sum(event_id % 10) AS BIGINT) AS entries, round(avg(value), 6) AS mean_ms, round(avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 6) AS success FROM events GROUP BY 1")
def replication_stats(spark, d):
    sent = read(spark, d, "events").select((F.col("user_id") % 3).alias("dc"), (F.col("event_id") % 10).alias("entries"), F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"))
    return replication.replication_stats(sent)


@query("SELECT round(CAST(count_if(m) AS DOUBLE) / count(*), 6) AS score FROM (SELECT user_id % 7 AS dc, count_if(event_type = 'error') % 2 = 0 AS m FROM events GROUP BY 1)")
def consistency_score(spark, d):
    dcs = read(spark, d, "events").groupBy((F.col("user_id") % 7).alias("dc")).agg((F.count_if(F.col("event_type") == "error") % 2 == 0).alias("consistent"))
    return replication.consistency_score(dcs)
