"""Named queries over the standard tables, each with equivalent SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..model import events_log, orders_state, read
from ..operators import aggregate, cache, fold, lookup, scan, transaction
from ..sources import text
from ..streaming import streams
from . import cache_plans, client_plans, function_plans, placement_plans, routing_plans, statistics_plans, storage_plans  # noqa: F401  they add their queries
from .base import FNV, LAST, LOG, MODS, QUERIES, SHA64, STATE, Query, query


# Log folding


@query(f"SELECT key, value, seq FROM {LAST.format(LOG)} WHERE op <> 'DEL'")
def latest_wins_state(spark, d):
    return fold.latest_wins(events_log(spark, d))


@query(f"WITH l AS {LOG}, g AS (SELECT key, max(seq) FILTER (op = 'DEL') AS gone FROM l GROUP BY key) SELECT l.key, min_by(value, seq) AS value, min(seq) AS seq FROM l JOIN g ON g.key = l.key WHERE op = 'SET' AND (gone IS NULL OR seq > gone) GROUP BY l.key")
def first_wins_state(spark, d):
    return fold.first_wins(events_log(spark, d))


@query(f"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS nr FROM {MODS} WHERE op IS NOT NULL),
f AS (SELECT key, nr, CASE WHEN op = 'SET' THEN value END AS value, CASE WHEN op = 'SET' THEN seq END AS seq FROM l WHERE nr = 1
  UNION ALL SELECT l.key, l.nr, CASE WHEN l.op = 'SET' OR l.op = 'MOD' AND f.value IS NOT NULL THEN l.value WHEN l.op = 'MOD' THEN f.value END, CASE WHEN l.op = 'SET' OR l.op = 'MOD' AND f.value IS NOT NULL THEN l.seq WHEN l.op = 'MOD' THEN f.seq END FROM f JOIN l ON l.key = f.key AND l.nr = f.nr + 1)
SELECT key, max_by(value, nr) AS value, max_by(seq, nr) AS seq FROM (SELECT key, nr, coalesce(value, chr(0)) AS value, coalesce(seq, -1) AS seq FROM f) GROUP BY key HAVING max_by(value, nr) <> chr(0)""")
def wal_replay_fold_mod(spark, d):
    return fold.fold_with_mod(events_log(spark, d, mod=True))


@query(f"SELECT key, value, seq FROM {LAST.format(f'(SELECT * FROM {LOG} WHERE seq <= 500)')} WHERE op <> 'DEL'")
def as_of_snapshot(spark, d):
    return fold.as_of(events_log(spark, d), 500)


@query(f"SELECT key, value, seq, op FROM {LOG} WHERE seq > 200 AND seq <= 700")
def incremental_snapshot(spark, d):
    return fold.incremental(events_log(spark, d), 200, 700).select("key", "value", "seq", "op")


@query(f"SELECT key, value, seq FROM {LAST.format(LOG)} WHERE op <> 'DEL'")
def incremental_apply(spark, d):
    log = events_log(spark, d)
    return fold.compact([log.where("seq <= 300"), fold.incremental(log, 300, 10**12)])


def _runs(spark, d):
    return [events_log(spark, d).where(F.col("seq") % 3 == k) for k in range(3)]


@query(f"SELECT key, value, seq FROM {LAST.format(LOG)} WHERE op <> 'DEL'")
def compact_runs(spark, d):
    return fold.compact(_runs(spark, d))


@query(f"SELECT key, value, op, seq FROM {LAST.format(LOG)}")
def merge_level_runs(spark, d):
    return fold.merge_runs(_runs(spark, d))


@query(f"WITH s AS (SELECT key, value FROM {STATE}), b AS (SELECT key, CASE WHEN hash_ = 0 THEN 'DEL' ELSE 'MOD' END AS op FROM (SELECT key, CAST(right(key, 1) AS INTEGER) % 2 AS hash_ FROM s WHERE right(key, 2) < '50')) SELECT s.key, CASE WHEN b.op = 'MOD' THEN 'new' ELSE s.value END AS value FROM s LEFT JOIN b ON b.key = s.key WHERE b.op IS NULL OR b.op <> 'DEL'")
def batch_apply(spark, d):
    state = orders_state(spark, d)
    ops = state.where(F.substring("key", -2, 2) < "50").select("key", F.lit("new").alias("value"), F.when(F.substring("key", -1, 1).cast("int") % 2 == 0, "DEL").otherwise("MOD").alias("op"), F.lit(1).alias("pos"))
    return fold.apply_batch(state, ops)


@query(f"SELECT key, seq, CASE WHEN op = 'DEL' THEN CASE WHEN coalesce(b, 'DEL') <> 'DEL' THEN 'deleted' ELSE 'missing' END WHEN coalesce(b, 'DEL') <> 'DEL' THEN 'replaced' ELSE 'created' END AS status FROM (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY seq) AS b FROM {LOG})")
def set_status(spark, d):
    return fold.set_status(events_log(spark, d))


@query("SELECT event_id AS pos, user_id AS \"group\", count(*) OVER w <= 20 AND sum(octet_length(encode(event_type)) + octet_length(encode(props))) OVER w <= 300 AS accepted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def batch_limits(spark, d):
    return fold.batch_limits(read(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("group"), F.col("event_type").alias("key"), F.col("props").alias("value")), 20, 300)


# Scans


@query(f"SELECT * FROM {STATE} WHERE key = 'order:00000042'")
def point_get(spark, d):
    return scan.get(orders_state(spark, d), "order:00000042")


@query(f"SELECT * FROM {STATE} WHERE key >= 'order:00000100' AND key < 'order:00000200'")
def range_scan(spark, d):
    return scan.range_scan(orders_state(spark, d), "order:00000100", "order:00000200")


@query(f"SELECT * FROM {STATE} WHERE key <= 'order:00000200' ORDER BY key DESC LIMIT 10 OFFSET 5")
def range_scan_reverse(spark, d):
    return scan.range_scan(orders_state(spark, d), end="order:00000200", with_end=True, reverse=True, offset=5, limit=10)


@query(f"SELECT key FROM {STATE} WHERE key >= 'order:00000100' ORDER BY key LIMIT 50")
def keys_only(spark, d):
    return scan.range_scan(orders_state(spark, d), "order:00000100", limit=50, keys_only=True)


@query(f"SELECT count(*) AS n FROM {STATE}")
def count_keys(spark, d):
    return orders_state(spark, d).agg(F.count("*").alias("n"))


@query(f"SELECT key, value, true AS has_more FROM {STATE} WHERE key > 'order:00000100' ORDER BY key LIMIT 20")
def range_page(spark, d):
    return scan.page(orders_state(spark, d), "order:00000100", 20)


@query(f"SELECT * FROM {STATE} WHERE starts_with(key, 'order:000001')")
def prefix_scan(spark, d):
    return scan.prefix_scan(orders_state(spark, d), "order:000001")


@query(f"SELECT * FROM {STATE} WHERE starts_with(lower(key), 'order:000002')")
def prefix_scan_any_case(spark, d):
    return scan.prefix_scan(orders_state(spark, d), "ORDER:000002", case_sensitive=False)


@query(f"SELECT position, prefix, key, value FROM (SELECT p.*, s.*, row_number() OVER (PARTITION BY position ORDER BY key) AS nr FROM {STATE} s JOIN (VALUES (0, 'order:0000001'), (1, 'order:000'), (2, 'none')) p(position, prefix) ON starts_with(key, prefix)) WHERE nr <= 10")
def multi_prefix_scan(spark, d):
    return scan.multi_prefix_scan(orders_state(spark, d), ["order:0000001", "order:000", "none"], 32)


@query(f"SELECT * FROM {STATE} WHERE regexp_matches(key, '7[0-3]$')")
def regex_scan(spark, d):
    return scan.matching(orders_state(spark, d), "7[0-3]$")


@query(f"SELECT * FROM {STATE} WHERE levenshtein(key, 'order:00000012') <= 1")
def fuzzy_scan(spark, d):
    return scan.similar_keys(orders_state(spark, d), "order:00000012", 1)


# Lookups


def _asked(spark, d):
    return read(spark, d, "customer").select(F.concat(F.lit("order:"), F.lpad((F.col("c_custkey") * 50).cast("string"), 8, "0")).alias("key"))


ASKED = "(SELECT 'order:' || lpad(CAST(c_custkey * 50 AS VARCHAR), 8, '0') AS key FROM customer)"


@query(f"SELECT a.key, s.value, s.key IS NOT NULL AS found FROM {ASKED} a LEFT JOIN {STATE} s ON s.key = a.key")
def batch_get(spark, d):
    return lookup.batch_get(_asked(spark, d), orders_state(spark, d))


@query(f"SELECT key FROM {ASKED} a WHERE NOT EXISTS (SELECT 1 FROM {STATE} s WHERE s.key = a.key)")
def missing_keys(spark, d):
    return lookup.missing(_asked(spark, d), orders_state(spark, d))


@query(f"SELECT key FROM {ASKED} a WHERE EXISTS (SELECT 1 FROM {STATE} s WHERE s.key = a.key)")
def existing_keys(spark, d):
    return lookup.existing(_asked(spark, d), orders_state(spark, d))


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 200000)")
def bloom_semijoin(spark, d):
    big = read(spark, d, "orders").where("o_totalprice > 200000")
    return read(spark, d, "customer").select("c_custkey", "c_name").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query(f"SELECT key, {SHA64.format('key')} AS hash FROM {STATE}")
def sha64_key_hash(spark, d):
    return orders_state(spark, d).select("key", scalar.sha64(F.col("key")).alias("hash"))


@query(f"SELECT key, {FNV.format('key')} AS hash FROM {STATE}")
def fnv1a_hash(spark, d):
    return orders_state(spark, d).select("key", scalar.fnv1a(F.col("key")).alias("hash"))


@query("SELECT n_name AS name, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(range(1, length(n_name) + 1), lambda i: CAST(ascii(n_name[i]) AS BIGINT))), lambda h, b: (h * 33 + b) & 4294967295) AS djb2, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(n_name) + 1), lambda i: CAST(ascii(n_name[i]) AS BIGINT))), lambda h, b: (b + h * 65599) & 4294967295) AS sdbm FROM nation")
def string_hashes(spark, d):
    name = F.col("n_name")
    return read(spark, d, "nation").select(name.alias("name"), scalar.djb2(name).alias("djb2"), scalar.sdbm(name).alias("sdbm"))


@query(f"SELECT key, CAST(least(floor(CAST({SHA64.format('key')} AS HUGEINT) // CAST('1152921504606846976' AS HUGEINT)), 15) AS INTEGER) AS shard FROM {STATE}")
def shard_range_lookup(spark, d):
    return orders_state(spark, d).select("key", lookup.equal_shard(scalar.sha64(F.col("key")), 16).alias("shard"))


@query("SELECT CAST(i AS INTEGER) AS shard, CAST(CAST(i AS HUGEINT) * 1152921504606846976 AS DECIMAL(20,0)) AS first, CAST((CAST(i AS HUGEINT) + 1) * 1152921504606846976 - 1 AS DECIMAL(20,0)) AS last, CAST(i % 5 AS INTEGER) AS \"primary\", CAST((i + 1) % 5 AS VARCHAR) || ',' || CAST((i + 2) % 5 AS VARCHAR) AS replicas FROM range(16) r(i)")
def shard_layout(spark, d):
    t = lookup.shard_table(spark, 16, 5, 3)
    return t.withColumn("primary", F.col("primary").cast("int")).withColumn("replicas", F.array_join(F.col("replicas").cast("array<string>"), ","))


def _ring(spark):
    return lookup.ring(spark.createDataFrame([(f"node{i}", 1.0) for i in (1, 2, 3)], "node string, weight double"), 200)


VNODES = f"v AS (SELECT {SHA64.format('node || chr(58) || CAST(i AS VARCHAR)')} AS vnode, node FROM (VALUES ('node1'), ('node2'), ('node3')) n(node), range(200) r(i))"


@query(f"WITH {VNODES}, k AS (SELECT key, {SHA64.format('key')} AS hash FROM {STATE}), o AS (SELECT node, vnode, coalesce(lag(vnode) OVER (ORDER BY vnode), -1) AS before FROM v), t AS (SELECT min_by(node, vnode) AS node, max(vnode) AS top FROM v) SELECT k.key, coalesce(o.node, (SELECT node FROM t)) AS node FROM k LEFT JOIN o ON k.hash > o.before AND k.hash <= o.vnode")
def ring_lookup(spark, d):
    return lookup.ring_lookup(orders_state(spark, d), _ring(spark)).select("key", "node")


@query(f"WITH {VNODES}, k AS (SELECT key, {SHA64.format('key')} AS hash FROM {STATE}), f AS (SELECT key, node, min(CASE WHEN vnode >= hash THEN CAST(vnode - hash AS HUGEINT) ELSE CAST(vnode AS HUGEINT) - CAST(hash AS HUGEINT) + CAST('18446744073709551616' AS HUGEINT) END) AS far FROM k, v GROUP BY key, node), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY far) AS nr FROM f) SELECT key, string_agg(node, ',' ORDER BY nr) AS replicas FROM r WHERE nr <= 2 GROUP BY key")
def replica_set(spark, d):
    return lookup.replica_set(orders_state(spark, d), _ring(spark), 2).select("key", F.array_join("replicas", ",").alias("replicas"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0")
def replica_missing_entries(spark, d):
    orders = read(spark, d, "orders").select("o_orderkey")
    return lookup.diverging(orders, orders.where("o_orderkey % 7 <> 0"), "o_orderkey")


@query("SELECT min(o_orderkey) AS idx FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey > 100 AND o_orderkey % 3 <> 0")
def log_first_conflict(spark, d):
    log = read(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_orderkey") % 3).alias("term"))
    return lookup.first_conflict(log, log.where("idx % 7 <> 0").withColumn("term", F.when(F.col("idx") > 100, 0).otherwise(F.col("term"))))


@query("WITH b AS (SELECT event_type AS \"group\", min_by(user_id, (avg_, user_id)) AS node FROM (SELECT event_type, user_id, min(value) AS avg_ FROM events WHERE user_id % 3 <> 0 GROUP BY ALL) GROUP BY event_type) SELECT event_id, b.node FROM events e JOIN b ON b.\"group\" = e.event_type")
def route_nearest(spark, d):
    events = read(spark, d, "events")
    nodes = events.groupBy(F.col("event_type").alias("group"), F.col("user_id").alias("node")).agg(F.min("value").alias("latency")).withColumn("healthy", F.col("node") % 3 != 0)
    return lookup.nearest(events.select("event_id", F.col("event_type").alias("group")), nodes).select("event_id", "node")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id) % 4 AS INTEGER) AS node FROM events")
def route_round_robin(spark, d):
    return lookup.round_robin(read(spark, d, "events").select("event_id", F.col("event_type").alias("group")), 4, "event_id").select("event_id", F.col("node").cast("int").alias("node"))


# Statistics


@query("SELECT CAST(least(greatest(floor((value - 10) / 5), 0), 15) AS INTEGER) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def histogram_clamped(spark, d):
    return aggregate.histogram(read(spark, d, "events"), "value", 10, 90, 16)


@query("WITH s AS (SELECT list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL) SELECT unnest(['p50', 'p95', 'p99', 'p95_scaled']) AS name, unnest([v[CAST(floor(0.5 * (len(v) - 1)) AS INTEGER) + 1], v[CAST(floor(0.95 * (len(v) - 1)) AS INTEGER) + 1], v[CAST(floor(0.99 * (len(v) - 1)) AS INTEGER) + 1], v[CAST(floor(0.95 * len(v)) AS INTEGER) + 1]]) AS value FROM s")
def percentile_floor(spark, d):
    ranks = {"p50": aggregate.floor_rank(0.5), "p95": aggregate.floor_rank(0.95), "p99": aggregate.floor_rank(0.99), "p95_scaled": aggregate.scaled_rank(0.95)}
    return aggregate.rank_percentiles(read(spark, d, "events"), "value", ranks)


@query("SELECT count(value) AS n, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation FROM events")
def latency_summary(spark, d):
    return aggregate.summary(read(spark, d, "events"), "value")


@query("WITH m AS (SELECT date_trunc('day', ts) AS m, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1) SELECT round(list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(n ORDER BY m)), lambda a, x: a + 0.08 * (x - a)), 6) AS rate FROM m")
def meter_ema(spark, d):
    days = read(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("m")).agg(F.count("*").alias("n"))
    return aggregate.meter(days, "m", "n", 0.08)


@query("SELECT user_id AS key, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id HAVING count(*) > 5 AND max(ts) >= TIMESTAMP '2024-01-15' ORDER BY n DESC, key LIMIT 10")
def hot_keys_topk(spark, d):
    return aggregate.hot_keys(read(spark, d, "events"), "user_id", "ts", "2024-01-15 00:00:00", 5, 10)


SHARDS = f"(SELECT CAST(i AS INTEGER) AS shard, count(h) AS n FROM range(8) r(i) LEFT JOIN (SELECT {FNV.format('key')} % 8 AS h FROM {STATE}) ON h = i GROUP BY i)"


def _shards(spark, d):
    return aggregate.shard_distribution(orders_state(spark, d), scalar.shard_of(scalar.fnv1a(F.col("key")), 8), 8)


@query(f"SELECT shard, n, round(n * CAST(100 AS DOUBLE) / sum(n) OVER (), 6) AS percent, round(var_pop(n) OVER (), 6) AS variance FROM {SHARDS}")
def shard_distribution(spark, d):
    return _shards(spark, d)


@query(f"SELECT (SELECT shard FROM {SHARDS} ORDER BY n DESC, shard LIMIT 1) AS hottest, (SELECT shard FROM {SHARDS} ORDER BY n, shard LIMIT 1) AS coldest")
def hottest_shard(spark, d):
    return aggregate.hottest_and_coldest(_shards(spark, d))


LOADS = "(SELECT user_id % 8 AS node, least(1.0, 0.3 * least(1.0, count(*) / CAST(2000 AS DOUBLE)) + 0.2 * least(1.0, sum(octet_length(encode(props))) / CAST(30000 AS DOUBLE)) + 0.2 * least(1.0, avg(value) / CAST(100 AS DOUBLE)) + 0.2 * least(1.0, max(value) / CAST(500 AS DOUBLE)) + 0.1 * least(1.0, min(value) / CAST(10 AS DOUBLE))) AS score FROM events GROUP BY 1)"


def _loads(spark, d):
    nodes = read(spark, d, "events").groupBy((F.col("user_id") % 8).alias("node")).agg(F.count("*").alias("qps"), F.sum(F.octet_length("props")).alias("storage"), F.avg("value").alias("memory"), F.max("value").alias("cpu"), F.min("value").alias("network"))
    norms = {"qps": 2000, "storage": 30000, "memory": 100, "cpu": 500, "network": 10}
    return nodes.select("node", aggregate.load_score(norms).alias("score"))


@query(f"SELECT node, round(score, 6) AS score FROM {LOADS}")
def load_score(spark, d):
    return _loads(spark, d).select("node", F.round("score", 6).alias("score"))


@query(f"WITH l AS {LOADS}, m AS (SELECT avg(score) AS mean FROM l) SELECT round(min(score), 6) AS least, round(max(score), 6) AS greatest, round(avg(score), 6) AS mean, round((max(score) - min(score)) / avg(score), 6) AS ratio, coalesce(string_agg(CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)) FILTER (score > m.mean * 1.05), '') AS overloaded, coalesce(string_agg(CAST(node AS VARCHAR), ',' ORDER BY CAST(node AS VARCHAR)) FILTER (score < m.mean * 0.95), '') AS underloaded FROM l, m")
def load_imbalance(spark, d):
    return aggregate.imbalance(_loads(spark, d), 0.05)


@query(f"SELECT node, round(1 / (1 + score), 6) AS weight FROM {LOADS} WHERE score > 0.4")
def rebalanced_weights(spark, d):
    return aggregate.rebalanced_weights(_loads(spark, d), 0.4)


@query("WITH g AS (SELECT user_id % 4 AS dc, CAST(count_if(event_type <> 'error') AS BIGINT) AS healthy, count(*) AS total, avg(value) AS latency FROM events GROUP BY 1) SELECT dc, healthy, total, CASE WHEN healthy = 0 THEN 'DCFailure' WHEN healthy / total < 0.5 THEN 'NetworkPartition' WHEN latency > 50 THEN 'SlowNetwork' WHEN healthy < total THEN 'Partial' ELSE 'Healthy' END AS class FROM g")
def dc_failure_classification(spark, d):
    dcs = read(spark, d, "events").groupBy((F.col("user_id") % 4).alias("dc")).agg(F.count_if(F.col("event_type") != "error").alias("healthy"), F.count("*").alias("total"), F.avg("value").alias("latency"))
    return dcs.select("dc", "healthy", "total", aggregate.failure_class(F.col("healthy"), F.col("total"), F.col("latency"), 0.5, 50).alias("class"))


@query("SELECT dc AS target FROM (SELECT user_id % 4 AS dc, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS ratio FROM events GROUP BY 1) ORDER BY ratio DESC, dc LIMIT 1")
def failover_target(spark, d):
    dcs = read(spark, d, "events").groupBy((F.col("user_id") % 4).alias("dc")).agg(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)).alias("ratio"))
    return aggregate.failover_target(dcs)


@query("SELECT event_id, user_id, event_type, previous FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous <> event_type")
def change_detection(spark, d):
    return aggregate.changes(read(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "user_id", "event_type", "previous")


@query("WITH n AS (SELECT user_id % 5 AS node, max(event_id) AS matched FROM events GROUP BY 1) SELECT list_sort(list(matched), 'DESC')[CAST(count(*) // 2 AS INTEGER) + 1] AS \"commit\" FROM n")
def commit_index(spark, d):
    return aggregate.commit_index(read(spark, d, "events").groupBy((F.col("user_id") % 5).alias("node")).agg(F.max("event_id").alias("matched")))


@query("SELECT event_type AS status, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 UNION ALL SELECT NULL, count(*), round(avg(value), 6) FROM events")
def topology_rollup(spark, d):
    return read(spark, d, "events").rollup(F.col("event_type").alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_type AS op, count(*) AS n, CAST(sum(octet_length(encode(props))) AS BIGINT) AS bytes FROM events GROUP BY 1")
def engine_stats(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("op")).agg(F.count("*").alias("n"), F.sum(F.octet_length("props")).alias("bytes"))


@query(f"WITH l AS {LAST.format(LOG)} SELECT count(*) AS total, CAST(count_if(op <> 'DEL') AS BIGINT) AS active, CAST(count_if(op = 'DEL') AS BIGINT) AS deleted, CAST(sum(octet_length(encode(key)) + octet_length(encode(value))) AS BIGINT) AS bytes FROM l")
def memtable_stats(spark, d):
    last = fold.last_ops(events_log(spark, d))
    return last.agg(F.count("*").alias("total"), F.count_if(F.col("op") != "DEL").alias("active"), F.count_if(F.col("op") == "DEL").alias("deleted"), F.sum(F.octet_length("key") + F.octet_length("value")).alias("bytes"))


# Transactions


@query(f"WITH b AS (SELECT 'user:' || c_custkey AS key, c_name AS value FROM customer), l AS {LAST.format(MODS.replace('FROM events', 'FROM events WHERE event_type IN (chr(101) || chr(114) || chr(114) || chr(111) || chr(114), chr(112) || chr(117) || chr(114) || chr(99) || chr(104) || chr(97) || chr(115) || chr(101), chr(115) || chr(105) || chr(103) || chr(110) || chr(117) || chr(112))'))} SELECT coalesce(b.key, l.key) AS key, CASE WHEN l.op IS NULL THEN b.value ELSE l.value END AS value FROM b FULL JOIN l ON l.key = b.key WHERE l.op IS NULL OR l.op = 'SET' OR (l.op = 'MOD' AND b.key IS NOT NULL)")
def txn_overlay_read(spark, d):
    base = read(spark, d, "customer").select(F.concat(F.lit("user:"), "c_custkey").alias("key"), F.col("c_name").alias("value"))
    ops = events_log(spark, d, mod=True).where("op IS NOT NULL").withColumnRenamed("seq", "pos")
    return transaction.overlay(base, ops)


@query("SELECT l_orderkey AS txn, count(*) AS participants, CASE WHEN bool_and(l_returnflag <> 'R') THEN 'committed' ELSE 'aborted' END AS outcome FROM lineitem GROUP BY 1")
def txn_outcome(spark, d):
    return transaction.outcomes(read(spark, d, "lineitem"), "l_orderkey", F.col("l_returnflag") != "R")


@query(f"SELECT key, value, seq FROM {LAST.format('(SELECT * FROM ' + LOG + ' WHERE seq % 10 <> 3 AND seq <= 800)')} WHERE op <> 'DEL'")
def txn_repeatable_read(spark, d):
    log = events_log(spark, d).withColumn("txn", F.col("seq") % 10)
    txns = spark.range(10).select(F.col("id").alias("txn"), F.when(F.col("id") == 3, "aborted").otherwise("committed").alias("status"))
    return transaction.visible(log, txns, "repeatable_read", 800)


@query("SELECT event_id AS pos, CAST(length(event_type) AS INTEGER) AS priority FROM events ORDER BY priority DESC, pos LIMIT 25")
def priority_queue(spark, d):
    return transaction.queue(read(spark, d, "events").select(F.col("event_id").alias("pos"), F.length("event_type").alias("priority")), 25)


# Caches


def _accesses(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"))


@query("SELECT user_id AS key FROM events GROUP BY 1 ORDER BY max(event_id) DESC, 1 LIMIT 10")
def lru_survivors(spark, d):
    return cache.lru(_accesses(spark, d), 10)


@query("SELECT user_id AS key FROM events GROUP BY 1 ORDER BY min(event_id) DESC, 1 LIMIT 10")
def fifo_survivors(spark, d):
    return cache.fifo(_accesses(spark, d), 10)


@query("SELECT user_id AS key FROM events GROUP BY 1 ORDER BY count(*) DESC, max(event_id) DESC, 1 LIMIT 10")
def lfu_survivors(spark, d):
    return cache.lfu(_accesses(spark, d), 10)


@query()
def clock_survivors(spark, d):
    return cache.clock(_accesses(spark, d).select((F.col("key") % 4).alias("cache"), F.col("key").cast("string").alias("key"), "at"), 8)


@query("SELECT event_id FROM events WHERE ts + INTERVAL 86400 SECOND > TIMESTAMP '2024-01-20'")
def ttl_filter(spark, d):
    return cache.unexpired(read(spark, d, "events").select("event_id", F.col("ts").alias("created")), "2024-01-20 00:00:00", 86400).select("event_id")


@query("SELECT user_id AS key, count(*) // 2 AS n FROM events GROUP BY 1")
def frequency_decay(spark, d):
    return cache.decayed(read(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n")))


@query("SELECT round(count_if(event_type = 'view') / count(*), 6) AS ratio FROM events")
def cache_hit_ratio(spark, d):
    return cache.hit_ratio(read(spark, d, "events").withColumn("hit", F.col("event_type") == "view"))


# Commands, text, times


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_command_decode(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT upper(split_part(line, ' ', 1)) AS op, split_part(line, ' ', 2) AS key, split_part(line, ' ', 3) AS value, true AS valid FROM (SELECT 'set user:' || user_id || ' ' || event_type AS line FROM events)")
def line_protocol(spark, d):
    lines = read(spark, d, "events").select(F.concat(F.lit("set user:"), "user_id", F.lit(" "), "event_type").alias("value"))
    return text.commands(lines)


@query("SELECT event_id, json_object('name', event_type, 'type', 'gauge', 'value', CAST(event_id AS VARCHAR)) AS line FROM events")
def metrics_export(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("name"), F.lit("gauge").alias("type"), F.col("event_id").cast("string").alias("value"))
    return rows.select("event_id", F.to_json(F.struct("name", "type", "value")).alias("line"))


@query("SELECT n_name AS name, trim('  ' || n_name || ' ') AS trimmed, replace(n_name, 'A', 'aa') AS replaced, array_to_string(string_split(n_name, 'A'), '|') AS rejoined, length(n_name) AS n FROM nation")
def string_utils(spark, d):
    name = F.col("n_name")
    return read(spark, d, "nation").select(name.alias("name"), scalar.trimmed(F.concat(F.lit("  "), name, F.lit(" "))).alias("trimmed"), F.replace(name, F.lit("A"), F.lit("aa")).alias("replaced"), F.array_join(F.split(name, "A"), "|").alias("rejoined"), F.length(name).cast("long").alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS formatted, epoch_ms(o_orderdate) AS ms FROM orders")
def time_utils(spark, d):
    day = F.col("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", F.date_format(day, "yyyy-MM-dd HH:mm:ss").alias("formatted"), F.unix_millis(day.cast("timestamp")).alias("ms"))


@query("SELECT n_name AS name, md5(n_name) AS md5, sha256(n_name) AS sha256, base64(encode(n_name)) AS base64 FROM nation")
def digests(spark, d):
    name = F.col("n_name")
    return read(spark, d, "nation").select(name.alias("name"), F.md5(name.cast("binary")).alias("md5"), F.sha2(name.cast("binary"), 256).alias("sha256"), F.base64(name.cast("binary")).alias("base64"))


# Streams, as batches


@query("SELECT event_id, event_type FROM events WHERE event_id > 300 AND event_type IN ('view', 'error') ORDER BY event_id LIMIT 100")
def topology_history(spark, d):
    return streams.events_of(read(spark, d, "events"), ["view", "error"], "event_type").where("event_id > 300").orderBy("event_id").limit(100).select("event_id", "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id AS key, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 2")
def hot_key_window(spark, d):
    out = streams.hot_windows(read(spark, d, "events"), "user_id", threshold=2)
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id AS node, max(ts) AS last, max(ts) + INTERVAL 30 SECOND < TIMESTAMP '2024-01-29' AS offline FROM events GROUP BY 1")
def heartbeat_timeout(spark, d):
    return streams.silent(read(spark, d, "events"), "user_id", "ts", "2024-01-29 00:00:00", 30)


@query("SELECT user_id, event_id, count(*) OVER w = 2 AND bool_and(event_type = 'error') OVER w AS open FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 1 PRECEDING)")
def circuit_breaker(spark, d):
    return streams.breaker(read(spark, d, "events").withColumn("failed", F.col("event_type") == "error"), "user_id", "failed", "event_id", 2)


__all__ = ["QUERIES", "Query"]
