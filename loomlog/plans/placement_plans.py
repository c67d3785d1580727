"""Queries of placement, state machines, logs' ends and timed caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.scalar import bloom_size
from ..model import events_log, orders_state, read
from ..operators import bloom, cache, fold, placement
from ..sources import text
from .base import FNV, LAST, LOG, STATE, query

SPLITS = ("order:00000300", "order:00000900", "order:00001100")


@query(f"SELECT key, CAST({FNV.format('key')} % 4 AS INTEGER) AS by_hash, CASE WHEN key < '{SPLITS[0]}' THEN 0 WHEN key < '{SPLITS[1]}' THEN 1 WHEN key < '{SPLITS[2]}' THEN 2 ELSE 3 END AS by_range FROM {STATE}")
def shard_strategies(spark, d):
    keys = orders_state(spark, d).select("key")
    by_hash = placement.placed(keys, placement.ShardConfig(4)).withColumnRenamed("shard", "by_hash")
    return placement.placed(by_hash, placement.ShardConfig(4, "range", splits=SPLITS)).withColumnRenamed("shard", "by_range")


@query(f"SELECT source, target, count(*) AS n FROM (SELECT CAST({FNV.format('key')} % 4 AS INTEGER) AS source, CAST({FNV.format('key')} % 5 AS INTEGER) AS target FROM {STATE}) WHERE source <> target GROUP BY ALL")
def shard_added(spark, d):
    return placement.moves(orders_state(spark, d), placement.ShardConfig(4), placement.ShardConfig(5))


@query("SELECT user_id % 6 AS shard, CAST(count(*) AS DOUBLE) AS load, round(count(*) - avg(count(*)) OVER (), 6) AS excess FROM events GROUP BY 1")
def shard_rebalance(spark, d):
    loads = read(spark, d, "events").groupBy((F.col("user_id") % 6).alias("shard")).agg(F.count("*").cast("double").alias("load"))
    return placement.rebalance_plan(loads)


@query("SELECT node, address FROM (SELECT user_id AS node, event_type, '10.0.0.' || (event_id % 250) AS address, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nr FROM events) WHERE nr = 1 AND event_type <> 'error'")
def cluster_members(spark, d):
    kind = F.when(F.col("event_type") == "error", "leave").when(F.col("event_type") == "signup", "join").otherwise("update")
    changes = read(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("version"), kind.alias("kind"), F.concat(F.lit("10.0.0."), F.col("event_id") % 250).alias("address"))
    return placement.members(changes)


@query(f"WITH s AS (SELECT key, CASE WHEN key < 'order:00000100' THEN 'new' ELSE value END AS value FROM {STATE} WHERE NOT (key >= 'order:00000100' AND key < 'order:00000200')) SELECT CAST({FNV.format('key')} % 4 AS INTEGER) AS shard, count(*) AS n, CAST(count_if(value = 'new') AS BIGINT) AS fresh FROM s GROUP BY 1")
def sharded_crud(spark, d):
    state = orders_state(spark, d)
    ops = state.where("key < 'order:00000200'").select("key", F.lit("new").alias("value"), F.when(F.col("key") < "order:00000100", "SET").otherwise("DEL").alias("op"), F.lit(1).alias("pos"))
    return placement.sharded_batch(state, ops, placement.ShardConfig(4)).groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "new").alias("fresh"))


@query(f"SELECT key, value, seq FROM {LAST.format(LOG)} WHERE op <> 'DEL'")
def state_machine_apply(spark, d):
    """JSON commands of a log's entries, decoded and folded."""
    kind = F.when(F.col("event_type") == "error", "DEL").otherwise("SET")
    entries = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.to_json(F.struct(kind.alias("type"), F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_type").alias("value"))).alias("data"))
    return fold.latest_wins(text.json_commands(entries).withColumnRenamed("type", "op"))


@query("SELECT min(event_id) AS first, max(event_id) AS last, max_by(user_id % 3, event_id) AS term, count(*) FILTER (event_id BETWEEN 100 AND 200) AS ranged FROM events")
def log_bounds(spark, d):
    log = read(spark, d, "events").select(F.col("event_id").alias("idx"), (F.col("user_id") % 3).alias("term"))
    return fold.bounds(log).crossJoin(fold.entries(log, 100, 200).agg(F.count("*").alias("ranged")))  # one row each


@query("SELECT key, value FROM (SELECT user_id AS key, event_type AS value, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nr FROM events) WHERE nr = 1 AND value <> 'error' AND event_id % 97 <> 0 AND ts + INTERVAL 172800 SECOND > TIMESTAMP '2024-01-29'")
def ttl_cache(spark, d):
    """What a cache with a time to live answers after SETs, DELs and clears of single keys."""
    ops = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("at"), F.when((F.col("event_type") == "error") | (F.col("event_id") % 97 == 0), "DEL").otherwise("SET").alias("op"), F.col("ts").alias("created"))
    return cache.timed(ops, "2024-01-29 00:00:00", 172800)


@query("SELECT n_name AS name, CAST(CAST('0x' || substr(md5(n_name), 1, 16) AS UBIGINT) AS DECIMAL(20,0)) AS hash FROM nation")
def md5_ring_hash(spark, d):
    return read(spark, d, "nation").select(F.col("n_name").alias("name"), scalar.md5_64(F.col("n_name")).alias("hash"))


@query("SELECT count(*) AS asked, CAST(count_if(key < 'order:00001001') AS BIGINT) AS there, true AS none_lost, true AS few_wrong FROM " + STATE)
def bloom_scalable(spark, d):
    """Filters of growing size for keys whose number isn't known before."""
    state = orders_state(spark, d).select("key")
    added = state.where("key < 'order:00001001'")
    found = bloom.may_contain_any(state, bloom.build_scalable(added, 100, 0.02))
    known = F.col("key") < "order:00001001"
    return found.agg(F.count("*").alias("asked"), F.count_if(known).alias("there"), (F.count_if(known & ~F.col("maybe")) == 0).alias("none_lost"), (F.count_if(~known & F.col("maybe")) <= 0.05 * F.count("*")).alias("few_wrong"))


@query("SELECT count(*) AS asked, true AS none_lost, true AS few_wrong FROM " + STATE)
def bloom_register(spark, d):
    """All positions of a key in one 64-bit word."""
    state = orders_state(spark, d).select("key")
    known, (bits, hashes) = F.col("key") < "order:00001001", bloom_size(2000, 0.01)
    found = bloom.may_contain(state, bloom.build(state.where(known), bits, hashes, True, 64), bits, hashes, True, 64)
    return found.agg(F.count("*").alias("asked"), (F.count_if(known & ~F.col("maybe")) == 0).alias("none_lost"), (F.count_if(~known & F.col("maybe")) <= 0.15 * F.count("*")).alias("few_wrong"))
