"""Queries of caches that are replayed in the order of accesses, and Bloom filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import bloom_size
from ..model import orders_state, read
from ..operators import bloom, eviction
from .base import STATE, query

SIZE = 4


def _accesses(spark, d):
    return read(spark, d, "events").select((F.col("user_id") % 3).cast("string").alias("cache"), F.expr("concat('k', user_id * 7 % 40 + event_id % 3)").alias("key"), F.col("event_id").alias("at"))


def _replay(step):
    """A replay as a recursion over accesses: held is the cache's list, the next victim first."""
    return f"""WITH RECURSIVE a AS (SELECT CAST(user_id % 3 AS VARCHAR) AS cache, 'k' || (user_id * 7 % 40 + event_id % 3) AS key, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS nr FROM events),
f AS (SELECT cache, CAST(0 AS BIGINT) AS nr, CAST([] AS VARCHAR[]) AS held FROM (SELECT DISTINCT cache FROM a)
  UNION ALL SELECT a.cache, a.nr, {step} FROM f JOIN a ON a.cache = f.cache AND a.nr = f.nr + 1),
l AS (SELECT cache, max_by(held, nr) AS held FROM f GROUP BY cache)
SELECT cache, unnest(held) AS key, CAST(unnest(range(len(held))) AS INTEGER) AS position FROM l"""


@query(_replay(f"CASE WHEN list_contains(held, key) THEN list_append(list_filter(held, lambda x: x <> key), key) WHEN len(held) >= {SIZE} THEN list_append(held[2:], key) ELSE list_append(held, key) END"))
def lru_replay(spark, d):
    return eviction.replayed(_accesses(spark, d), "LRU", SIZE)


@query(_replay(f"CASE WHEN list_contains(held, key) THEN held WHEN len(held) >= {SIZE} THEN list_append(held[2:], key) ELSE list_append(held, key) END"))
def fifo_replay(spark, d):
    return eviction.replayed(_accesses(spark, d), "FIFO", SIZE)


def _structs(empty, step, last):
    """A replay over a list of structs; last: its keys in the policy's order in the end."""
    return f"""WITH RECURSIVE a AS (SELECT CAST(user_id % 3 AS VARCHAR) AS cache, 'k' || (user_id * 7 % 40 + event_id % 3) AS key, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS nr FROM events),
f AS (SELECT cache, CAST(0 AS BIGINT) AS nr, {empty} AS held FROM (SELECT DISTINCT cache FROM a)
  UNION ALL SELECT a.cache, a.nr, {step} FROM f JOIN a ON a.cache = f.cache AND a.nr = f.nr + 1),
l AS (SELECT cache, {last} AS held FROM (SELECT cache, max_by(held, nr) AS held FROM f GROUP BY cache))
SELECT cache, unnest(held) AS key, CAST(unnest(range(len(held))) AS INTEGER) AS position FROM l"""


_HELD = "list_contains(list_transform(held, lambda x: x.k), key)"
_NEW_LFU = "{'n': CAST(0 AS BIGINT), 't': a.nr, 'k': key}"


@query(_structs("CAST([] AS STRUCT(n BIGINT, t BIGINT, k VARCHAR)[])", f"CASE WHEN {_HELD} THEN list_transform(held, lambda x: CASE WHEN x.k = key THEN {{'n': x.n + 1, 't': a.nr, 'k': x.k}} ELSE x END) WHEN len(held) >= {SIZE} THEN list_append(list_sort(held)[2:], {_NEW_LFU}) ELSE list_append(held, {_NEW_LFU}) END", "list_transform(list_sort(list_transform(held, lambda x: {'t': x.t, 'k': x.k})), lambda x: x.k)"))
def lfu_replay(spark, d):
    return eviction.replayed(_accesses(spark, d), "LFU", SIZE)


_SPARED = "list_position(list_transform(held, lambda x: x.f), 0)"
_CLEARED = "lambda x: {'k': x.k, 'f': 0}"


@query(_structs("CAST([] AS STRUCT(k VARCHAR, f INTEGER)[])", f"CASE WHEN {_HELD} THEN list_transform(held, lambda x: CASE WHEN x.k = key THEN {{'k': x.k, 'f': 1}} ELSE x END) WHEN len(held) < {SIZE} THEN list_append(held, {{'k': key, 'f': 0}}) WHEN coalesce({_SPARED}, 0) = 0 THEN list_append(list_transform(held[2:], {_CLEARED}), {{'k': key, 'f': 0}}) ELSE list_append(list_concat(held[{_SPARED} + 1:], list_transform(held[1:{_SPARED} - 1], {_CLEARED})), {{'k': key, 'f': 0}}) END", "list_transform(held, lambda x: x.k)"))
def clock_replay(spark, d):
    return eviction.replayed(_accesses(spark, d), "CLOCK", SIZE)


@query()
def random_replay(spark, d):
    return eviction.replayed(_accesses(spark, d), "RANDOM", SIZE)


@query()
def arc_replay(spark, d):
    return eviction.replayed(_accesses(spark, d), "ARC", SIZE)


@query(_replay(f"CASE WHEN list_contains(held, key) THEN list_append(list_filter(held, lambda x: x <> key), key) WHEN len(held) >= {SIZE} THEN list_append(held[2:], key) ELSE list_append(held, key) END").split("\nl AS")[0].rstrip(",").replace("list_append(held[2:], key) ELSE", "list_append(held[2:], key) ELSE") + f", h AS (SELECT f.cache, count(*) AS accesses, count_if(list_contains(f.held, a.key)) AS hits, count_if(NOT list_contains(f.held, a.key) AND len(f.held) >= {SIZE}) AS evictions FROM f JOIN a ON a.cache = f.cache AND a.nr = f.nr + 1 GROUP BY f.cache) SELECT cache, accesses, CAST(hits AS BIGINT) AS hits, CAST(evictions AS BIGINT) AS evictions FROM h")
def lru_replay_stats(spark, d):
    return eviction.replay_stats(_accesses(spark, d), "LRU", SIZE)


# Bloom filters

BITS, HASHES = bloom_size(2000, 0.05)
MD5 = "md5({0}) AS h, CAST(CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS BIGINT) AS a, CAST(CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS BIGINT) AS b"
ADDED = f"(SELECT key FROM {STATE} WHERE key < 'order:00001001')"
ASKED = f"(SELECT key FROM {STATE})"


def _positions(keys, of):
    return f"(SELECT key, unnest(list_distinct(list_transform(range({HASHES}), lambda i: {of}))) AS position FROM (SELECT key, {MD5.format('key')} FROM {keys}))"


STANDARD = f"(a + i * b) % {BITS}"
BLOCKED = f"(a % {BITS // 512}) * 512 + (b + i * ((a >> 9) * 2 + 1)) % 512"


def _test(of, added=ADDED):
    return f"SELECT q.key, bool_and(f.position IS NOT NULL) AS maybe FROM {_positions(ASKED, of)} q LEFT JOIN (SELECT DISTINCT position FROM {_positions(added, of)}) f ON f.position = q.position GROUP BY q.key"


def _added(spark, d):
    return orders_state(spark, d).where("key < 'order:00001001'").select("key")


def _keys(spark, d):
    """The keys that are asked for, each once."""
    return orders_state(spark, d).where("key IS NOT NULL").select("key").distinct()


@query(_test(STANDARD))
def bloom_filter(spark, d):
    return bloom.may_contain(_keys(spark, d), bloom.build(_added(spark, d), BITS, HASHES), BITS, HASHES)


@query(_test(BLOCKED))
def bloom_blocked(spark, d):
    return bloom.may_contain(_keys(spark, d), bloom.build(_added(spark, d), BITS, HASHES, True), BITS, HASHES, True)


@query(_test(STANDARD, f"(SELECT key FROM {STATE} WHERE key < 'order:00001001' AND key >= 'order:00000300')"))
def bloom_counting(spark, d):
    keys = _added(spark, d)
    count = lambda rows: bloom.count_positions(rows, BITS, HASHES)
    kept = bloom.changed(count(keys), removed=count(keys.where("key < 'order:00000300'")))
    return bloom.counted(orders_state(spark, d).select("key"), kept, BITS, HASHES)


@query(f"SELECT count(*) AS bits FROM (SELECT DISTINCT position FROM {_positions(ADDED, STANDARD)})")
def bloom_fill(spark, d):
    return bloom.build(_added(spark, d), BITS, HASHES).agg(F.sum(F.bitmap_count("bitmap")).alias("bits"))
