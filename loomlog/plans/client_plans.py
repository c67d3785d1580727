"""Queries that go through the client façade, and the isolation levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..client import ENGINES, Store, folded, warmed
from ..model import events_log, orders_state
from ..operators import fold, transaction
from .base import LAST, LOG, STATE, query


@query(f"SELECT e AS engine, CASE WHEN e = 'rbtree' THEN (SELECT CAST(sum(seq) AS BIGINT) FROM (WITH l AS {LOG}, g AS (SELECT key, max(seq) FILTER (op = 'DEL') AS gone FROM l GROUP BY key) SELECT min(seq) AS seq FROM l JOIN g ON g.key = l.key WHERE op = 'SET' AND (gone IS NULL OR seq > gone) GROUP BY l.key)) ELSE (SELECT CAST(sum(seq) AS BIGINT) FROM {LAST.format(LOG)} WHERE op <> 'DEL') END AS seqs FROM (SELECT unnest({list(ENGINES)}) AS e)")
def engine_dispatch(spark, d):
    log, out = events_log(spark, d), None
    for name in ENGINES:
        one = folded(log, name).agg(F.sum("seq").alias("seqs")).select(F.lit(name).alias("engine"), "seqs")
        out = one if out is None else out.unionByName(one)
    return out


BATCH = [("order:00000001", "x", "SET"), ("new", "y", "SET"), ("new", "z", "SET"), ("order:00000002", None, "DEL"), ("none", None, "DEL"), ("order:00000003", "m", "MOD"), ("gone", "m", "MOD"), ("order:00000002", "w", "SET"), ("order:00000005", None, "GET"), ("never", None, "GET")]
STATUS = ["replaced", "created", "replaced", "deleted", "missing", "modified", "missing", "created", "found", "missing"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k!r}, CAST({i} AS BIGINT), {s!r})" for i, ((k, _, _), s) in enumerate(zip(BATCH, STATUS, strict=True))) + ") t(key, pos, status)")
def client_batch_status(spark, d):
    return Store(spark, orders_state(spark, d)).execute(BATCH)


@query(f"SELECT key, value FROM {STATE} WHERE key NOT IN ('order:00000001', 'order:00000002', 'order:00000003') UNION ALL SELECT * FROM (VALUES ('order:00000001', 'x'), ('new', 'z'), ('order:00000003', 'm'), ('order:00000002', 'w')) t(key, value)")
def client_batch_state(spark, d):
    store = Store(spark, orders_state(spark, d))
    store.execute(BATCH)
    return store.checkpointed().state


@query("SELECT 7 AS ok, 3 AS failed")
def client_batch_result(spark, d):
    store = Store(spark, orders_state(spark, d))
    return store.batch_result(store.execute(BATCH)).select(F.col("ok").cast("int").alias("ok"), F.col("failed").cast("int").alias("failed"))


SESSION = ["set a 1", "SET a 2", "get a", "EXISTS a", "mod a 3", "Get a", "del a", "get a", "del a", "count", "engine rbtree", "set a 1", "set a 2", "get a", "status", "what", "quit"]
ANSWERS = ["OK", "OK", "2", "EXIST", "OK", "3", "OK", "NO EXIST", "NO EXIST", "0", "OK", "OK", "OK", "1", "engine rbtree, 1 keys", "ERROR", "BYE"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {line!r}, {answer!r})" for i, (line, answer) in enumerate(zip(SESSION, ANSWERS, strict=True))) + ") t(nr, line, answer)")
def command_session(spark, d):
    store = Store(spark, engine="hash")
    answers = []
    for i, line in enumerate(SESSION):
        answers.append((i, line, store.command(line)))
        store.checkpointed()
    return spark.createDataFrame(answers, "nr int, line string, answer string")


@query(f"SELECT step, value FROM (VALUES (0, 'new'), (1, NULL), (2, 'new'), (4, NULL)) t(step, value) UNION ALL SELECT 3, value FROM {STATE} WHERE key = 'order:00000002'")
def client_transaction(spark, d):
    store = Store(spark, orders_state(spark, d))
    t = store.begin()
    t.set("k", "new")
    seen = [(0, t.get("k")), (1, store.get("k"))]
    t.commit()
    seen.append((2, store.get("k")))
    u = store.begin("read_uncommitted")
    u.delete("order:00000002")
    u.set("other", "x")
    u.rollback()
    return spark.createDataFrame([*seen, (3, store.get("order:00000002")), (4, store.get("other"))], "step int, value string")


@query(f"SELECT nr, key FROM (SELECT key, row_number() OVER (ORDER BY key) AS nr FROM {STATE} WHERE key >= 'order:00000100' AND key < 'order:00000200') WHERE nr <= 12 UNION ALL SELECT 13, 'order:00000110' UNION ALL SELECT 14, 'order:00000109'")
def iterator_walk(spark, d):
    cursor = Store(spark, orders_state(spark, d)).iterator("order:00000100", "order:00000200", 5)
    seen = [(1, cursor.current()["key"])] if cursor.seek("order:00000050") else []
    for i in range(2, 13):
        cursor.next()
        seen.append((i, cursor.current()["key"]))
    for i in (13, 14):
        cursor.prev()
        seen.append((i, cursor.current()["key"]))
    return spark.createDataFrame(seen, "nr long, key string")


@query(f"SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY substr(key, 1, 11) ORDER BY key) AS nr FROM {STATE} WHERE starts_with(key, 'order:00000') OR starts_with(key, 'order:00001')) WHERE nr <= 100")
def warm_prefixes(spark, d):
    return warmed(orders_state(spark, d), ["order:00000", "order:00001"])


# Isolation levels of a reader that started at 800, with one transaction aborted and one still open


def _visible(spark, d, level):
    log = events_log(spark, d).withColumn("txn", F.col("seq") % 10)
    txns = spark.range(10).select(F.col("id").alias("txn"), F.when(F.col("id") == 3, "aborted").when(F.col("id") == 4, "active").otherwise("committed").alias("status"))
    return transaction.visible(log, txns, level, 800)


def _sql(where):
    return f"SELECT key, value, seq FROM {LAST.format('(SELECT * FROM ' + LOG + where + ')')} WHERE op <> 'DEL'"


@query(_sql(" WHERE true"))
def txn_read_uncommitted(spark, d):
    return _visible(spark, d, "read_uncommitted")


@query(_sql(" WHERE seq % 10 NOT IN (3, 4)"))
def txn_read_committed(spark, d):
    return _visible(spark, d, "read_committed")


@query(_sql(" WHERE seq % 10 NOT IN (3, 4) AND seq <= 800"))
def txn_serializable(spark, d):
    return _visible(spark, d, "serializable")


@query("SELECT user_id AS shard, CAST(count_if(ok) AS BIGINT) AS ok, CAST(count_if(NOT ok) AS BIGINT) AS failed FROM (SELECT user_id % 4 AS user_id, NOT (event_type = 'error' AND coalesce(b, 'error') = 'error') AS ok FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)) GROUP BY 1")
def sharded_batch(spark, d):
    """Counts of a batch of SETs and DELs that did and didn't find what they needed, by shard."""
    status = fold.set_status(events_log(spark, d))
    shard = F.substring_index("key", ":", -1).cast("long") % 4
    return status.groupBy(shard.alias("shard")).agg(F.count_if(F.col("status") != "missing").alias("ok"), F.count_if(F.col("status") == "missing").alias("failed"))
