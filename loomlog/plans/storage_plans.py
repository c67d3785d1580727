"""Queries of sorted runs, manifests, snapshots, logs and scans."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..model import events_log, orders_state, read
from ..operators import fold, scan
from ..session import workspace
from ..sources import config, persist, runs
from .base import LAST, LOG, STATE, query

STATE_SCHEMA = "key string, value string"


def _runs(spark, d):
    """The orders as three runs of two levels, and their manifest."""
    state, top = orders_state(spark, d), workspace(spark, "runs")
    parts = (state.where("key < 'order:00000500'"), state.where("key >= 'order:00000500' AND key < 'order:00001000'"), state.where("key >= 'order:00001000'"))
    for i, (rows, level) in enumerate(zip(parts, (0, 1, 1), strict=True)):
        runs.flush(rows, f"{top}/run-{i}", f"{top}/manifest", level)
    return runs.read_manifest(spark, f"{top}/manifest")


@query(f"SELECT * FROM {STATE} WHERE key = 'order:00000777'")
def run_point_get(spark, d):
    return runs.get_from_runs(spark, _runs(spark, d), STATE_SCHEMA, "order:00000777")


@query(f"SELECT * FROM {STATE} WHERE key >= 'order:00000450' AND key <= 'order:00000620'")
def run_range_scan(spark, d):
    return runs.scan_runs(spark, _runs(spark, d), STATE_SCHEMA, "order:00000450", "order:00000620")


@query(f"SELECT level, CAST(count(*) AS BIGINT) AS entries, min(key) AS min_key, max(key) AS max_key FROM (SELECT key, CAST(key >= 'order:00000500' AS INTEGER) AS level FROM {STATE}) GROUP BY level")
def run_manifest(spark, d):
    return runs.level_stats(_runs(spark, d)).drop("files")


@query(f"SELECT key, value, op, seq FROM {LAST.format(LOG)} WHERE op = 'DEL' OR key < 'user:5' ORDER BY key")
def memtable_scan(spark, d):
    log = events_log(spark, d)
    return scan.memtable(log, include_deleted=True).where("op = 'DEL' OR key < 'user:5'")


def _snapshots(spark, d):
    log, root = events_log(spark, d), workspace(spark, "snapshots")
    for term, index in ((1, 300), (1, 600), (2, 900)):
        persist.write_snapshot(fold.as_of(log, index).select("key", "value"), root, term, index)
    return root


def _as_of(seq):
    return f"(SELECT key, value FROM {LAST.format(f'(SELECT * FROM {LOG} WHERE seq <= {seq})')} WHERE op <> 'DEL')"


@query(f"SELECT 1 AS term, 600 AS \"index\", (SELECT count(*) FROM {_as_of(600)}) AS entries UNION ALL SELECT 2, 900, (SELECT count(*) FROM {_as_of(900)})")
def snapshot_catalogue(spark, d):
    root = _snapshots(spark, d)
    persist.prune(spark, root, 2)
    return persist.snapshots(spark, root).select(F.col("term").cast("int").alias("term"), F.col("index").cast("int").alias("index"), "entries")


@query(f"SELECT key, value FROM {_as_of(900)}")
def snapshot_latest(spark, d):
    return persist.latest_snapshot(spark, _snapshots(spark, d)).select("key", "value")


@query(f"SELECT count(*) AS entries, count(*) AS handed FROM {_as_of(500)}")
def snapshot_callback(spark, d):
    state, path = fold.as_of(events_log(spark, d), 500).select("key", "value"), workspace(spark, "saved")
    handed = persist.snapshot_with(state, lambda rows: rows.write.parquet(path))
    return spark.read.parquet(path).agg(F.count("*").alias("entries")).withColumn("handed", F.lit(handed).cast("long"))


@query(f"SELECT key, value, seq FROM {LAST.format(LOG)} WHERE op <> 'DEL'")
def log_round_trip(spark, d):
    path, base = workspace(spark, "log"), workspace(spark, "base")
    log = events_log(spark, d)
    for part in (log.where("seq <= 400"), log.where("seq > 400")):
        persist.append_log(part, path, 200)
    persist.compact_log(spark, path, base)
    return persist.read_log(spark, base).select("key", "value", "seq")


@query(f"SELECT key, value FROM {_as_of(700)}")
def json_state(spark, d):
    state = fold.as_of(events_log(spark, d), 700).select("key", "value")
    return persist.from_json_state(persist.to_json_state(state, 50))


@query("SELECT 'a.b' AS path, '1' AS value UNION ALL SELECT 'a.list.0', 'x y' UNION ALL SELECT 'a.list.1', 'true' UNION ALL SELECT 'name', 'né \"q\"' UNION ALL SELECT 'rate', '0.5'")
def config_round_trip(spark, d):
    """A tree through all formats that have lists."""
    from ..sources import text

    tree = {"a": {"b": 0, "list": ["x y", True]}, "name": 'né "q"', "rate": 0.5}
    tree = config.set_path(tree, "a.b", 1)
    for kind in ("json", "yaml", "toml"):
        tree = config.parse(config.dump(tree, kind), kind)
    return text.config_rows(spark, tree)


@query("SELECT op, pos FROM (SELECT *, row_number() OVER (ORDER BY key, pos) AS nr FROM (SELECT 'user:' || user_id AS key, event_id AS pos, event_type AS op FROM events)) WHERE nr <= 50")
def batch_sorted(spark, d):
    """A batch in the order in which an engine writes it: by key, then by arrival."""
    return fold.batch_order(events_log(spark, d).withColumnRenamed("seq", "pos")).limit(50).select(F.col("value").alias("op"), "pos")


@query(f"SELECT 3 AS queries, (SELECT count(*) FROM {STATE} WHERE key >= 'order:00000100' AND key < 'order:00000300') + (SELECT count(*) FROM {STATE} WHERE starts_with(key, 'order:000004')) + 0 AS returned, true AS timed")
def range_query_stats(spark, d):
    """Statistics of scans that were run under observation."""
    import time

    state, seen = orders_state(spark, d), []
    for df in (scan.range_scan(state, "order:00000100", "order:00000300"), scan.prefix_scan(state, "order:000004"), scan.get(state, "none")):
        observation, began = Observation(), time.monotonic()
        df.observe(observation, F.count("*").alias("returned")).write.format("noop").mode("overwrite").save()
        seen.append((observation.get["returned"], 1000 * (time.monotonic() - began)))
    rows = spark.createDataFrame(seen, "returned long, ms double")
    return rows.agg(F.count("*").cast("int").alias("queries"), F.sum("returned").alias("returned"), (F.avg("ms") > 0).alias("timed"))


@query("SELECT ts, node, load FROM (SELECT ts, user_id % 4 AS node, value AS load, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)")
def load_export(spark, d):
    """The last 100 samples as a JSON document, read back."""
    from ..sources import text

    samples = read(spark, d, "events").select("ts", (F.col("user_id") % 4).alias("node"), F.col("value").alias("load"), "event_id")
    document = text.load_document(samples, "ts", "event_id", 100)
    back = document.select(F.explode(F.from_json("json", "array<struct<ts:timestamp_ntz,node:bigint,load:double>>")).alias("s"))
    return back.select("s.ts", "s.node", "s.load")
