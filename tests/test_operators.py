import pytest
from pyspark.sql import functions as F

from loomlog.functions import scalar
from loomlog.operators import cache, fold, lookup, scan, transaction
from loomlog.sources import persist, text
from loomlog.streaming import streams

LOG = "key string, value string, seq long, op string"


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def pairs(df):
    return {(r["key"], r["value"]) for r in df.collect()}


def test_folds(spark):
    rows = log(spark, [("a", "1", 1, "SET"), ("a", "2", 2, "SET"), ("b", "1", 3, "SET"), ("b", None, 4, "DEL"), ("b", "9", 5, "MOD"), ("c", "1", 6, "MOD"), ("d", None, 7, "DEL"), ("d", "x", 8, "SET"), ("d", "y", 9, "MOD")])
    assert pairs(fold.fold_with_mod(rows)) == {("a", "2"), ("d", "y")}
    sets = rows.where("op <> 'MOD'")
    assert pairs(fold.latest_wins(sets)) == {("a", "2"), ("d", "x")}
    assert pairs(fold.first_wins(sets)) == {("a", "1"), ("d", "x")}
    assert pairs(fold.as_of(sets, 3)) == {("a", "2"), ("b", "1")}
    assert fold.latest_wins(sets.limit(0)).count() == 0
    with pytest.raises(ValueError):
        fold.incremental(sets, 5, 5)


def test_apply_batch(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    batch = spark.createDataFrame([("a", "9", "SET", 1), ("a", None, "DEL", 2), ("b", "3", "MOD", 3), ("c", "4", "MOD", 4), ("d", "5", "SET", 5)], "key string, value string, op string, pos long")
    assert pairs(fold.apply_batch(state, batch)) == {("b", "3"), ("d", "5")}
    assert pairs(transaction.overlay(state, batch)) >= {("b", "3"), ("d", "5")}


def test_scan_edges(spark):
    state = spark.createDataFrame([(k, k) for k in ("a1", "a2", "b1", "A3")], "key string, value string")
    assert [r.key for r in scan.range_scan(state, "a1", "b1", with_start=False, with_end=True).collect()] == ["a2", "b1"]
    assert {r.key for r in scan.prefix_scan(state, "a", case_sensitive=False).collect()} == {"a1", "a2", "A3"}
    assert [(r.key, r.has_more) for r in scan.page(state, "a1", 1).collect()] == [("a2", True)]
    assert [(r.key, r.has_more) for r in scan.page(state, "a2", 5).collect()] == [("b1", False)]
    assert scan.successor(b"ab\xff") == b"ac" and scan.successor(b"\xff") is None


def test_ring_is_whole(spark):
    vnodes = lookup.ring(spark.createDataFrame([("n1", 1.0), ("n2", 5.0)], "node string, weight double"), 50)
    keys = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"))
    found = lookup.ring_lookup(keys, vnodes).collect()
    ring = sorted((int(r.vnode), r.node) for r in vnodes.collect())
    assert len(found) == 300
    for r in found:
        assert r.node == next((n for v, n in ring if v >= int(r.hash)), ring[0][1])


def test_snapshots(spark, tmp_path):
    state = spark.createDataFrame([("a", "1"), ("b", None)], "key string, value string")
    for term, index in ((1, 5), (1, 9), (2, 7)):
        persist.write_snapshot(state.withColumn("value", F.lit(str(index))), str(tmp_path), term, index)
    assert pairs(persist.latest_snapshot(spark, str(tmp_path))) == {("a", "9"), ("b", "9")}
    assert [(r["term"], r["index"]) for r in persist.prunable(spark, str(tmp_path), 2).collect()] == [(1, 5)]
    assert pairs(persist.from_json_state(persist.to_json_state(state.where("value IS NOT NULL")))) == {("a", "1")}


def test_log_files(spark, tmp_path):
    rows = log(spark, [("a", "1", 1, "SET"), ("a", None, 2, "DEL"), ("b", "2", 3, "SET")])
    persist.append_log(rows, f"{tmp_path}/log")
    persist.compact_log(spark, f"{tmp_path}/log", f"{tmp_path}/base")
    assert pairs(persist.read_log(spark, f"{tmp_path}/base")) == {("b", "2")}


def test_commands_and_config(spark):
    rows = spark.createDataFrame([("SET k v extra",), ("get k",), ("NOPE",), ("COUNT",)], "value string")
    assert [(r.op, r.key, r.value, r.valid) for r in text.commands(rows).collect()] == [("SET", "k", "v", True), ("GET", "k", None, True), ("NOPE", None, None, False), ("COUNT", None, None, True)]
    tree = text.parse_config('{"a": {"b": [1, "x"]}}', "json")
    assert {(r.path, r.value) for r in text.config_rows(spark, tree).collect()} == {("a.b.0", "1"), ("a.b.1", "x")}
    assert text.parse_config("[s]\nk = v", "ini") == {"s": {"k": "v"}} and text.parse_config("k = 1", "toml") == {"k": 1}


def test_scalars(spark):
    row = spark.createDataFrame([("a/b.c.txt", " \tx ", "a,,b,")], "p string, t string, s string").select(scalar.file_name(F.col("p")), scalar.dir_name(F.col("p")), scalar.extension(F.col("p")), scalar.trimmed(F.col("t")), scalar.split_parts(F.col("s"), ","), scalar.fnv1a(F.lit(""))).first()
    assert list(row) == ["b.c.txt", "a", "txt", "x", ["a", "", "b"], 2166136261]


def test_clock(spark):
    rows = spark.createDataFrame([(1, k, i) for i, k in enumerate("abac")], "cache long, key string, at long")
    assert {r.key for r in cache.clock(rows, 2).collect()} == {"a", "c"}


def test_streams(spark, tmp_path):
    rows = log(spark, [("a", "1", 1, "SET"), ("b", "2", 2, "SET"), ("b", None, 3, "DEL")])
    rows.write.parquet(f"{tmp_path}/in")
    source = streams.stream(spark, f"{tmp_path}/in", rows.schema)
    streams.live_state(source).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.key, r.value) for r in spark.sql("SELECT * FROM live").collect()} == {("a", "1")}
    streams.smoothed(source, "key", "seq", 0.5).writeStream.outputMode("update").format("memory").queryName("rates").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.key, r.rate) for r in spark.sql("SELECT * FROM rates").collect()} == {("a", 0.5), ("b", 2.0)}


def test_replica_sets_of_all_orders(spark):
    import hashlib

    from loomlog.model import orders_state
    from loomlog.plans.registry import QUERIES

    d = "/root/testdata/sf0.001"
    h = lambda s: int(hashlib.sha256(s.encode()).hexdigest()[:16], 16)
    vnodes = [(h(f"{node}:{i}"), node) for node in ("node1", "node2", "node3") for i in range(200)]
    want = {}
    for (key,) in orders_state(spark, d).select("key").collect():
        far = {}
        for at, node in vnodes:
            far[node] = min(far.get(node, 1 << 64), (at - h(key)) % (1 << 64))
        want[key] = ",".join(sorted(far, key=far.get)[:2])
    assert len(want) > 500
    got = QUERIES["replica_set"].run(spark, d).collect()
    assert len(got) == len(want) and {r.key: r.replicas for r in got} == want
