"""Edges of operators beside their queries: vectors, brute force, odd rows, round trips."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlog import client
from loomlog.functions import hashing, scalar, security
from loomlog.operators import aggregate, bloom, eviction, lookup, placement, replication, routing
from loomlog.sources import config, persist, runs, text
from loomlog.streaming import streams


def test_hash_vectors(spark):
    fox = b"The quick brown fox jumps over the lazy dog"
    assert hashing.murmur3_32([b"", fox], 0x9747B28C).tolist() == [0xEBB6C228, 0x2FA826CD] and hashing.murmur3_32([b""], 1).tolist() == [0x514E28B7]
    assert hashing.murmur3_64([fox, b""]).tolist() == [0xE34BBC7BBC071B6C, 0]
    keys = ["x" * n for n in range(40)] + [None, "é"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.hashed(F.col("k"), "murmur3_32", 5).alias("m"), hashing.hashed(F.col("k"), "xxhash_64", 42).alias("x"), F.xxhash64("k").alias("spark")).collect()
    assert all(r.x == r.spark for r in rows if r.k is not None) and [r.m for r in rows if r.k is None] == [None]
    # a batch's longest key makes no difference to the others
    assert all(r.m == int(hashing.murmur3_32([r.k.encode()], 5)[0]) for r in rows if r.k is not None)
    assert spark.createDataFrame([("abc",)], "k string").select(scalar.djb2(F.col("k")), scalar.fnv1a(F.lit("é"))).first()[0] == 193485963


def test_security(spark):
    row = spark.createDataFrame([("data", None)], "a string, b string").select(security.hmac_sha256(F.col("a"), b"k" * 100).alias("h"), security.hmac_hex(F.col("a"), b"k" * 100).alias("g"), security.hmac_hex(F.col("b"), b"k").alias("n"), security.pbkdf2_hex(F.lit("password"), b"salt", 1, 20, "sha1").alias("p")).first()
    assert row.h == row.g and row.n is None and row.p == "0c60c80f961f0e71f3a9b524af6012062fe037a6"
    kept = security.password_hash("secret", 10)
    assert security.password_fits("secret", kept) and not security.password_fits("Secret", kept)


class SlowArc:
    """Adaptive replacement, from its published description, on plain lists."""

    def __init__(self, size):
        self.c, self.p, self.t1, self.t2, self.b1, self.b2 = size, 0.0, [], [], [], []

    def replace(self, x):
        if self.t1 and (len(self.t1) > self.p or (x in self.b2 and len(self.t1) == self.p)):
            self.b1.append(self.t1.pop(0))
        else:
            self.b2.append(self.t2.pop(0))

    def use(self, x):
        if x in self.t1 + self.t2:
            (self.t1 if x in self.t1 else self.t2).remove(x)
        elif x in self.b1:
            self.p = min(self.c, self.p + max(1, len(self.b2) / len(self.b1)))
            self.replace(x)
            self.b1.remove(x)
        elif x in self.b2:
            self.p = max(0, self.p - max(1, len(self.b1) / len(self.b2)))
            self.replace(x)
            self.b2.remove(x)
        else:
            if len(self.t1) + len(self.b1) == self.c:
                if len(self.t1) < self.c:
                    self.b1.pop(0)
                    self.replace(x)
                else:
                    self.t1.pop(0)
            elif len(self.t1 + self.t2 + self.b1 + self.b2) >= self.c:
                if len(self.t1 + self.t2 + self.b1 + self.b2) == 2 * self.c:
                    self.b2.pop(0)
                if len(self.t1) + len(self.t2) >= self.c:
                    self.replace(x)
            self.t1.append(x)
            return
        self.t2.append(x)


def brute_cache(policy, accesses, size):
    if policy == "ARC":
        arc = SlowArc(size)
        for k in accesses:
            arc.use(k)
        return arc.t1 + arc.t2
    held = []  # [key, uses, came, used]
    for now, k in enumerate(accesses):
        entry = next((e for e in held if e[0] == k), None)
        if entry:
            entry[1] += 1
            entry[3] = now
            continue
        if len(held) == size:
            if policy == "CLOCK":
                while held[0][1]:
                    held[0][1] = 0
                    held.append(held.pop(0))
                held.pop(0)
            else:
                held.remove(min(held, key={"FIFO": lambda e: e[2], "LRU": lambda e: e[3], "LFU": lambda e: (e[1], e[3])}[policy]))
        held.append([k, 0, now, now])
    return [e[0] for e in held]


@pytest.mark.parametrize("policy", list(eviction.POLICIES))
def test_evictions(spark, policy):
    rng = random.Random(4)
    log = [(c, f"k{min(rng.randrange(9), rng.randrange(9))}", i) for c in "ab" for i in range(300)]
    got = eviction.replayed(spark.createDataFrame(log, "cache string, key string, at long"), policy, 4).collect()
    for c in "ab":
        held = {r.key for r in got if r.cache == c}
        assert len(held) == 4
        if policy != "RANDOM":
            assert held == set(brute_cache(policy, [k for d, k, _ in log if d == c], 4)), policy
    stats = eviction.replay_stats(spark.createDataFrame(log, "cache string, key string, at long"), policy, 4).collect()
    assert all(r.accesses == 300 and (policy == "ARC" or r.hits + r.evictions + 4 == 300) for r in stats)
    assert eviction.replayed(spark.createDataFrame([], "cache string, key string, at long"), policy, 4).count() == 0


def test_a_key_that_comes_again_is_new(spark):
    log = [("x", k, i) for i, k in enumerate("abcab")]
    rows = spark.createDataFrame(log, "cache string, key string, at long")
    assert [r.key for r in eviction.replayed(rows, "FIFO", 2).orderBy("position").collect()] == ["a", "b"]


def test_bloom(spark):
    bits, hashes = scalar.bloom_size(500, 0.01)
    added = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    others = spark.range(500, 4500).select(F.concat(F.lit("k"), "id").alias("key"))
    for blocked in (False, True):
        made = bloom.build(added, bits, hashes, blocked)
        assert bloom.may_contain(added, made, bits, hashes, blocked).where("NOT maybe").count() == 0
        assert bloom.may_contain(others, made, bits, hashes, blocked).where("maybe").count() < 4000 * (0.05 if blocked else 0.02)
    count = lambda rows: bloom.count_positions(rows, bits, hashes)
    both = bloom.changed(count(added), added=count(others))
    assert sorted(map(tuple, bloom.changed(both, removed=count(others)).collect())) == sorted(map(tuple, count(added).collect()))
    sizes = bloom.scalable_sizes(100, 650, 0.01)
    assert [n for n, _, _ in sizes] == [100, 200, 400] and sizes[0][2] < sizes[-1][2]
    assert bloom.optimised(1000, "memory")["bytes"] < bloom.optimised(1000, "accuracy")["bytes"] and bloom.optimised(1000, "speed")["kind"] == "blocked"


def test_runs_open_only_what_they_need(spark, tmp_path):
    state = spark.range(3000).select(F.format_string("k%05d", "id").alias("key"), F.col("id").cast("string").alias("value"))
    for i in range(3):
        runs.flush(state.where((F.col("key") >= f"k{1000 * i:05d}") & (F.col("key") < f"k{1000 * i + 1000:05d}")), f"{tmp_path}/r{i}", f"{tmp_path}/m", i)
    entries = runs.read_manifest(spark, f"{tmp_path}/m")
    assert entries.agg(F.sum("entries")).first()[0] == 3000
    found = runs.files_between(entries, "k01200", "k01300")
    assert found and all("/r1/" in f for f in found)
    df = runs.scan_runs(spark, entries, "key string, value string", "k01200", "k01300")
    assert df.count() == 101 and "GreaterThanOrEqual(key,k01200)" in df._jdf.queryExecution().toString()
    assert runs.get_from_runs(spark, entries, "key string, value string", "zzz").count() == 0
    assert runs.get_from_runs(spark, entries, "key string, value string", "k00007").first().value == "7"


def test_key_shards_edges(spark):
    shards = spark.createDataFrame([("a", None, "f"), ("b", "f", "m"), ("c", "k", "p"), ("d", "t", None)], "shard string, start string, end string")
    keys = spark.createDataFrame([(k,) for k in ("", "e", "f", "l", "n", "p", "t", "zz", None)], "key string")
    assert [r.shard for r in routing.key_shard(keys, shards).collect()] == ["a", "a", "b", "b", "c", None, "d", "d", None]
    with pytest.raises(ValueError):
        routing.key_shard(keys, shards, 3)


def test_numbered_like_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i) for i in rng.sample(range(-500, 5000), 400)] + [("one", 7)]
    got = {(r.g, r.o): r.nr for r in lookup.numbered(spark.createDataFrame(rows, "g string, o long"), "g", "o").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        for i, o in enumerate(sorted(o for x, o in rows if x == g), 1):
            want[g, o] = i
    assert got == want


def test_replica_lists(spark):
    vnodes = spark.createDataFrame([(str(i), n) for i, n in enumerate("aabca")], "v string, node string").select(F.col("v").cast(scalar.U64).alias("vnode"), "node")
    got = {int(r.vnode): r.node for r in lookup.replica_lists(vnodes, 2).collect()}
    assert got == {0: '["a", "b"]', 1: '["a", "b"]', 2: '["b", "c"]', 3: '["c", "a"]', 4: '["a", "b"]'}


def test_log_override_without_conflict(spark):
    rows = lambda ids, term: spark.createDataFrame([(i, term) for i in ids], "idx long, term long")
    assert sorted(r.idx for r in replication.overridden(rows(range(1, 6), 1), rows(range(1, 4), 1)).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.idx for r in replication.overridden(rows(range(1, 6), 1), rows([], 1)).collect()) == [1, 2, 3, 4, 5]
    assert sorted((r.idx, r.term) for r in replication.overridden(rows(range(1, 3), 2), rows(range(1, 4), 1)).collect()) == [(1, 2), (2, 2)]


def test_percentiles_against_a_sort(spark):
    rng = random.Random(2)
    values = [float(min(rng.randrange(300), rng.randrange(300)) ** 3) for _ in range(900)] + [1e12, None]
    known = sorted(v for v in values if v is not None)
    ranks = {f"p{p}": aggregate.floor_rank(p / 100) for p in (0, 1, 50, 95, 100)}
    got = {r.name: r.value for r in aggregate.rank_percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", ranks).collect()}
    assert got == {f"p{p}": known[int(p / 100 * (len(known) - 1))] for p in (0, 1, 50, 95, 100)}
    same = aggregate.rank_percentiles(spark.createDataFrame([(3.0,)] * 5, "v double"), "v", {"m": aggregate.floor_rank(0.5)}).collect()
    assert [r.value for r in same] == [3.0]


def test_config_formats():
    tree = {"server": {"port": 80, "tags": ["a", "b c", "#x"], "on": True, "rate": 1.5}, "users": [{"name": "x: y", "id": 1}, {"name": "z", "id": 2}]}
    for kind in ("json", "yaml", "toml"):
        assert config.parse(config.dump(tree, kind), kind) == tree, kind
    flat = {"s": {"k": "v", "n": "1"}}
    assert config.parse(config.dump(flat, "ini"), "ini") == flat
    assert config.parse("# c\na:\n- 1\n- b: 2 # d\n  c: 'it''s'\nd: ~\n", "yaml") == {"a": [1, {"b": 2, "c": "it's"}], "d": None}
    with pytest.raises(ValueError):
        config.parse("a: 1\n   b: 2\n", "yaml")
    assert config.get_path(tree, "users[1].name") == "z" and config.get_path(tree, "users[7].name", "-") == "-"
    assert config.set_path(tree, "new.deep", 1)["new"] == {"deep": 1} and "new" not in tree and config.set_path(tree, "users[0].id", 9)["users"][0]["id"] == 9


def test_store_engines(spark):
    store = client.Store(spark, engine="btree")
    assert [r.status for r in store.batch_set([("k" * 257, "v"), ("k", "v")]).orderBy("pos").collect()] == ["refused", "created"] and store.count() == 1
    first = client.Store(spark, engine="rbtree")
    assert [r.status for r in first.batch_set([("a", "1"), ("a", "2")]).orderBy("pos").collect()] == ["created", "kept"] and first.get("a") == "1"
    assert store.command("x " * 129) == "ERROR" and store.command("") == "ERROR"
    with pytest.raises(ValueError):
        client.Store(spark, engine="none")
    t = store.begin("repeatable_read")
    store.set("late", "x")
    assert t.get("late") is None and store.begin().get("late") == "x"
    t.rollback()
    with pytest.raises(ValueError):
        t.commit()


def test_partial_scan(spark):
    store = client.Store(spark)
    rows, whole = store.scan_within(spark.range(10), 60)
    assert whole and len(rows) == 10
    rows, whole = store.scan_within(spark.range(10), 0)
    assert not whole and rows == []


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as dt

    def write(name, hours):
        spark.createDataFrame([("k", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for h in hours], "key string, ts timestamp").write.mode("append").parquet(f"{tmp_path}/in")
        source = streams.stream(spark, f"{tmp_path}/in", "key string, ts timestamp")
        query = streams.hot_windows(source).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)

    write("a", [1, 5])
    write("b", [1.5, 9])  # the watermark is at 4:50, so 1:30 is late
    write("c", [12])
    got = {(r.start.hour, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 1), (5, 1), (9, 1)}


def test_each_batch(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "key string").write.parquet(f"{tmp_path}/in")
    seen = []
    streams.each_batch(streams.stream(spark, f"{tmp_path}/in", "key string"), f"{tmp_path}/c", lambda rows, nr: seen.append(sorted(r.key for r in rows.collect()))).awaitTermination(60)
    assert seen == [["a", "b"]]


def test_sse_without_an_end(spark):
    lines = [("s", i, v) for i, v in enumerate(["data: one", "", ":c", "event: e", "", "id: 3", "data", "", "data: cut"])]
    got = text.server_sent_events(spark.createDataFrame(lines, "stream string, nr long, value string")).collect()
    assert Counter((r.id, r.event, r.data) for r in got) == {(None, "message", "one"): 1, ("3", "message", ""): 1}


def test_skewed_data_set(spark):
    rows = text.generated(spark, 3000, 1, keys=50, skew=1.2)
    top = rows.groupBy("key").count().orderBy(F.desc("count")).collect()
    assert len(top) <= 50 and top[0]["count"] > 300 and rows.exceptAll(text.generated(spark, 3000, 1, keys=50, skew=1.2)).count() == 0


def test_shard_configurations():
    for wrong in ({"shards": 0}, {"shards": 3, "strategy": "x"}, {"shards": 3, "strategy": "range", "splits": ("b", "a")}, {"shards": 2, "replicas": 3}, {"shards": 2, "vnodes": 0}):
        with pytest.raises(ValueError):
            placement.ShardConfig(**wrong)


def test_a_ring_moves_fewer_keys(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("key"))
    n = {s: placement.moves(keys, placement.ShardConfig(4, s), placement.ShardConfig(5, s)).agg(F.sum("n")).first()[0] for s in ("hash", "consistent")}
    assert n["consistent"] < 800 < n["hash"]
    added = placement.moves(keys, placement.ShardConfig(4, "consistent"), placement.ShardConfig(5, "consistent")).select("target").distinct().collect()
    assert [r.target for r in added] == [4]


def test_log_rotation_and_snapshot_stats(spark, tmp_path):
    log = spark.createDataFrame([(f"k{i:03d}", "v" * 96, i, "SET") for i in range(100)], "key string, value string, seq long, op string").coalesce(1)
    persist.append_log(log, f"{tmp_path}/log", bytes_per_file=1000)
    assert len(list((tmp_path / "log").glob("*.parquet"))) == 10 and persist.read_log(spark, f"{tmp_path}/log").count() == 100
    for index in (1, 2, 3):
        persist.write_snapshot(log.select("key", "value"), str(tmp_path), 1, index)
    before = persist.snapshot_stats(spark, str(tmp_path))
    assert before["snapshots"] == 3 and persist.prune(spark, str(tmp_path), 1) == 2
    after = persist.snapshot_stats(spark, str(tmp_path))
    assert after["snapshots"] == 1 and 0 < after["bytes"] < before["bytes"]


def test_log_streams_into_a_log(spark, tmp_path):
    """A log follows another one as it grows; what was copied isn't copied again."""
    schema = "key string, value string, seq long, op string"

    def grow(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        source = streams.stream(spark, f"{tmp_path}/in", schema)
        streams.each_batch(source, f"{tmp_path}/c", lambda part, nr: persist.append_log(part, f"{tmp_path}/out")).awaitTermination(60)
        return persist.read_log(spark, f"{tmp_path}/out").count()

    assert grow([("a", "1", 1, "SET")]) == 1
    assert grow([("a", None, 2, "DEL"), ("b", "2", 3, "SET")]) == 3


def most_rows_read(spark, df):
    """The most rows that a task reads from a shuffle as df is computed, with no join broadcast but on request."""
    store = spark.sparkContext._jsc.sc().statusStore()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    group = f"rows-read-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sparkContext.setJobGroup("", "")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    tracker, most = spark.sparkContext.statusTracker(), 0
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        if tracker.getStageInfo(stage) is not None:
            tasks = store.taskList(stage, 0, 10000)
            for i in range(tasks.size()):
                metrics = tasks.apply(i).taskMetrics()
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead() if metrics.isDefined() else 0)
    return most


def test_bloom_keys_stay_where_they_are(spark):
    bits, hashes = scalar.bloom_size(500, 0.01)
    keys = spark.range(0, 8000, 1, 4).select(F.concat(F.lit("k"), "id").alias("key"))
    added = keys.where("substring(key, 2) < '2'")
    for asked in (bloom.may_contain(keys, bloom.build(added, bits, hashes), bits, hashes), bloom.may_contain(keys, bloom.build(added, bits, hashes, True), bits, hashes, True), bloom.may_contain(keys, bloom.build(added, bits, hashes, True, 64), bits, hashes, True, 64), bloom.may_contain_any(keys, bloom.build_scalable(added, 100, 0.02))):
        assert most_rows_read(spark, asked) < 4000


@pytest.mark.parametrize("blocked, block_bits", [(False, 512), (True, 512), (True, 64)])
def test_bloom_both_ways_of_asking(spark, monkeypatch, blocked, block_bits):
    """Bit by bit as plain sets have it; a filter of one bitmap and of several, keys that are repeated or null."""
    for bits, hashes in ((7, 3), (3000, 5), (150001, 4)):
        added = spark.range(700).select(F.concat(F.lit("k"), "id").alias("key"))
        keys = spark.range(2500).select(F.concat(F.lit("k"), F.col("id") % 2000).alias("key")).unionByName(spark.createDataFrame([(None,)], "key string"))
        of = bloom.positions(F.col("key"), bits, hashes, blocked, block_bits)
        held = {p for r in added.select(of.alias("p")).collect() for p in r.p}
        wanted = sorted((str(r.key), r.key is not None and set(r.p) <= held) for r in keys.select("key", of.alias("p")).collect())
        made = bloom.build(added, bits, hashes, blocked, block_bits)
        for most in (bloom.LOCAL_BITS, 0):
            with monkeypatch.context() as m:
                m.setattr(bloom, "LOCAL_BITS", most)
                found = bloom.may_contain(keys, made, bits, hashes, blocked, block_bits).collect()
            assert sorted((str(r.key), r.maybe) for r in found) == wanted


def test_bloom_register_counts_every_row(spark, oracle, tmp_path):
    """Repeated and null keys are rows of the state that are asked for too."""
    from loomlog.plans.registry import QUERIES

    orders = spark.createDataFrame([(5, "a"), (5, "b"), (2000, "c"), (None, "d")], "o_orderkey long, o_orderpriority string")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("bloom_register", "bloom_scalable"):
        row = QUERIES[name].run(spark, str(tmp_path)).first()
        assert row.asked == 4 and row.none_lost


def test_server_sent_events_in_pieces(spark):
    """Blocks that span pieces, empty blocks, comments, unended tails, a null stream: as a reader of each stream has them."""
    rng = random.Random(4)
    rows, wanted = [], []
    for stream in ("x", "y", None):
        seen, at = [], 0
        for i in range(3000):
            at += rng.choice((1, 1, 7))
            seen.append((at, rng.choice(("", "", "data:a", "data: b", "data: ", ": c", f"id: {i}", "event:e", "data", "retry: 3"))))
        rows += [(stream, *line) for line in seen]
        event = {}
        for _, line in seen:
            if line == "":
                if "data" in event:
                    wanted.append((stream, event.get("id"), event.get("event", "message"), "\n".join(event["data"])))
                event = {}
            elif not line.startswith(":"):
                name, _, rest = line.partition(":")
                rest = rest.removeprefix(" ")
                if name == "data":
                    event.setdefault("data", []).append(rest)
                else:
                    event[name] = rest
    rng.shuffle(rows)
    for cast in ("long", "timestamp", "string"):
        nr = F.lpad(F.col("nr").cast("string"), 9, "0") if cast == "string" else F.col("nr").cast(cast)
        lines = spark.createDataFrame(rows, "stream string, nr long, value string").withColumn("nr", nr)
        assert Counter(map(tuple, text.server_sent_events(lines).collect())) == Counter(wanted)
    assert text.server_sent_events(lines.where("false")).count() == 0


def test_server_sent_events_of_one_stream_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(text, "LINES", 1000, raising=False)
    lines = spark.range(0, 20000, 1, 4).select(F.concat(F.lit("x"), F.col("id") % 1).alias("stream"), F.col("id").alias("nr"), F.when(F.col("id") % 2 == 0, "data: a").otherwise("").alias("value"))
    assert most_rows_read(spark, text.server_sent_events(lines)) < 10000
