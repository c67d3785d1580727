"""A key-value façade over DataFrames: single and batch operations, line commands, transactions.

Every write makes a new state (key, value); nothing is changed in place and there is no isolation between processes. The
state of a store that takes many small writes should be written out (`checkpointed`) now and then, which cuts its lineage.
Engines differ in one thing only that results show: whether a SET of a key that lives replaces its value.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fold, scan, transaction
from .session import workspace

#: Engines by what a SET of a live key does.
ENGINES = {"array": "last", "hash": "last", "rbtree": "first", "btree": "last", "lsm": "last", "btree_optimized": "last"}
#: Longest keys, in bytes, of engines that have a limit.
KEY_BYTES = {"btree": 256}
OPS = "key string, value string, op string, pos long"
MAX_TOKENS = 128


def folded(log: DataFrame, engine: str) -> DataFrame:
    """State of a log (key, value, seq, op) under an engine's merge mode; keys beyond its limit are refused."""
    if engine not in ENGINES:
        raise ValueError(f"unknown engine {engine}")
    if engine in KEY_BYTES:
        log = log.where(F.octet_length("key") <= KEY_BYTES[engine])
    return fold.first_wins(log) if ENGINES[engine] == "first" else fold.latest_wins(log)


class Store:
    """A state and the operations on it."""

    def __init__(self, spark: SparkSession, state: DataFrame | None = None, engine: str = "hash"):
        if engine not in ENGINES:
            raise ValueError(f"unknown engine {engine}")
        self.spark, self.engine = spark, engine
        self.state = spark.createDataFrame([], "key string, value string") if state is None else state.select("key", "value")

    def get(self, key: str) -> str | None:
        row = scan.get(self.state, key).first()
        return None if row is None else row["value"]

    def exists(self, key: str) -> bool:
        return not scan.get(self.state, key).isEmpty()

    def count(self) -> int:
        return self.state.count()

    def execute(self, ops: list[tuple[str, str | None, str]]) -> DataFrame:
        """Apply (key, value, op) in order; key, pos, status: created, replaced, kept, modified, deleted, missing or refused."""
        rows = [(k, v, op, i) for i, (k, v, op) in enumerate(ops)]
        return self.apply(self.spark.createDataFrame(rows, OPS))

    def apply(self, ops: DataFrame) -> DataFrame:
        """execute() of a table of OPS; pos tells their order."""
        limit = KEY_BYTES.get(self.engine)
        refused = F.lit(False) if limit is None else F.octet_length("key") > limit
        first = ENGINES[self.engine] == "first"
        asked = ops.where(~refused)
        keys = asked.select("key").distinct()
        # the keys of a small batch travel to the state, which then isn't shuffled
        had = self.state.join(keys, "key", "left_semi").select("key", F.col("value").alias("before"))
        last = asked.join(had, "key", "left")
        # a key's operations meet in one row, in order; they are few in a batch
        steps = last.groupBy("key", "before").agg(F.array_sort(F.collect_list(F.struct("pos", "op", "value"))).alias("ops"))
        zero = F.struct(F.col("before").alias("value"), F.array().cast("array<struct<pos:bigint,status:string>>").alias("done"))

        def step(state, o):
            live = state["value"].isNotNull()
            value = F.when(o["op"] == "SET", F.when(live & F.lit(first), state["value"]).otherwise(o["value"])).when(o["op"] == "MOD", F.when(live, o["value"])).when(o["op"] == "DEL", F.lit(None).cast("string")).otherwise(state["value"])
            status = F.when(o["op"] == "SET", F.when(live, "kept" if first else "replaced").otherwise("created")).when(o["op"] == "MOD", F.when(live, "modified").otherwise("missing")).when(o["op"] == "DEL", F.when(live, "deleted").otherwise("missing")).otherwise(F.when(live, "found").otherwise("missing"))
            return F.struct(value.alias("value"), F.concat(state["done"], F.array(F.struct(o["pos"].alias("pos"), status.alias("status")))).alias("done"))

        ran = steps.select("key", F.aggregate("ops", zero, step).alias("end"))
        untouched = self.state.join(keys, "key", "left_anti")
        self.state = untouched.unionByName(ran.select("key", F.col("end.value").alias("value")).where("value IS NOT NULL"))
        done = ran.select("key", F.inline("end.done")).select("key", "pos", "status")
        return done.unionByName(ops.where(refused).select("key", "pos", F.lit("refused").alias("status")))

    def set(self, key: str, value: str) -> str:
        return self.execute([(key, value, "SET")]).first()["status"]

    def delete(self, key: str) -> str:
        return self.execute([(key, None, "DEL")]).first()["status"]

    def modify(self, key: str, value: str) -> str:
        return self.execute([(key, value, "MOD")]).first()["status"]

    def batch_set(self, pairs: list[tuple[str, str]]) -> DataFrame:
        return self.execute([(k, v, "SET") for k, v in pairs])

    def batch_delete(self, keys: list[str]) -> DataFrame:
        return self.execute([(k, None, "DEL") for k in keys])

    def batch_result(self, statuses: DataFrame) -> DataFrame:
        """ok, failed: how many operations of a batch did what they were asked to."""
        good = ~F.col("status").isin("missing", "refused")
        return statuses.agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"))

    def command(self, line: str) -> str:
        """The answer to a line of the interactive protocol; verbs in either case."""
        words = line.split()
        verb = words[0].upper() if words else ""
        if len(words) > MAX_TOKENS:
            return "ERROR"
        if verb in ("SET", "MOD") and len(words) >= 3:
            return "OK" if (self.set if verb == "SET" else self.modify)(words[1], words[2]) not in ("missing", "refused") else "NO EXIST"
        if verb == "GET" and len(words) >= 2:
            found = self.get(words[1])
            return "NO EXIST" if found is None else found
        if verb == "DEL" and len(words) >= 2:
            return "OK" if self.delete(words[1]) == "deleted" else "NO EXIST"
        if verb == "EXISTS" and len(words) >= 2:
            return "EXIST" if self.exists(words[1]) else "NO EXIST"
        if verb == "COUNT":
            return str(self.count())
        if verb == "STATUS":
            return f"engine {self.engine}, {self.count()} keys"
        if verb == "ENGINE" and len(words) >= 2 and words[1].lower() in ENGINES:
            self.engine = words[1].lower()
            return "OK"
        return "BYE" if verb == "QUIT" else "ERROR"

    def checkpointed(self) -> Store:
        """Write the state out and go on from what was written."""
        path = workspace(self.spark, "store")
        self.state.write.parquet(path)
        self.state = self.spark.read.schema("key string, value string").parquet(path)
        return self

    def begin(self, level: str = "read_committed") -> Transaction:
        return Transaction(self, level)

    def iterator(self, start: str | None = None, end: str | None = None, size: int = 1000) -> RangeIterator:
        return RangeIterator(self.state, start, end, size)

    def scan_within(self, df: DataFrame, seconds: float) -> tuple[list, bool]:
        """Rows of df that came within some seconds, and whether these are all."""
        ends, out = time.monotonic() + seconds, []
        rows = df.toLocalIterator()
        while True:
            if time.monotonic() >= ends:
                return out, False
            row = next(rows, None)
            if row is None:
                return out, True
            out.append(row)


class Transaction:
    """Operations that the store sees all at once, at commit, or never. At read_uncommitted they go to the store as they come,
    and rollback brings back the state from before."""

    def __init__(self, store: Store, level: str):
        if level not in transaction.LEVELS:
            raise ValueError(f"unknown isolation level {level}")
        self.store, self.level, self.ops, self.status = store, level, [], "active"
        self.before = store.state

    def _add(self, key: str, value: str | None, op: str) -> None:
        if self.status != "active":
            raise ValueError(f"the transaction is {self.status}")
        self.ops.append((key, value, op))
        if self.level == "read_uncommitted":
            self.store.execute(self.ops[-1:])

    def set(self, key: str, value: str) -> None:
        self._add(key, value, "SET")

    def delete(self, key: str) -> None:
        self._add(key, None, "DEL")

    def modify(self, key: str, value: str) -> None:
        self._add(key, value, "MOD")

    def view(self) -> DataFrame:
        """What the transaction sees: its own writes over the store, or over the state at its start from repeatable_read on."""
        base = self.before if self.level in transaction.LEVELS[2:] else self.store.state
        if not self.ops or self.level == "read_uncommitted":
            return base
        seen = Store(self.store.spark, base, self.store.engine)
        seen.execute(self.ops)
        return seen.state

    def get(self, key: str) -> str | None:
        row = scan.get(self.view(), key).first()
        return None if row is None else row["value"]

    def commit(self) -> None:
        if self.status != "active":
            raise ValueError(f"the transaction is {self.status}")
        if self.level != "read_uncommitted" and self.ops:
            self.store.execute(self.ops)
        self.status = "committed"

    def rollback(self) -> None:
        if self.status != "active":
            raise ValueError(f"the transaction is {self.status}")
        if self.level == "read_uncommitted":
            self.store.state = self.before
        self.status, self.ops = "aborted", []


class RangeIterator:
    """A cursor over keys in order, from start to end (exclusive); a page of rows at a time comes to the driver."""

    def __init__(self, state: DataFrame, start: str | None = None, end: str | None = None, size: int = 1000):
        self.state, self.start, self.end, self.size = state, start, end, size
        self.page: list = []
        self.at = -1

    def _load(self, key: str | None, reverse: bool, inclusive: bool) -> bool:
        if reverse:
            rows = scan.range_scan(self.state, self.start, key, with_end=inclusive, limit=self.size, reverse=True).collect()[::-1]
        else:
            start = self.start if key is None or (self.start is not None and key < self.start) else key
            rows = scan.range_scan(self.state, start, self.end, with_start=inclusive or start != key, limit=self.size).collect()
        if rows:
            self.page, self.at = rows, len(rows) - 1 if reverse else 0
        return bool(rows)

    def seek(self, key: str | None = None) -> bool:
        """To the first key at or after key, or the first of all."""
        return self._load(key, False, True)

    def next(self) -> bool:
        if self.at < 0:
            return self.seek()
        if self.at + 1 < len(self.page):
            self.at += 1
            return True
        return self._load(self.page[self.at]["key"], False, False)

    def prev(self) -> bool:
        if self.at > 0:
            self.at -= 1
            return True
        return self.at == 0 and self._load(self.page[0]["key"], True, False)

    def current(self):
        return self.page[self.at] if self.at >= 0 else None


def warmed(state: DataFrame, prefixes: list[str], limit: int = 100) -> DataFrame:
    """The first rows of each prefix, held in memory for what comes next."""
    rows = scan.multi_prefix_scan(state, prefixes, limit * len(prefixes)).select("key", "value").distinct().persist()
    rows.count()
    return rows
