"""Caches of bounded size under replacement policies, replayed in the order of an access log.

What a cache holds depends on its whole history, as a key that was evicted and comes again is a new entry. So each
cache of the log (a partition) is replayed by one task from its own accesses in order, in Arrow batches, with only
the cache itself in memory; caches are independent, and there are as many tasks as caches. The module `cache` has
shorter ways for questions of one cache over all accesses, where order matters less.
"""

from __future__ import annotations

import random
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Lru:
    """The entry that was used longest ago goes."""

    def __init__(self, size: int, seed: int = 0):
        self.size, self.held, self.evictions, self.hits = size, OrderedDict(), 0, 0
        self.random = random.Random(seed)

    def use(self, key: str) -> None:
        if key in self.held:
            self.hits += 1
            self.again(key)
            return
        if len(self.held) >= self.size:
            del self.held[self.victim()]
            self.evictions += 1
        self.held[key] = 0
        self.entered(key)

    def again(self, key: str) -> None:
        self.held.move_to_end(key)

    def entered(self, key: str) -> None:
        pass

    def victim(self) -> str:
        return next(iter(self.held))

    def keys(self) -> list[str]:
        return list(self.held)


class Fifo(Lru):
    """The entry that came first goes, used again or not."""

    def again(self, key: str) -> None:
        pass


class Lfu(Lru):
    """The entry used least since it came goes; among these the one that came or was used longest ago."""

    def again(self, key: str) -> None:
        self.held[key] += 1
        self.held.move_to_end(key)

    def victim(self) -> str:
        return min(self.held, key=self.held.get)  # the first of equals


class Random(Fifo):
    def victim(self) -> str:
        return self.random.choice(list(self.held))


class Clock(Lru):
    """Second chance: a hand passes entries in the order in which they came; a used one is spared once."""

    def again(self, key: str) -> None:
        self.held[key] = 1

    def victim(self) -> str:
        while True:
            key = next(iter(self.held))
            if not self.held[key]:
                return key
            self.held[key] = 0
            self.held.move_to_end(key)


class Arc:
    """Adaptive replacement: entries used once and entries used again, with ghosts of either that shift the balance."""

    def __init__(self, size: int, seed: int = 0):
        self.size, self.target, self.evictions, self.hits = size, 0.0, 0, 0
        self.once, self.again, self.ghost_once, self.ghost_again = (OrderedDict() for _ in range(4))

    def use(self, key: str) -> None:
        if key in self.once or key in self.again:
            self.hits += 1
            self.once.pop(key, None)
            self.again.pop(key, None)
            self.again[key] = True
            return
        if key in self.ghost_once:
            self.target = min(self.size, self.target + max(1, len(self.ghost_again) / len(self.ghost_once)))
            self.make_room(False)
            del self.ghost_once[key]
            self.again[key] = True
            return
        if key in self.ghost_again:
            self.target = max(0, self.target - max(1, len(self.ghost_once) / len(self.ghost_again)))
            self.make_room(True)
            del self.ghost_again[key]
            self.again[key] = True
            return
        if len(self.once) + len(self.ghost_once) == self.size:
            if len(self.once) < self.size:
                self.ghost_once.popitem(last=False)
                self.make_room(False)
            else:
                self.once.popitem(last=False)
                self.evictions += 1
        elif (total := len(self.once) + len(self.again) + len(self.ghost_once) + len(self.ghost_again)) >= self.size:
            if total == 2 * self.size:
                self.ghost_again.popitem(last=False)
            self.make_room(False)
        self.once[key] = True

    def make_room(self, ghost_again: bool) -> None:
        if len(self.once) + len(self.again) < self.size:
            return
        self.evictions += 1
        if self.once and (len(self.once) > self.target or (ghost_again and len(self.once) == self.target)):
            self.ghost_once[self.once.popitem(last=False)[0]] = True
        elif self.again:
            self.ghost_again[self.again.popitem(last=False)[0]] = True
        else:
            self.ghost_once[self.once.popitem(last=False)[0]] = True

    def keys(self) -> list[str]:
        return [*self.once, *self.again]


POLICIES = {"LRU": Lru, "FIFO": Fifo, "LFU": Lfu, "RANDOM": Random, "CLOCK": Clock, "ARC": Arc}
HELD = "cache string, key string, position int"


def replayed(log: DataFrame, policy: str, size: int, seed: int = 0) -> DataFrame:
    """cache, key, position: what each cache of log (cache, key, at) holds in the end, in the policy's own order."""
    return _replay(log, policy, size, seed, False)


def replay_stats(log: DataFrame, policy: str, size: int, seed: int = 0) -> DataFrame:
    """cache, accesses, hits, evictions under a policy."""
    return _replay(log, policy, size, seed, True)


def _replay(log: DataFrame, policy: str, size: int, seed: int, stats: bool) -> DataFrame:
    make = POLICIES[policy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, accesses = None, None, 0

        def done() -> pa.RecordBatch:
            if stats:
                return pa.RecordBatch.from_pydict({"cache": pa.array([now], pa.string()), "accesses": pa.array([accesses], pa.int64()), "hits": pa.array([state.hits], pa.int64()), "evictions": pa.array([state.evictions], pa.int64())})
            keys = state.keys()
            return pa.RecordBatch.from_pydict({"cache": pa.array([now] * len(keys), pa.string()), "key": pa.array(keys, pa.string()), "position": pa.array(range(len(keys)), pa.int32())})

        for batch in batches:
            for cache, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or cache != now:
                    if state is not None:
                        yield done()
                    now, state, accesses = cache, make(size, seed), 0
                state.use(key)
                accesses += 1
        if state is not None:
            yield done()

    rows = log.select(F.col("cache").cast("string").alias("cache"), F.col("key").cast("string").alias("key"), "at")
    ordered = rows.repartition("cache").sortWithinPartitions("cache", "at", "key").select("cache", "key")
    return ordered.mapInArrow(run, "cache string, accesses long, hits long, evictions long" if stats else HELD)


__all__ = ["POLICIES", "replay_stats", "replayed"]
