"""Scans of an ordered keyspace (key, value): point, range, prefix, pages.

Predicates on a stored key column reach the Parquet reader (sources.runs); those on a computed key are filters over a scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .fold import last_ops


def get(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") == key)


def range_scan(state: DataFrame, start: str | None = None, end: str | None = None, *, with_start: bool = True, with_end: bool = False, limit: int | None = None, offset: int = 0, reverse: bool = False, keys_only: bool = False) -> DataFrame:
    """Rows from start to end in key order; reverse runs from the end down. offset and limit count from the first row returned."""
    key = F.col("key")
    if start is not None:
        state = state.where(key >= start if with_start else key > start)
    if end is not None:
        state = state.where(key <= end if with_end else key < end)
    if keys_only:
        state = state.select("key")
    if offset or limit is not None:
        state = state.orderBy(key.desc() if reverse else key.asc()).offset(offset)
        return state if limit is None else state.limit(limit)
    return state.orderBy(key.desc() if reverse else key.asc())


def prefix_scan(state: DataFrame, prefix: str, *, case_sensitive: bool = True) -> DataFrame:
    """Keys that begin with prefix; else by ASCII letters of either case."""
    if case_sensitive:
        return state.where(F.col("key").startswith(prefix))
    return state.where(F.lower("key").startswith(prefix.lower()))


def multi_prefix_scan(state: DataFrame, prefixes: list[str], limit: int) -> DataFrame:
    """position, prefix, key, value: of each prefix at most limit // len(prefixes) keys, the first in order; keys under two
    prefixes come twice. One scan: a row is laid out for each prefix that it has, and ranked within prefixes, first within tasks."""
    each = limit // len(prefixes)
    fits = reduce(lambda a, b: a | b, (F.col("key").startswith(p) for p in prefixes))
    asked = F.filter(F.array(*(F.struct(F.lit(i).alias("position"), F.lit(p).alias("prefix")) for i, p in enumerate(prefixes))), lambda x: F.startswith(F.col("key"), x["prefix"]))
    rows = state.where(fits).select(F.explode(asked).alias("p"), "key", "value").select("p.position", "p.prefix", "key", "value")
    return rows.withColumn("nr", F.row_number().over(Window.partitionBy("position").orderBy("key"))).where(F.col("nr") <= each).drop("nr")


def memtable(log: DataFrame, include_deleted: bool = False) -> DataFrame:
    """key, value, op, seq of the last operations of a log in key order, tombstones too if they are asked for."""
    rows = last_ops(log)
    return (rows if include_deleted else rows.where("op <> 'DEL'")).orderBy("key")


def page(state: DataFrame, after: str | None, size: int) -> DataFrame:
    """key, value, has_more: the next size rows after a key."""
    rows = range_scan(state, after, with_start=False, limit=size + 1)
    at = F.row_number().over(Window.orderBy("key"))  # of size + 1 rows at most
    return rows.select("key", "value", at.alias("at"), F.count("*").over(Window.partitionBy()).alias("n")).where(F.col("at") <= size).select("key", "value", (F.col("n") > size).alias("has_more"))


def matching(state: DataFrame, pattern: str) -> DataFrame:
    return state.where(F.col("key").rlike(pattern))


def similar_keys(state: DataFrame, key: str, distance: int) -> DataFrame:
    return state.where(F.levenshtein("key", F.lit(key), distance) >= 0)


def successor(prefix: bytes) -> bytes | None:
    """The least string above all that begin with prefix: the last byte below 255 plus one, the rest cut; None if there is none."""
    while prefix and prefix[-1] == 255:
        prefix = prefix[:-1]
    return prefix[:-1] + bytes([prefix[-1] + 1]) if prefix else None
