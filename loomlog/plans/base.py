"""The table of named queries, and SQL that many of them share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


LOG = "(SELECT 'user:' || user_id AS key, event_type AS value, event_id AS seq, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'SET' END AS op, ts FROM events)"
MODS = "(SELECT 'user:' || user_id AS key, event_type AS value, event_id AS seq, CASE event_type WHEN 'error' THEN 'DEL' WHEN 'purchase' THEN 'MOD' WHEN 'signup' THEN 'SET' END AS op, ts FROM events)"
STATE = "(SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS key, o_orderpriority AS value FROM orders)"
LAST = "(SELECT key, max_by(value, seq) AS value, max_by(op, seq) AS op, max(seq) AS seq FROM {} GROUP BY key)"
SHA64 = "CAST(CAST('0x' || substr(sha256({}), 1, 16) AS UBIGINT) AS DECIMAL(20,0))"
FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii({0}[i]) AS BIGINT))), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"
