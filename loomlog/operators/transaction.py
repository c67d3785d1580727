"""Transactions over immutable tables: overlays, isolation views, outcomes. A commit is a new table version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DEL, MOD, SET
from .fold import latest_wins

LEVELS = ("read_uncommitted", "read_committed", "repeatable_read", "serializable")


def overlay(base: DataFrame, ops: DataFrame) -> DataFrame:
    """key, value: the base as a transaction sees it after its own operations (key, value, op, pos), the last of a key counting."""
    own = ops.groupBy("key").agg(F.max_by(F.struct("op", F.col("value").alias("new")), "pos").alias("o")).select("key", "o.op", "o.new")
    joined = base.select("key", "value", F.lit(True).alias("had")).join(own, "key", "full")
    seen = F.col("op").isNull() | (F.col("op") == SET) | ((F.col("op") == MOD) & F.col("had"))
    return joined.where(seen).select("key", F.when(F.col("op").isNull(), F.col("value")).otherwise(F.col("new")).alias("value"))


def visible(log: DataFrame, transactions: DataFrame, level: str, started: int | None = None) -> DataFrame:
    """State that a reader of a level sees in a log (txn, key, value, seq, op): all rows, or those of committed
    transactions (txn, status), for the last two levels as of the reader's start."""
    if level not in LEVELS:
        raise ValueError(f"unknown isolation level {level}")
    if level != LEVELS[0]:
        log = log.join(transactions.where("status = 'committed'").select("txn"), "txn", "left_semi")
    if level in LEVELS[2:] and started is not None:
        log = log.where(F.col("seq") <= started)
    return latest_wins(log)


def outcomes(votes: DataFrame, txn: str, yes: Column) -> DataFrame:
    """txn, participants, outcome: committed if every participant votes so."""
    return votes.groupBy(F.col(txn).alias("txn")).agg(F.count("*").alias("participants"), F.when(F.bool_and(yes), "committed").otherwise("aborted").alias("outcome"))


def queue(tasks: DataFrame, k: int) -> DataFrame:
    """The next k of tasks (priority, pos, ...): the highest priority first, in order of arrival within one."""
    return tasks.orderBy(F.desc("priority"), "pos").limit(k)


__all__ = ["DEL", "LEVELS", "outcomes", "overlay", "queue", "visible"]
