"""The data model: a log of versions, and the state that it folds to.

A log row is (key, value, seq, op, ts); op is SET, MOD or DEL. A state row is (key, value, seq). seq is one
order over the whole log, so that runs of any origin merge by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), T.StructField("ts", T.TimestampNTZType())])
SET, MOD, DEL = "SET", "MOD", "DEL"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, mod: bool = False) -> DataFrame:
    """events as a log of users: errors delete; with mod, signups set, purchases modify and the rest does nothing."""
    kind = F.col("event_type")
    op = F.when(kind == "error", DEL).when(kind == "purchase", MOD).when(kind == "signup", SET) if mod else F.when(kind == "error", DEL).otherwise(SET)
    return read(spark, sf_dir, "events").select(F.concat(F.lit("user:"), "user_id").alias("key"), kind.alias("value"), F.col("event_id").alias("seq"), op.alias("op"), "ts")


def orders_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as an ordered keyspace."""
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("key"), F.col("o_orderpriority").alias("value"))
