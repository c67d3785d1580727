"""A session with the settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(name: str = "loomlog", **settings: str) -> SparkSession:
    """getOrCreate() with SETTINGS; keyword names use __ for dots."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession, what: str) -> str:
    """A new folder that all nodes share, in spark.checkpoint.dir; where that is unset a temporary one will do, but on one machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="loomlog-")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"
