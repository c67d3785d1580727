"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a partial-aggregated minimum and a join, written to the shared folder; no component and no
list of links ever meets in one task or on the driver. The minima are written before they are joined, so that
Spark either broadcasts them (by its own threshold) or splits the links of a hub over several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v): every node's greater (large) or not greater (small) neighbours go to the least node of its neighbourhood."""
    both = edges.select(F.col("u"), F.col("v")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    moved = both.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for each node of edges (u, v: long). Nodes without edges have no row."""
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        now = written(star(star(now, True), False), "edges")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:  # stars only: every node points at its least one
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")).distinct())
        seen = mark
