"""Connected components by alternating large-star and small-star steps; no node's links meet in one place but as a minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (large) or smaller (small) neighbours, and itself, are hung on its least neighbour."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m0")).select(F.col("u").alias("u1"), F.least("u", "m0").alias("m"))
    met = near.join(least, near["u"] == least["u1"])
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u1").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for each node of an edge list (a, b); nodes without links are left out."""
    now = cut(edges.select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        # Done when each node hangs on one smaller node, and this on none.
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up > 0 and down > 0)").isEmpty():
            break
        big = cut(_star(now, True), "edges")
        drop(now)
        now = cut(_star(big, False), "edges")
        drop(big)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
