"""Reachability over edges, by a semi-naive fixpoint; over forests by doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def closure(edges: DataFrame, start: Column | None = None) -> DataFrame:
    """build_id, s, o: what can be reached from s along one edge or more of (build_id, s, o); only from the nodes s for which
    start holds, if given.

    Each round joins the pairs that the round before found with the edges, and keeps those that are new: so depth isn't
    bounded, and cycles end. A round's pairs are written to the shared folder once, for the rounds after it. Edges are a set;
    repeated ones and loops do no harm, null ends reach nothing. All pairs of a forest are found in few rounds (doubled).
    """
    edges = stored(edges.where("s is not null and o is not null").select("build_id", "s", "o").distinct(), "edges")
    if start is None and edges.groupBy("build_id", "o").count().where("count > 1").isEmpty():
        pairs = doubled(edges)
        if pairs is not None:
            return pairs
    new = edges if start is None else stored(edges.where(start), "reach")
    step = edges.select("build_id", F.col("s").alias("o"), F.col("o").alias("next"))
    found = []
    while not new.isEmpty():
        found.append(new)
        further = new.join(step, ["build_id", "o"]).select("build_id", "s", F.col("next").alias("o")).distinct()
        known = reduce(DataFrame.unionByName, found)
        new = stored(further.join(known, ["build_id", "s", "o"], "left_anti"), "reach")
    return reduce(DataFrame.unionByName, found) if found else new


def doubled(edges: DataFrame) -> DataFrame | None:
    """The closure of stored edges of which none share an o; None if they have a cycle.

    A node then has one ancestor at each distance. Pairs at most n apart joined with those exactly n apart are the pairs n + 1 to
    2n apart, each of them once: nothing is found twice or compared with what is known, and the rounds are as many as the
    depth has binary digits. A cycle shows as a node that reaches itself.
    """
    n, found = 1, [edges.withColumn("apart", F.lit(1))]
    last = found[0]
    while not last.isEmpty():
        if not found[-1].where("s = o").isEmpty():
            return None
        below = last.select("build_id", F.col("s").alias("mid"), "o")
        above = reduce(DataFrame.unionByName, found).select("build_id", "s", F.col("o").alias("mid"), "apart")
        found.append(stored(above.join(below, ["build_id", "mid"]).select("build_id", "s", "o", (F.col("apart") + n).alias("apart")), "reach"))
        n *= 2
        last = found[-1].where(F.col("apart") == n)
    if not found[-1].where("s = o").isEmpty():
        return None
    return reduce(DataFrame.unionByName, found).select("build_id", "s", "o")
