"""Connected components of an undirected edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, release, store


def _least(edges: DataFrame) -> DataFrame:
    return store(edges.groupBy("u").agg(F.min("v").alias("m")))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) longs -> (node, root): every node that has an edge, and the least node it reaches.

    Loops and repeated edges do no harm; null ends must not occur. Each round joins edges with one minimum per
    node; both sides are stored tables, so a node with very many edges is a skewed join that Spark can split. The
    number of rounds grows with the logarithm of the longest path.
    """
    now = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = store(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = _least(both)
        large = store(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct())
        discard(both, least)
        least = _least(large)
        joined = large.join(least, "u")
        small = store(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        done = small.exceptAll(now).isEmpty() and now.exceptAll(small).isEmpty()
        discard(now, large, least)
        release(edges.sparkSession)
        now = small
        if done:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
