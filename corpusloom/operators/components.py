"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import staged, unstage


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """One row (``node``, ``component``) for each node of ``edges``; the component's id is its smallest node.

    Nulls are dropped, loops and repeated edges count once, an empty table gives an empty one. Each round is
    written to the shared folder; the number of rounds is logarithmic in the longest path.
    """
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where(F.col(u).isNotNull() & F.col(v).isNotNull())
    e = staged(e.distinct(), "cc")
    nodes = e
    e = e.where("u <> v")
    last = None
    while True:  # ends: every round but the last lowers some node's label
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e, before = staged(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"), e
        unstage(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == last:
            break
        last = now
    found = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    every = nodes.select(F.col("u").alias("node")).union(nodes.select(F.col("v").alias("node"))).distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
