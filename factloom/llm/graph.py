"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import saved


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("_v")).select("u", F.least("u", "_v").alias("_least"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Large and small star steps in turn: every node hands its larger, then its smaller neighbours to the smallest one.
    Neighbours are only reduced to their minimum, never gathered, and the number of rounds grows with the logarithm of
    the longest path. Every round is a saved table. Links of a node to itself and repeated links do no harm.
    """
    edges = saved(links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), few_files=True)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_min_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("_least").alias("v"))
                 .where("u <> v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _min_neighbour(down)
        small = (down.join(least, "u").select(F.col("v").alias("u"), F.col("_least").alias("v"))
                 .unionByName(least.select("u", F.col("_least").alias("v"))).where("u <> v").distinct())
        edges = saved(small, few_files=True)
        # done when every edge leads from a member straight to its smallest node
        roots = edges.select(F.col("v").alias("u")).distinct()
        if (edges.join(roots, "u", "left_semi").isEmpty()
                and edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()):
            break
    to = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return to.unionByName(to.select(F.col("component").alias("node"), "component").distinct())
