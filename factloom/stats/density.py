"""Density clusters from a hierarchy of mutual reachability, without a number of clusters, with outlier scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import TASK_ROWS, follow, merge_tree, one_task, spanning_forest
from ..operators.order import with_position
from ..session import cut_lineage
from .neighbours import distinct_vectors, neighbour_table


def reachability(near: DataFrame, min_samples: int) -> DataFrame:
    """Links (a, b, w) of a neighbour table: w = the largest of the distance and both points' distance to their
    ``min_samples``-th neighbour (to their last one if they have fewer)."""
    core = near.where(F.size("near") > 0).select("id", F.element_at("near", F.least(F.size("near"), F.lit(min_samples)))["distance"].alias("core"))
    pairs = near.select("id", F.explode("near").alias("e")).select(
        F.least("id", "e.id").alias("a"), F.greatest("id", "e.id").alias("b"), F.col("e.distance").alias("d")).groupBy("a", "b").agg(F.min("d").alias("d"))
    ends = [core.select(F.col("id").alias(s), F.col("core").alias(f"core_{s}")) for s in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))


def condensed(edges: DataFrame, nodes: DataFrame, min_size: int, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Clusters and points of a merge tree in which groups below ``min_size`` fall out of a cluster without splitting it.

    Clusters: c, parent (NULL at the top), birth, size, stability, death (largest lambda at which something leaves it). Points:
    node, c (the cluster it leaves, NULL if its whole tree is below ``min_size``), lam. Lambda is 1 / distance.
    """
    edges = cut_lineage(edges.select("rank", "parent", "w", (F.col("left") + F.col("right")).alias("size"),
                                     (F.least("left", "right") >= min_size).alias("split"), (F.lit(1.0) / F.col("w")).alias("lam")))
    big = F.col("size") >= min_size
    # the lowest merge of at least min_size points above every point
    low = follow(edges.select(F.col("rank").alias("node"), F.when(big | F.col("parent").isNull(), F.col("rank")).otherwise(F.col("parent")).alias("next")), task_rows)
    upper = edges.where(big)
    above = upper.select(F.col("rank").alias("parent"), F.col("split").alias("_split"), F.col("lam").alias("_birth"))
    joined = cut_lineage(upper.join(above, "parent", "left"))
    starts = F.col("parent").isNull() | F.col("_split")
    of = cut_lineage(follow(joined.select(F.col("rank").alias("node"), F.when(starts, F.col("rank")).otherwise(F.col("parent")).alias("next")), task_rows)
                     .select(F.col("node").alias("rank"), F.col("root").alias("c")))
    tops = joined.where(starts).select(F.col("rank").alias("c"), F.col("parent").alias("_edge"), F.coalesce("_birth", F.lit(0.0)).alias("birth"), "size")
    tops = tops.join(of.select(F.col("rank").alias("_edge"), F.col("c").alias("parent")), "_edge", "left").drop("_edge")
    tops = cut_lineage(tops)
    merged = low.join(of.withColumnRenamed("rank", "root"), "root", "left").join(edges.select(F.col("rank").alias("root"), "lam"), "root")
    points = cut_lineage(nodes.join(merged.select(F.col("node").alias("parent"), "c", F.when(F.col("c").isNotNull(), F.col("lam")).otherwise(0.0).alias("lam")), "parent").drop("parent"))
    leaving = points.where(F.col("c").isNotNull()).select("c", F.lit(1).cast("long").alias("n"), "lam").unionByName(
        tops.where(F.col("parent").isNotNull()).select(F.col("parent").alias("c"), F.col("size").alias("n"), F.col("birth").alias("lam")))
    sums = leaving.groupBy("c").agg(F.sum(F.col("n") * F.col("lam")).alias("_sum"), F.sum("n").alias("_n"), F.max("lam").alias("death"))
    clusters = tops.join(sums, "c").withColumn("stability", F.col("_sum") - F.col("birth") * F.col("_n")).drop("_sum", "_n")
    return cut_lineage(clusters), points


def _chooser():
    """Which clusters of a part are kept, children first; a function that travels to the tasks by value."""
    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        names = frame["c"].tolist()
        at = {c: i for i, c in enumerate(names)}
        parents = [None if p is None else int(p) for p in frame["parent"].astype(object).where(frame["parent"].notna(), None)]
        up = [at.get(p) for p in parents]
        stability, may = frame["stability"].tolist(), frame["may"].tolist()
        has, below, deepest = frame["has"].tolist(), frame["below"].tolist(), frame["death"].tolist()
        deepest = [max(d, b) if h else d for d, b, h in zip(deepest, frame["below_deepest"].tolist(), has)]
        below = [b if h else 0.0 for b, h in zip(below, has)]
        waits = [0] * len(names)
        for p in up:
            if p is not None:
                waits[p] += 1
        ready, order = [i for i, n in enumerate(waits) if not n], []
        best, kept = [0.0] * len(names), [False] * len(names)
        while ready:
            i = ready.pop()
            order.append(i)
            kept[i] = bool(may[i] and (not has[i] or stability[i] >= below[i]))
            best[i] = stability[i] if kept[i] else below[i]
            p = up[i]
            if p is not None:
                has[p], below[p], deepest[p] = True, below[p] + best[i], max(deepest[p], deepest[i])
                waits[p] -= 1
                if not waits[p]:
                    ready.append(p)
        top = [None] * len(names)
        for i in reversed(order):  # a parent comes after its children, so now before them
            above = None if up[i] is None else top[up[i]]
            top[i] = above if above is not None else i if kept[i] else None
        chosen = pd.array([None if i is None else names[i] for i in top], dtype="Int64")
        return pd.DataFrame({"c": frame["c"], "parent": pd.array(parents, dtype="Int64"), "best": best, "kept": kept, "deepest": deepest, "chosen": chosen})

    return choose


def _depths(clusters: DataFrame) -> DataFrame:
    """(c, depth): the number of clusters above each, by doubling."""
    state = cut_lineage(clusters.select("c", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("depth")))
    while not state.where(F.col("up").isNotNull()).isEmpty():
        via = state.select(F.col("c").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        state = cut_lineage(state.join(via, "up", "left").select("c", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth")))
    return state.select("c", "depth")


def selected(clusters: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(c, chosen, deepest): the topmost chosen cluster above or at each cluster (NULL without one), and the largest
    lambda anywhere below it.

    A cluster is kept if its stability is at least that of the best choice among its descendants; a single top is not
    kept. Up to ``task_rows`` clusters are taken by one task. More are sorted by depth, deepest first, and cut into parts
    of that many, which need only the parts before them; then topmost ones are found by doubling. So the number of
    rounds does not depend on how deep clusters lie in each other.
    """
    several = clusters.where(F.col("parent").isNull()).count() > 1
    columns = ["c", "parent", "stability", "death", (F.col("parent").isNotNull() | F.lit(several)).alias("may")]
    schema = "c long, parent long, best double, kept boolean, deepest double, chosen long"
    none = [F.lit(False).alias("has"), F.lit(0.0).alias("below"), F.lit(0.0).alias("below_deepest")]
    n = clusters.count()
    if n <= task_rows:
        return one_task(clusters.select(*columns, *none), _chooser(), schema).select("c", "chosen", "deepest")
    rest = with_position(clusters.select(*columns).join(_depths(clusters), "c"), [F.desc("depth"), "c"], "_p")
    rest = cut_lineage(rest.withColumn("_part", F.expr(f"_p div {task_rows}")).drop("_p", "depth"))
    done = None
    for part in range(-(-n // task_rows)):
        now = rest.where(F.col("_part") == part).drop("_part")
        if done is None:
            now = now.select("*", *none)
        else:
            below = done.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("c")).agg(
                F.sum("best").alias("below"), F.max("deepest").alias("below_deepest"), F.lit(True).alias("has"))
            now = now.join(below, "c", "left").withColumns({"has": F.col("has").isNotNull(), "below": F.coalesce("below", F.lit(0.0)),
                                                            "below_deepest": F.coalesce("below_deepest", F.lit(0.0))})
        now = one_task(now, _chooser(), schema).drop("chosen")
        done = cut_lineage(now if done is None else done.unionByName(now))
    state = cut_lineage(done.select("c", "deepest", F.col("parent").alias("up"), F.when(F.col("kept"), F.col("c")).alias("chosen")))
    while not state.where(F.col("up").isNotNull()).isEmpty():
        via = state.select(F.col("c").alias("up"), F.col("up").alias("_up"), F.col("chosen").alias("_chosen"))
        state = cut_lineage(state.join(via, "up", "left").select("c", "deepest", F.col("_up").alias("up"), F.coalesce("_chosen", "chosen").alias("chosen")))
    return state.select("c", "chosen", "deepest")


def density_clusters(df: DataFrame, key: str, vec: str, min_size: int = 5, min_samples: int | None = None, k: int | None = None,
                     outlier: int = -1, block_rows: int = 8_192, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` with cluster, probability and outlier_score per row.

    Links join every vector to its ``k`` nearest ones (default: twice ``min_samples``) and weigh as much as their mutual reachability.
    Their minimum spanning forest is merged by weight; groups of ``min_size`` and more are clusters, and of nested ones
    the most stable are kept. Trees that no link joins count as joined at infinite distance. With k of all other vectors
    this is the hierarchy over all pairs; with fewer, links that no vector has among its nearest are missing.

    ``cluster`` counts from 0 in order of the clusters' lowest keys, ``outlier`` means none. ``probability`` is how long a row
    stays in its cluster (1: to the end, 0: no cluster), ``outlier_score`` how much earlier it leaves than the densest part
    of where it was (0 to 1). Equal vectors count once and share the result. Rows without a vector get NULLs. ``key`` must
    identify a row.
    """
    if min_size < 2:
        raise ValueError("min_size must be 2 or more")
    min_samples = min_size if min_samples is None else min_samples
    points = cut_lineage(distinct_vectors(df, key, vec).select("id", "v"))
    near = neighbour_table(points, max(k or 2 * min_samples, min_samples), block_rows)
    forest, names = spanning_forest(reachability(near, min_samples), task_rows)
    clusters, left = condensed(*merge_tree(forest, names, task_rows), min_size, task_rows)
    best = cut_lineage(selected(clusters, task_rows))
    death = clusters.select(F.col("c").alias("chosen"), "death")
    scored = cut_lineage(left.join(best, "c", "left").join(death, "chosen", "left"))
    first = scored.where(F.col("chosen").isNotNull()).groupBy("chosen").agg(F.min("node").alias("_first"))
    numbers = with_position(first, ["_first"], "_cluster").select("chosen", F.col("_cluster").cast("int").alias("_cluster"))
    labelled = scored.join(numbers, "chosen", "left").select(
        F.col("node").alias("id"), F.coalesce("_cluster", F.lit(outlier)).alias("_cluster"),
        F.when(F.col("chosen").isNull(), 0.0).otherwise(F.least("lam", "death") / F.col("death")).alias("_probability"),
        F.when(F.col("c").isNull(), 1.0).otherwise((F.col("deepest") - F.col("lam")) / F.col("deepest")).alias("_score"))
    alone = points.join(labelled, "id", "left").select(  # a vector without any other is in no tree
        F.col("v").alias("_v"), F.coalesce("_cluster", F.lit(outlier)).alias("cluster"),
        F.coalesce("_probability", F.lit(0.0)).alias("probability"), F.coalesce("_score", F.lit(1.0)).alias("outlier_score"))
    kept = df.drop("cluster", "probability", "outlier_score")
    return kept.join(alone, F.col(vec) == F.col("_v"), "left").drop("_v")
