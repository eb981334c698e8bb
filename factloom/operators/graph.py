"""Pointers, minimum spanning forests and their merge trees as tables; nothing of a graph is gathered but bounded parts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .order import with_position


TASK_ROWS = 200_000


def one_task(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over a table whose size has been checked."""
    return df.groupBy(F.lit(1).alias("_all")).applyInPandas(run, schema)


def follow(pointers: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """(node, root): where the pointers (node, next) of every node end; a root points to itself. Pointers must not run in circles.

    Each round doubles the way of the nodes that have not arrived, so a chain of n nodes takes log2(n) rounds. Up to
    ``task_rows`` pointers are followed by one task.
    """
    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        to = dict(zip(frame["node"], frame["next"]))
        for node in to:
            way = []
            while to[node] != node:
                way.append(node)
                node = to[node]
            for passed in way:
                to[passed] = node
        return pd.DataFrame({"node": frame["node"], "root": frame["node"].map(to)})

    state = cut_lineage(pointers.select("node", "next", (F.col("node") == F.col("next")).alias("done")))
    if state.count() <= task_rows:
        kind = dict(state.dtypes)["node"]
        return cut_lineage(one_task(state.select("node", "next"), walk, f"node {kind}, root {kind}"))
    while True:
        going = state.where(~F.col("done"))
        if going.isEmpty():
            return state.select("node", F.col("next").alias("root"))
        via = state.select(F.col("node").alias("_n"), F.col("next").alias("_next"), F.col("done").alias("_done"))
        moved = going.join(via, F.col("next") == F.col("_n")).select("node", F.col("_next").alias("next"), F.col("_done").alias("done"))
        state = cut_lineage(state.where("done").unionByName(moved))


def _joiner():
    """The least edges that join components, and where each component ends; travels to the tasks by value."""
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        parent, taken = {}, []

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for a, b, w, x, y in frame.sort_values(["w", "a", "b"])[["a", "b", "w", "ca", "cb"]].itertuples(index=False):
            x, y = find(parent.setdefault(x, x)), find(parent.setdefault(y, y))
            if x != y:
                parent[max(x, y)] = min(x, y)
                taken.append((a, b, w, True))
        rows = taken + [(x, find(x), 0.0, False) for x in parent]
        return pd.DataFrame(rows, columns=["a", "b", "w", "edge"])

    return join


def spanning_forest(edges: DataFrame, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Minimum spanning forest of the links (a, b, w), and (node, component) of their nodes.

    Equal weights are told apart by (a, b), so the forest is unique. In each round every component takes its least edge
    to another one; components are joined along these and edges between the same two reduced to the least. The number
    of rounds grows with the logarithm of the number of nodes; when ``task_rows`` edges or fewer are left, one task joins
    the rest. Links of a node to itself are ignored.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").where("a <> b")
    links = cut_lineage(links.groupBy("a", "b").agg(F.min("w").alias("w")))
    state = links.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    names = cut_lineage(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")))
    forest = None
    while left := state.count():
        if left <= task_rows:
            kind = dict(links.dtypes)["a"]
            rest = cut_lineage(one_task(state.withColumn("w", F.col("w").cast("double")), _joiner(), f"a {kind}, b {kind}, w double, edge boolean"))
            taken = rest.where("edge").select("a", "b", F.col("w").cast(dict(links.dtypes)["w"]).alias("w"))
            forest = taken if forest is None else forest.unionByName(taken)
            roots = rest.where("not edge").select(F.col("a").alias("component"), F.col("b").alias("root"))
            names = cut_lineage(names.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
            break
        sides = state.select(F.col("ca").alias("c"), "w", "a", "b", F.col("cb").alias("o")).unionByName(
            state.select(F.col("cb").alias("c"), "w", "a", "b", F.col("ca").alias("o")))
        least = cut_lineage(sides.groupBy("c").agg(F.min(F.struct("w", "a", "b", "o")).alias("e")).select("c", "e.*"))
        taken = cut_lineage(least.select("a", "b", "w").distinct())
        forest = taken if forest is None else forest.unionByName(taken)
        back = least.select(F.col("c").alias("_c"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        both = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))  # two components that take the same edge: the smaller is the root
        pointers = least.join(back, F.col("o") == F.col("_c")).select(
            F.col("c").alias("node"), F.when(both & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("next"))
        roots = follow(pointers, task_rows)
        to_a, to_b = (roots.select(F.col("node").alias(f"c{s}"), F.col("root").alias(f"r{s}")) for s in "ab")
        moved = state.join(to_a, "ca").join(to_b, "cb").where("ra <> rb")
        state = cut_lineage(moved.groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb"))
                            .agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.a", "e.b", "e.w", "ca", "cb"))
        names = cut_lineage(names.join(roots.select(F.col("node").alias("component"), "root"), "component", "left")
                            .select("node", F.coalesce("root", "component").alias("component")))
    return (links.limit(0) if forest is None else forest), names


def _merger():
    """A function that travels to the tasks by value, without this package."""
    def merges(frame: pd.DataFrame) -> pd.DataFrame:
        """The merge tree of one tree of edges, lightest first."""
        frame = frame.sort_values("rank", ignore_index=True)
        parent, top, size = {}, {}, {}

        def find(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        above, left, right = {}, [], []
        for rank, u, v, nu, nv in zip(frame["rank"], frame["u"], frame["v"], frame["nu"], frame["nv"]):
            for x, n in ((u, nu), (v, nv)):
                if x not in parent:
                    parent[x], size[x] = x, int(n)
            x, y = find(u), find(v)
            for side, out in ((x, left), (y, right)):
                out.append(size[side])
                if side in top:
                    above[top[side]] = rank
            if size[x] < size[y]:
                x, y = y, x
            parent[y], size[x] = x, size[x] + size[y]
            top[x] = rank
        return pd.DataFrame({"rank": frame["rank"], "w": frame["w"], "parent": pd.array([above.get(r) for r in frame["rank"]], dtype="Int64"),
                             "left": left, "right": right})

    return merges


def merge_tree(forest: DataFrame, names: DataFrame, task_edges: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """How the trees of a forest (a, b, w) grow together as its edges come in by weight: two tables.

    Edges: rank (order of weight, a, b), w, parent (rank of the edge that merges the result, NULL at the top of a tree), left,
    right (nodes on both sides before). Nodes: node, parent (rank of its first edge). ``names`` are the components.

    A tree of more than ``task_edges`` edges is cut at a middle rank: the components of its light edges are trees by
    themselves, and its heavy edges are a tree between these components, whose first heavy edge is the parent of their last
    light one. All parts are cut at once until each fits a task, so the depth is the logarithm of the largest tree's size.
    """
    ranked = cut_lineage(with_position(forest.select("a", "b", "w"), ["w", "a", "b"], "rank"))
    nodes = ranked.select(F.col("a").alias("node"), "rank").unionByName(ranked.select(F.col("b").alias("node"), "rank")).groupBy("node").agg(F.min("rank").alias("parent"))
    one = F.lit(1).cast("long")
    of = ranked.join(names.select(F.col("node").alias("a"), "component"), "a")
    tops = of.groupBy("component").agg(F.max("rank").alias("p"))  # a part is named by its last edge
    parts = cut_lineage(of.join(tops, "component").select("p", "rank", "w", F.col("a").alias("u"), F.col("b").alias("v"), one.alias("nu"), one.alias("nv")))
    fit, attached = [], []
    while True:
        sizes = cut_lineage(parts.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("rank", 0.5, 1000).alias("middle")))
        large = sizes.where(F.col("n") > task_edges)
        if large.isEmpty():
            fit.append(parts)
            break
        fit.append(parts.join(large.select("p"), "p", "left_anti"))
        cut = cut_lineage(parts.join(large.select("p", "middle"), "p"))
        light, heavy = cut.where("rank <= middle"), cut.where("rank > middle")
        kind = dict(parts.dtypes)["u"]

        def spot(n):  # the same node can be in several parts
            return F.concat(F.col("p").cast("string"), F.lit(":"), F.col(n).cast("string"))

        _, comps = spanning_forest(light.select(spot("u").alias("a"), spot("v").alias("b"), F.col("rank").alias("w")), task_edges)
        comps = cut_lineage(comps.select("node", F.col("component").alias("c")))
        sub = light.withColumn("node", spot("u")).join(comps, "node")
        last = sub.groupBy("c").agg(F.max("rank").alias("_p"))
        ends = light.select(spot("u").alias("node"), F.col("nu").alias("n")).unionByName(light.select(spot("v").alias("node"), F.col("nv").alias("n"))).distinct()
        weights = ends.join(comps, "node").groupBy("c").agg(F.sum("n").alias("total"))
        whole = cut_lineage(comps.join(weights, "c").join(last, "c"))
        named = heavy
        for side in "uv":
            found = whole.select(F.col("node").alias("_node"), F.regexp_replace("c", "^[0-9]+:", "").cast(kind).alias("_c"), F.col("total").alias("_t"), F.col("_p").alias(f"_p{side}"))
            named = (named.join(found, spot(side) == F.col("_node"), "left").withColumn(side, F.coalesce("_c", side))
                     .withColumn(f"n{side}", F.coalesce("_t", f"n{side}")).drop("_node", "_c", "_t"))
        named = cut_lineage(named)
        touch = named.select(F.col("_pu").alias("rank"), F.col("rank").alias("h")).unionByName(named.select(F.col("_pv").alias("rank"), F.col("rank").alias("h")))
        attached.append(cut_lineage(touch.where(F.col("rank").isNotNull()).groupBy("rank").agg(F.min("h").alias("_up"))))
        columns = ["p", "rank", "w", "u", "v", "nu", "nv"]
        parts = cut_lineage(named.select(*columns).unionByName(sub.join(last, "c").withColumn("p", F.col("_p")).select(*columns)))
    rows = fit[0].select("p", "rank", "w", "u", "v", "nu", "nv")
    for more in fit[1:]:
        rows = rows.unionByName(more.select("p", "rank", "w", "u", "v", "nu", "nv"))
    merges = rows.groupBy("p").applyInPandas(_merger(), "rank long, w double, parent long, left long, right long")
    for up in attached:  # disjoint: each names the last edges of its own parts
        merges = merges.join(up, "rank", "left").withColumn("parent", F.coalesce("parent", "_up")).drop("_up")
    return cut_lineage(merges), cut_lineage(nodes)
