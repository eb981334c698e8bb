"""Nearest neighbours of every vector, exact, with cells that are visited from the nearest outwards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import hash60, uniform
from ..session import cut_lineage
from .vectors import stacker

MAX_CELLS = 4_096
TASK_CELLS = 1 << 20  # distances that a task holds at once


def distinct_vectors(df: DataFrame, key: str, vec: str, lowest: int = 1) -> DataFrame:
    """(id, v, ids, copies): equal vectors as one row with their lowest key, ``lowest`` keys in order, and their number.

    NULL vectors are left out. No group is gathered: keys beyond the lowest are cut off before the shuffle.
    """
    rows = df.where(F.col(vec).isNotNull()).select(F.col(vec).alias("v"), F.col(key).alias("id"))
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= lowest)
    ids = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    copies = rows.groupBy("v").agg(F.count(F.lit(1)).alias("copies"))
    return ids.join(copies, "v").select(F.col("ids")[0].alias("id"), "v", "ids", "copies")


def neighbour_table(points: DataFrame, k: int, block_rows: int = 8_192, seed: int = 0) -> DataFrame:
    """The ``k`` nearest other points of every point (id, v): (id, near), near = array of (distance, id) in this order.

    Points are distinct vectors of one length with unique ids. A point lives in the cell of its nearest anchor
    (one per ``block_rows`` points, MAX_CELLS at most). First it looks at its own cell, then at the next 1, 2, 4, ...
    cells in order of the least distance that any of their points can have; cells that cannot hold anything below the point's k-th
    distance so far are never visited, and only candidates below it travel on. A task compares at most ``block_rows`` points that
    live in a cell with ``block_rows`` visitors. Where distances rule nothing out, every pair of points is compared.
    With fewer than k other points all of them are listed.
    """
    spark, kind = points.sparkSession, dict(points.dtypes)["id"]
    near_type = f"array<struct<distance:double,id:{kind}>>"
    points = cut_lineage(points.select("id", "v"))
    total = points.count()
    wanted = int(min(MAX_CELLS, max(1, -(-total // block_rows))))
    anchors = points.orderBy(hash60("id", seed), "id").limit(wanted).collect()
    if not anchors:
        return spark.createDataFrame([], f"id {kind}, near {near_type}")
    centres, stack = np.array([r["v"] for r in anchors], dtype=np.float64), stacker()

    def to_anchors(v: pd.Series) -> np.ndarray:
        x = stack(v)
        return np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :] - 2 * x @ centres.T, 0))

    @F.pandas_udf("struct<home:int,away:double>")
    def settle(v: pd.Series) -> pd.DataFrame:
        d = to_anchors(v)
        return pd.DataFrame({"home": d.argmin(axis=1).astype(np.int32), "away": d.min(axis=1)})

    living = cut_lineage(points.withColumn("_n", settle("v")).select("id", "v", "_n.home", "_n.away"))
    radii, people = np.full(len(anchors), -np.inf), np.zeros(len(anchors), dtype=np.int64)
    for r in living.groupBy("home").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row per cell
        radii[r["home"]], people[r["home"]] = r["r"], r["n"]
    blocks = np.maximum(1, -(-people // block_rows)).tolist()

    @F.pandas_udf("array<int>")
    def next_cells(v: pd.Series, home: pd.Series, bound: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
        d = to_anchors(v)
        least = d - radii[None, :] - 1e-6 * (1 + d)
        rows = np.arange(len(d))
        least[rows, home.to_numpy()] = -np.inf  # the own cell comes first
        order = np.argsort(least, axis=1, kind="stable")
        a, b = int(start.iat[0]) if len(d) else 0, int(stop.iat[0]) if len(d) else 0
        cells = order[:, a:b]
        ok = (np.take_along_axis(least, cells, axis=1) <= bound.to_numpy()[:, None]) & (people[cells] > 0)
        return pd.Series([c[o].tolist() for c, o in zip(cells, ok)], dtype=object)

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        here, guest = frame[frame["lives"]], frame[~frame["lives"]]
        ids, found = [], []
        if len(here) and len(guest):
            y, names = stack(here["v"]), here["id"].to_numpy()
            half = (y ** 2).sum(axis=1)
            step = max(1, TASK_CELLS // len(names))
            for at in range(0, len(guest), step):
                part = guest.iloc[at:at + step]
                x, own, bound = stack(part["v"]), part["id"].to_numpy(), part["bound"].to_numpy()
                d2 = np.maximum((x ** 2).sum(axis=1)[:, None] + half[None, :] - 2 * x @ y.T, 0)
                d2[own[:, None] == names[None, :]] = np.inf
                slack = 1e-9 * (1 + (x ** 2).sum(axis=1))
                kth = np.partition(d2, min(k, len(names)) - 1, axis=1)[:, min(k, len(names)) - 1]
                limit = np.minimum(kth, np.where(np.isfinite(bound), bound, np.inf) ** 2) + slack
                row, col = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
                exact = np.sqrt(((x[row] - y[col]) ** 2).sum(axis=1))
                order = np.lexsort((names[col], exact, row))
                row, col, exact = row[order], col[order], exact[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                keep = rank < k
                row, col, exact = row[keep], col[keep], exact[keep]
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else []
                for begin, end in zip(starts, np.append(starts[1:], len(row))):
                    ids.append(own[row[begin]])
                    found.append([{"distance": float(e), "id": names[c]} for e, c in zip(exact[begin:end], col[begin:end])])
        return pd.DataFrame({"id": pd.Series(ids, dtype=frame["id"].dtype), "near": pd.Series(found, dtype=object)})

    def spread(n):
        return F.sequence(F.lit(0), n - 1)

    size = F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("cell") + 1)
    state = living.withColumn("near", F.array().cast(near_type)).withColumn("bound", F.lit(float("inf")))
    start, stop = 0, 1
    while start < len(anchors):
        asking = state.withColumn("_cells", next_cells("v", "home", "bound", F.lit(start), F.lit(stop)))
        guests = cut_lineage(asking.select("id", "v", "bound", F.explode("_cells").alias("cell")))
        if guests.isEmpty():
            break
        crowd = guests.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("crowds"))  # a row per cell
        crowd = F.broadcast(crowd)
        going = (guests.join(crowd, "cell").withColumn("crowd", F.floor(uniform("id", seed + 1) * F.col("crowds")).cast("int"))
                 .withColumn("block", F.explode(spread(size))).select("cell", "block", "crowd", "id", "v", "bound", F.lit(False).alias("lives")))
        homes = (living.withColumnRenamed("home", "cell").join(crowd, "cell")
                 .withColumn("block", F.floor(uniform("id", seed + 2) * size).cast("int"))
                 .withColumn("crowd", F.explode(spread(F.col("crowds"))))
                 .select("cell", "block", "crowd", "id", "v", F.lit(None).cast("double").alias("bound"), F.lit(True).alias("lives")))
        met = going.unionByName(homes).groupBy("cell", "block", "crowd").applyInPandas(compare, f"id {kind}, near {near_type}")
        best = met.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("_new"))
        state = state.join(best, "id", "left").withColumn(
            "near", F.when(F.col("_new").isNull(), F.col("near")).otherwise(F.slice(F.array_sort(F.concat("near", "_new")), 1, k))).drop("_new")
        state = cut_lineage(state.withColumn("bound", F.when(F.size("near") == k, F.element_at("near", -1)["distance"]).otherwise(F.lit(float("inf")))))
        start, stop = stop, stop + max(1, stop - start) * (2 if start else 1)
    return state.select("id", "near")


def nearest_neighbours(df: DataFrame, key: str, vec: str, k: int, block_rows: int = 8_192, seed: int = 0) -> DataFrame:
    """The ``k`` nearest other rows of every row with a vector: key, rank, neighbour, distance (Euclidean).

    Exact, in order of (distance, key). Equal vectors are compared once: each copy lists the lowest keys of its own copies at
    distance 0, then those of the neighbouring vectors. ``key`` must identify a row.
    """
    points = cut_lineage(distinct_vectors(df, key, vec, k + 1))
    table = neighbour_table(points, k, block_rows, seed)
    other = F.posexplode_outer("near").alias("_p", "_e")
    named = table.select("id", other).join(points.select(F.col("id").alias("_o"), F.slice("ids", 1, k).alias("_ids")), F.col("_e.id") == F.col("_o"), "left")
    each = F.transform("_ids", lambda i: F.struct(F.col("_e.distance").alias("distance"), i.alias("id")))
    lists = named.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(each))), 1, k).alias("_others"))  # k lists of k
    copies = F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("distance"), i.alias("id")))
    whole = points.join(lists, "id").select("v", copies.alias("_copies"), "_others")
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("_key"), F.col(vec).alias("v"))
    joined = rows.join(whole, "v").select("_key", F.concat("_copies", "_others").alias("_all"))
    ranked = F.slice(F.array_sort(F.filter("_all", lambda s: s["id"] != F.col("_key"))), 1, k)
    return (joined.select("_key", F.posexplode(ranked).alias("_r", "_n"))
            .select(F.col("_key").alias(key), (F.col("_r") + 1).alias("rank"), F.col("_n.id").alias("neighbour"), F.col("_n.distance").alias("distance")))
