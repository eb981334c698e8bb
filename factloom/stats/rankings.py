"""Rank correlation of two orderings of the same rows, without comparing all pairs."""

from __future__ import annotations

from decimal import Decimal
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.order import join_null_safe, value_positions, with_position
from ..session import cut_lineage

BLOCK_ROWS = 500_000
SHRINK = 10  # the grid of blocks has at most about a tenth of the rows
WIDE = "decimal(38,0)"


def _pairs(n) -> Column:
    """Pairs among ``n`` rows, beyond the range of a long."""
    n = F.col(n).cast("decimal(19,0)")
    return (n * (n - 1) / 2).cast(WIDE)


def larger_before(ranks: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each place of a sequence, the weight of earlier places with a larger rank: one stable split per bit of the rank."""
    out, at = np.zeros(len(ranks), dtype=np.int64), np.arange(len(ranks))
    for bit in reversed(range(int(ranks.max(initial=0)).bit_length())):
        here = ranks[at]
        upper, node = (here >> bit) & 1, here >> (bit + 1)
        total = np.cumsum(weights[at] * upper)
        first = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
        start = np.concatenate([[0], total])[first]
        before = total - np.repeat(start, np.diff(np.append(first, len(at))))
        lower = upper == 0
        out[at[lower]] += before[lower]
        at = at[np.argsort(here >> bit, kind="stable")]
    return out


def _count_block(by: list[str], a: str, b: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        group = frame.groupby(by, dropna=False).ngroup().to_numpy() if by else np.zeros(len(frame), dtype=np.int64)
        x, y, w = (frame[c].to_numpy(dtype=np.int64) for c in (a, b, "w"))
        order = np.lexsort((y, x, group))  # equal x ascend by y, so that they never count
        frame, group, y, w = frame.iloc[order], group[order], y[order], w[order]
        by_rank = np.lexsort((y, group))
        new = np.ones(len(y), dtype=np.int64)
        new[1:] = (y[by_rank][1:] != y[by_rank][:-1]) | (group[by_rank][1:] != group[by_rank][:-1])
        ranks = np.empty(len(y), dtype=np.int64)
        ranks[by_rank] = np.cumsum(new) - 1
        before = larger_before(ranks, w)
        if int(w.max()) * int(w.sum()) * len(w) >= 1 << 62:  # copies of rows can make products beyond 64 bits
            before, w = before.astype(object), w.astype(object)
        first = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1])
        found = frame.iloc[first][by].reset_index(drop=True)
        found["discordant"] = [str(int(n)) for n in np.add.reduceat(before * w, first)]
        return found
    return run


def discordant_pairs(points: DataFrame, by=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, discordant): weighted pairs of ``points`` (by, a, b, w) with a smaller in ``a`` and larger in ``b``, per group.

    ``a``, ``b`` and ``w`` are longs and (by, a, b) is unique. Rows are sorted by (a, b) and cut into blocks, and by (b, a)
    likewise. A pair inside one block of either order is counted in that block by a merge count; all other pairs
    differ in both blocks, and as equal values ascend in the other order, such a pair is discordant exactly if its
    blocks are. So only the grid of blocks with its summed weights is left, and goes through the same again. A block holds the
    root of ten times the rows, ``block_rows`` at least, so the grid has about a tenth of the rows at most. Groups
    lie one after the other in both orders: a large group is cut, small ones share a block.
    """
    by, parts = list(by), []
    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by), "discordant string"])
    left = points.select(*by, "a", "b", "w")
    while True:
        placed = with_position(left, [*by, "a", "b"], "_p")
        n = placed.count()
        block = max(block_rows, isqrt(SHRINK * n))
        placed = placed.withColumn("_x", F.expr(f"_p div {block}")).drop("_p")
        if n <= block:
            parts.append(placed.groupBy("_x").applyInPandas(_count_block(by, "a", "b"), schema))
            break
        placed = with_position(placed, [*by, "b", "a"], "_q").withColumn("_y", F.expr(f"_q div {block}")).drop("_q")
        parts.append(placed.groupBy("_x").applyInPandas(_count_block(by, "a", "b"), schema))
        parts.append(placed.groupBy("_y").applyInPandas(_count_block(by, "_x", "b"), schema))
        cells = cut_lineage(placed.groupBy(*by, "_x", "_y").agg(F.sum("w").alias("w")))
        cut = cells.groupBy(*by).agg(*[f(c).alias(f"{c}{k}") for c in ("_x", "_y") for k, f in enumerate((F.min, F.max))])
        cut = cut.where("_x0 < _x1 AND _y0 < _y1").select(*by)  # the others lie in one block
        if cut.isEmpty():
            break
        cells = join_null_safe(cells, cut, by, "left_semi") if by else cells
        left = cells.select(*by, F.col("_x").alias("a"), F.col("_y").alias("b"), "w")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy(*by).agg(F.sum(F.col("discordant").cast(WIDE)).cast(WIDE).alias("discordant"))


KEY_TYPES = "tinyint smallint int bigint float double string boolean date timestamp timestamp_ntz binary".split()


def _sortable(df: DataFrame, col: str) -> Column | None:
    """A column as longs or doubles of the same order; None for types that have no such form here."""
    kind = df.schema[col].dataType
    name = kind.typeName()
    if name in ("byte", "short", "integer", "long"):
        return F.col(col).cast("long")
    if name in ("float", "double"):
        return F.col(col).cast("double")
    if name == "date":
        return F.unix_date(col).cast("long")
    if name == "timestamp":
        return F.unix_micros(col)
    if name == "decimal" and kind.precision <= 18:
        return (F.col(col) * F.lit(Decimal(10 ** kind.scale))).cast("long")
    return None


def _whole_groups(by: list[str]):
    """Ties, rank products and discordant pairs of all groups of a table (by, _l, _r), each as a whole."""
    def run(table: pa.Table) -> pa.Table:
        group = np.zeros(table.num_rows, dtype=np.int64)
        for c in by:
            code = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            group = np.unique(group * (code.max() + 1) + code, return_inverse=True)[1]
        x, y = (table.column(c).to_numpy() for c in ("_l", "_r"))
        order = np.lexsort((y, x, group))  # equal x ascend by y, so that they never count
        group, x, y = group[order], x[order], y[order]

        def differs(v):
            return np.concatenate([[True], v[1:] != v[:-1]])

        head = differs(group)
        first = np.flatnonzero(head)
        total = np.diff(np.append(first, len(group)))
        of = np.repeat(total, total)

        def ranked(new):
            """Tied pairs and the sum of squares per group, and every row's doubled rank less the mean rank."""
            start = np.flatnonzero(new)
            n = np.diff(np.append(start, len(new)))
            tops, size, whole = np.flatnonzero(head[start]), n.astype(np.float64), total.astype(np.float64)
            squares = (whole ** 3 - whole - np.add.reduceat(size ** 3 - size, tops)) / 3
            middle = 2 * (np.repeat(start, n) - np.repeat(first, total)) + np.repeat(n, n) - of
            return np.add.reduceat(n * (n - 1) // 2, tops), squares, middle.astype(np.float64)

        by_y = np.lexsort((y, group))  # groups keep their places
        new_x, new_y = head | differs(x), head | differs(y[by_y])
        tied_a, ss_a, middle_a = ranked(new_x)
        tied_b, ss_b, sorted_b = ranked(new_y)
        tied_both = ranked(new_x | differs(y))[0]
        middle_b, ranks = np.empty(len(y)), np.empty(len(y), dtype=np.int64)
        middle_b[by_y], ranks[by_y] = sorted_b, np.cumsum(new_y) - 1
        discordant = np.add.reduceat(larger_before(ranks, np.ones(len(y), dtype=np.int64)), first)
        out = table.select(by).take(pa.array(order[first]))
        for name, found in (("tied_both", tied_both), ("_sab", np.add.reduceat(middle_a * middle_b, first)), ("_tied_a", tied_a), ("_na", total),
                            ("_ss_a", ss_a), ("_tied_b", tied_b), ("_ss_b", ss_b), ("discordant", discordant)):
            out = out.append_column(name, pa.array(found))
        return out
    return run


def _sums_of_small(rows: DataFrame, by: list[str], n: int, block_rows: int) -> DataFrame:
    """The sums of groups of ``block_rows`` rows at most, ``n`` rows in all: groups share parts by a hash, in one shuffle."""
    parts = 4 * n // block_rows + 1  # about a quarter of a block each, with the largest group less than two blocks
    table = rows.select(*by, *[_sortable(rows, c).alias(c) for c in ("_l", "_r")])
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by), "tied_both long, _sab double, _tied_a long, _na long",
                        "_ss_a double, _tied_b long, _ss_b double, discordant long"])
    found = table.groupBy(F.pmod(F.xxhash64(*by), F.lit(parts)).alias("_part")).applyInArrow(_whole_groups(by), schema)
    return found.withColumns({c: F.col(c).cast(WIDE) for c in ("tied_both", "_tied_a", "_tied_b", "discordant")})


def _sums_of_large(rows: DataFrame, by: list[str], block_rows: int) -> DataFrame:
    """The sums of groups of any size, from positions in value buckets and blocks."""
    merged = cut_lineage(rows.groupBy(*by, "_l", "_r").agg(F.count(F.lit(1)).alias("w")))
    points, ties = merged, {}
    for c, at in (("_l", "a"), ("_r", "b")):
        places = cut_lineage(value_positions(rows, c, by))
        # a rank less the mean rank, doubled, is a whole number
        middle = 2 * F.col("before") + F.col("n") - F.col("total")
        points = join_null_safe(points, places.select(*by, F.col("value").alias(c), F.col("before").alias(at),
                                                      middle.cast("double").alias(f"_m{at}")), [*by, c])
        size, whole = F.col("n").cast("double"), F.col("total").cast("double")
        ties[at] = places.groupBy(*by).agg(
            F.sum(_pairs("n")).cast(WIDE).alias(f"_tied_{at}"), F.max("total").alias(f"_n{at}"),
            ((F.max(whole * whole * whole - whole) - F.sum(size * size * size - size)) / 3).alias(f"_ss_{at}"))
    points = cut_lineage(points)
    sums = points.groupBy(*by).agg(F.sum(_pairs("w")).cast(WIDE).alias("tied_both"),
                                   F.sum(F.col("_ma") * F.col("_mb") * F.col("w")).alias("_sab"))
    for other in (ties["a"], ties["b"], discordant_pairs(points, by, block_rows)):
        sums = join_null_safe(sums, other, by)
    return sums.drop("_nb")


def rank_correlation(df: DataFrame, left: str, right: str, by=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Agreement of two orderings per group: n, concordant, discordant, tied_left, tied_right, tied_both, tau_b, rho.

    ``left`` and ``right`` are numbers, dates or timestamps. Rows where either is NULL or NaN are left out. Counts are pairs of
    rows; pairs tied in both count in all three ties. tau_b is Kendall's coefficient with ties, rho is Spearman's: the
    correlation of mean ranks. Both are NULL where one side is constant or there is one row. Groups of ``block_rows`` rows at
    most are counted whole, many of them by one task. In larger ones equal rows are merged first, ranks come from
    ``value_positions`` and discordant pairs from ``discordant_pairs``; none of them is gathered.
    """
    if not by:
        return rank_correlation(df.withColumn("_all", F.lit(0)), left, right, ["_all"], block_rows).drop("_all")
    by = list(by)
    rows = df.select(*by, F.col(left).alias("_l"), F.col(right).alias("_r")).where("_l IS NOT NULL AND _r IS NOT NULL")
    for c in ("_l", "_r"):
        if rows.schema[c].dataType.typeName() in ("float", "double"):
            rows = rows.where(~F.isnan(c))
    if all(_sortable(rows, c) is not None for c in ("_l", "_r")) and all(rows.schema[c].dataType.simpleString() in KEY_TYPES for c in by):
        rows = rows.withColumns({c: (F.col(c) + 0).cast(rows.schema[c].dataType) for c in by if rows.schema[c].dataType.typeName() in ("float", "double")})
        sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
        large = F.col("_n") > block_rows
        few, many = sizes.agg(F.sum(F.when(~large, F.col("_n"))), F.count(F.when(large, F.lit(1)))).first()
        if many:
            hot = cut_lineage(sizes.where(large).select(*by))  # less than one per block
            sums = _sums_of_large(join_null_safe(rows, hot, by, "left_semi"), by, block_rows)
            if few:
                small = _sums_of_small(join_null_safe(rows, hot, by, "left_anti"), by, few, block_rows)
                sums = sums.unionByName(small)
        else:
            sums = _sums_of_small(rows, by, few or 0, block_rows)
    else:
        sums = _sums_of_large(rows, by, block_rows)
    pairs = _pairs("_na")
    agree = pairs - F.col("_tied_a") - F.col("_tied_b") + F.col("tied_both") - F.col("discordant")
    free = [(pairs - F.col(f"_tied_{c}")).cast("double") for c in ("a", "b")]
    gap = (agree - F.col("discordant")).cast("double")

    def ratio(x, a, b):
        return F.when((a > 0) & (b > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / F.sqrt(a) / F.sqrt(b))))

    return sums.where("_na > 0").select(
        *by, F.col("_na").alias("n"), agree.cast(WIDE).alias("concordant"), "discordant", F.col("_tied_a").alias("tied_left"),
        F.col("_tied_b").alias("tied_right"), "tied_both",
        ratio(gap, *free).alias("tau_b"), ratio(F.col("_sab"), F.col("_ss_a"), F.col("_ss_b")).alias("rho"))
