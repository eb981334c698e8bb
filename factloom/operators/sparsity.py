"""Completeness of wide tables and the choice of columns with many complete rows.

A row is reduced to the pattern of its filled cells. Counts per pattern are built with a partial
aggregate, and every later question is asked of the pattern table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .order import exact_quantiles

MASK_BITS = 62


def completeness_rows(df: DataFrame, cols, out: str = "filled") -> DataFrame:
    """Attach the number of filled cells per row."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return df.withColumn(out, filled)


def completeness_columns(df: DataFrame, cols) -> DataFrame:
    """(column, filled, share) for every given column, from one aggregate."""
    entries = [F.struct(F.lit(c).alias("column"), F.count(c).alias("filled"),
                        F.try_divide(F.count(c), F.count(F.lit(1))).alias("share")) for c in cols]
    return df.agg(F.array(*entries).alias("p")).select(F.inline("p"))


def completeness_quartiles(df: DataFrame, cols) -> DataFrame:
    """Quartiles of the share of filled cells per row."""
    probs = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q100": 1.0}
    q = exact_quantiles(completeness_rows(df, cols, "_f"), "_f", probs)
    return q.select(*[(F.col(c) / len(cols)).alias(c) for c in probs])


def reduce_sparsity(df: DataFrame, cols, min_col: int, min_row: int) -> DataFrame:
    """Keep value columns with more than ``min_col`` values, then rows with more than ``min_row`` of them."""
    counts = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    kept = [c for c in cols if counts[c] > min_col]
    others = [c for c in df.columns if c not in set(cols)]
    slim = completeness_rows(df.select(*others, *kept), kept, "_f")
    return slim.where(F.col("_f") > min_row).drop("_f")


def pattern_counts(df: DataFrame, cols) -> DataFrame:
    """(masks, n): rows by the pattern of their filled cells; bit i % 62 of long i // 62 is set when column i is filled."""
    longs = []
    for start in range(0, max(len(cols), 1), MASK_BITS):
        part = cols[start:start + MASK_BITS]
        longs.append(sum((F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
                          for i, c in enumerate(part)), F.lit(0).cast("bigint")))
    return df.groupBy(F.array(*longs).alias("masks")).agg(F.count(F.lit(1)).alias("n"))


def _filled(i: int):
    return F.col("masks")[i // MASK_BITS].bitwiseAND(F.lit(1 << i % MASK_BITS)) != 0


def greedy_complete_columns(df: DataFrame, cols, ratio: float = 0.75) -> DataFrame:
    """Complete rows for the first 1, 2, ... columns, leaving out columns that cost too many rows.

    When adding a column keeps fewer than ``ratio`` of the previous complete rows it is dropped and
    the rest is tried again. One aggregate per dropped column counts the patterns by the first column they lack,
    which gives all prefixes at once. Result: column_qty, column, complete_rows.
    """
    patterns, left, cols = cut_lineage(pattern_counts(df, cols)), list(range(len(cols))), list(cols)
    counts: list[int] = []
    while left:
        lacks = F.coalesce(*[F.when(~_filled(c), F.lit(i)) for i, c in enumerate(left)], F.lit(len(left)))
        first = {r["at"]: r["n"] for r in patterns.groupBy(lacks.alias("at")).agg(F.sum("n").alias("n")).collect()}
        counts, total = [], sum(first.values())  # at most one row per column
        for i in range(len(left)):
            total -= first.get(i, 0)
            counts.append(total)
        drop = next((i for i in range(1, len(left)) if counts[i] < ratio * counts[i - 1]), None)
        if drop is None:
            break
        left.pop(drop)
    rows = [(i + 1, cols[c], int(counts[i])) for i, c in enumerate(left)]
    return df.sparkSession.createDataFrame(rows, "column_qty int, column string, complete_rows bigint")


def _complete(patterns: DataFrame, sets: list[tuple[int, ...]], width: int) -> np.ndarray:
    """Rows complete on each set of columns: one pass over the patterns, a partial count per set and task."""
    masks = np.zeros((len(sets), -(-width // MASK_BITS)), dtype=np.int64)
    for k, columns in enumerate(sets):
        for c in columns:
            masks[k, c // MASK_BITS] |= 1 << c % MASK_BITS
    step = max(1, 2_000_000 // max(1, masks.size))

    def count(batches):
        totals = np.zeros(len(masks), dtype=np.int64)
        for batch in batches:
            pattern, n = np.stack(batch["masks"].to_numpy()) if len(batch) else masks[:0], batch["n"].to_numpy()
            for start in range(0, len(pattern), step):
                part = pattern[start:start + step, None]
                totals += ((part & masks) == masks).all(axis=2).T @ n[start:start + step]
        hit = np.nonzero(totals)[0]
        yield pd.DataFrame({"candidate": hit, "n": totals[hit]})

    out = np.zeros(len(sets), dtype=np.int64)
    for r in patterns.mapInPandas(count, "candidate bigint, n bigint").groupBy("candidate").agg(F.sum("n").alias("n")).collect():
        out[r["candidate"]] = r["n"]  # one row per set, bounded by the caller
    return out


SETS_PER_TASK, PATTERNS_PER_TASK = 4000, 50_000


def _complete_table(patterns: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(set, n): rows complete on each set of columns; a task compares a block of sets with a block of patterns."""
    sets = cut_lineage(sets)
    set_blocks = max(1, -(-sets.count() // SETS_PER_TASK))
    pattern_blocks = max(1, -(-patterns.count() // PATTERNS_PER_TASK))
    def needed(long):  # the bits of the set's columns in one long of a pattern
        own = F.filter("set", lambda c: F.floor(c / MASK_BITS) == long)
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda m, c: m.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), c % MASK_BITS)))

    def count(left, right):
        if not len(left):
            return pd.DataFrame({"set": [], "n": []})
        masks, pattern, n = np.stack(left["needs"].to_numpy()), right["masks"].to_numpy(), right["n"].to_numpy()
        totals, step = np.zeros(len(masks), dtype=np.int64), max(1, 2_000_000 // masks.size)
        for start in range(0, len(pattern), step):
            part = np.stack(pattern[start:start + step])[:, None]
            totals += ((part & masks) == masks).all(axis=2).T @ n[start:start + step]
        return pd.DataFrame({"set": left["set"], "n": totals})

    left = (sets.select("set", F.array(*[needed(i) for i in range(-(-width // MASK_BITS))]).alias("needs"), F.pmod(F.xxhash64("set"), F.lit(set_blocks)).alias("i"))
            .withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(pattern_blocks - 1).cast("bigint")))))
    right = (patterns.withColumn("j", F.pmod(F.xxhash64("masks"), F.lit(pattern_blocks)))
             .withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(set_blocks - 1).cast("bigint")))))
    parts = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(
        count, "set array<int>, n bigint")
    return cut_lineage(parts.groupBy("set").agg(F.sum("n").alias("n")))


def _levels_as_tables(patterns: DataFrame, kept: DataFrame, size: int, ks, bound: int, width: int) -> list[tuple]:
    """(size, best set, its rows, sets tried) of the sizes in ``ks`` above ``size``, from the sets of that size in ``kept``.

    Sets with the same first columns are joined into sets of one more; those with a part that is not kept go. Nothing
    but the best set of a size reaches the driver.
    """
    out = []
    while size < ks[-1]:
        first, last = F.slice("set", 1, size - 1), F.element_at("set", -1)
        a, b = kept.select("set", first.alias("p"), last.alias("x")), kept.select(first.alias("p"), last.alias("y"))
        grown = a.join(b, "p").where("x < y").select(F.concat("set", F.array("y")).alias("set"))
        if size > 1:  # the two parts it is made of are kept; now those that lack an earlier column
            part = F.transform(F.sequence(F.lit(0), F.lit(size - 2)), lambda j: F.filter("set", lambda c, i: i != j))
            known = grown.select("set", F.explode(part).alias("part")).join(kept.select(F.col("set").alias("part")), "part", "left_semi")
            grown = known.groupBy("set").agg(F.count(F.lit(1)).alias("parts")).where(F.col("parts") == size - 1).select("set")
        level, size = _complete_table(patterns, grown, width), size + 1
        best = level.orderBy(F.desc("n"), "set").first()
        if best is None:
            break
        if size in ks and best["n"] > 0:
            out.append((size, list(best["set"]), best["n"], level.count()))
        kept = level.where(F.col("n") >= bound).select("set")
    return out


def best_column_subset(df: DataFrame, cols, ks, most_sets: int = 20_000) -> DataFrame:
    """The column subset of each size with the most complete rows: column_qty, column_list, complete_rows, tried.

    Exact. A greedy choice gives a bound for the largest size; since complete rows never rise when a column is
    added, sets below that bound cannot be part of an answer, and sets grow level by level from those above it. Of
    equally good sets the one with the earliest columns is given. ``tried`` is the number of sets counted at that size.
    Levels of up to ``most_sets`` sets are made here and sent to the tasks; from the first larger one on, levels are
    tables, made by joins and counted in blocks, with the same result. Sizes with no complete row, or above the number of
    filled columns, have no row.
    """
    cols, ks = list(cols), sorted(set(ks))
    patterns = cut_lineage(pattern_counts(df, cols))
    single = _complete(patterns, [(i,) for i in range(len(cols))], len(cols))
    used = [i for i in range(len(cols)) if single[i]]
    ks = [k for k in ks if k <= len(used)]
    out = []
    if ks:
        chosen = [max(used, key=lambda i: (single[i], -i))]
        bound = int(single[chosen[0]])
        while len(chosen) < ks[-1]:
            options = [i for i in used if i not in chosen]
            rows = _complete(patterns, [tuple(sorted((*chosen, i))) for i in options], len(cols))
            chosen.append(options[int(rows.argmax())])
            bound = int(rows.max())
        bound = max(bound, 1)
        level, rows = [(i,) for i in used], [int(single[i]) for i in used]
        for k in range(1, ks[-1] + 1):
            if k in ks and level:
                best = max(range(len(level)), key=lambda j: (rows[j], tuple(-c for c in level[j])))
                if rows[best] > 0:
                    out.append((k, [cols[c] for c in level[best]], rows[best], len(level)))
            if k == ks[-1]:
                break
            kept = sorted(s for s, n in zip(level, rows) if n >= bound)
            known, level = set(kept), []
            for i, a in enumerate(kept):
                for b in kept[i + 1:]:
                    if a[:-1] != b[:-1]:
                        break
                    grown = (*a, b[-1])
                    if all(grown[:j] + grown[j + 1:] in known for j in range(len(grown) - 2)):
                        level.append(grown)
                if len(level) > most_sets:
                    break
            if len(level) > most_sets:
                table = df.sparkSession.createDataFrame([(list(c),) for c in kept], "set array<int>")
                out += [(size, [cols[c] for c in best], n, tried) for size, best, n, tried in
                        _levels_as_tables(patterns, table, k, ks, bound, len(cols))]
                break
            rows = _complete(patterns, level, len(cols)).tolist() if level else []
    return df.sparkSession.createDataFrame(out, "column_qty int, column_list array<string>, complete_rows bigint, tried bigint")
