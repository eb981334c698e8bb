"""Indicator columns, factor levels, one-hot columns and their inverses.

Fitted parameters are DataFrames with one row per column or level; applying them reads those few
rows and builds column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators.order import HOT_ROWS, entity_windows

MAX_LEVELS = 5_000


def split_sign(df: DataFrame, cols, suffix: str = "_ispos") -> DataFrame:
    """Absolute values plus an indicator: 1 for zero and above, 0 for negative and missing."""
    return df.withColumns({
        **{c + suffix: F.when(F.col(c) >= 0, 1).otherwise(0) for c in cols},
        **{c: F.abs(c) for c in cols}})


def flag_missing(df: DataFrame, cols, suffix: str = "_notna", fill=0.0) -> DataFrame:
    """Missing values filled, plus an indicator: 1 where the value was known."""
    return df.withColumns({
        **{c + suffix: F.col(c).isNotNull().cast("int") for c in cols},
        **{c: F.coalesce(F.col(c), F.lit(fill)) for c in cols}})


def apply_cat(df: DataFrame, cols, kinds=("ispos", "notna")) -> DataFrame:
    """Indicator encoding of value columns, in the order of ``kinds``."""
    for kind in kinds:
        df = split_sign(df, cols) if kind == "ispos" else flag_missing(df, cols)
    return df


def fit_levels(df: DataFrame, cols, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(column, level, code): sorted non-NULL levels per column, codes from 1."""
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "column", "level")
    distinct = long.where(F.col("level").isNotNull()).distinct()
    return entity_windows(distinct, ["column"], ["level"], seq="code", hot_rows=hot_rows)


def encode_levels(df: DataFrame, levels: DataFrame, cols) -> DataFrame:
    """Replace levels by their codes; unseen levels give NULL."""
    for c in cols:
        lookup = levels.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
        df = (df.join(lookup, F.col(c).cast("string") == F.col("_level"), "left")
              .withColumn(c, F.col("_code")).drop("_level", "_code"))
    return df


def decode_levels(df: DataFrame, levels: DataFrame, cols) -> DataFrame:
    """Replace codes by their levels."""
    for c in cols:
        lookup = levels.where(F.col("column") == c).select(F.col("level").alias("_level"), F.col("code").alias("_code"))
        df = (df.join(lookup, F.col(c).cast("bigint") == F.col("_code"), "left")
              .withColumn(c, F.col("_level")).drop("_level", "_code"))
    return df


def level_names(levels: DataFrame, cols) -> dict[str, list[str]]:
    """Levels per column in code order, for building columns; at most ``MAX_LEVELS`` in all."""
    rows = levels.where(F.col("column").isin(*cols)).orderBy("column", "code").limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"more than {MAX_LEVELS} levels; lump the rare ones first")
    return {c: [r["level"] for r in rows if r["column"] == c] for c in cols}


def one_hot_name(col: str, level: str) -> str:
    return f"{col}_{level}"


def one_hot(df: DataFrame, col: str, levels) -> DataFrame:
    """One 0/1 column per level, named ``<col>_<level>``; needs no shuffle. The column itself is dropped."""
    text = F.col(col).cast("string")
    return df.withColumns({one_hot_name(col, v): F.when(text == v, 1).otherwise(0) for v in levels}).drop(col)


def one_hot_decode(df: DataFrame, col: str, levels) -> DataFrame:
    """The level whose column is largest (first on ties); the one-hot columns are dropped."""
    names = [one_hot_name(col, v) for v in levels]
    cells = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    best = F.array_position(cells, F.array_max(cells))
    labels = F.array(*[F.lit(v) for v in levels])
    return df.withColumn(col, F.get(labels, (best - 1).cast("int"))).drop(*names)


def one_hot_mapping(spec: dict[str, list[str]], others=()) -> list[tuple[str, str]]:
    """(encoded column, original field) pairs for explaining errors by field."""
    pairs = [(one_hot_name(c, v), c) for c, levels in spec.items() for v in levels]
    return pairs + [(c, c) for c in others]


def decode_records(df: DataFrame, levels: dict[str, list[str]], limits: DataFrame, logged=(), dates=(),
                   integers=(), digits: int = 2) -> DataFrame:
    """Model-ready records back to readable ones.

    One-hot columns become levels, min-max columns their original values, logged values are undone,
    dates are rebuilt from day numbers, other numbers are rounded to integers or ``digits`` places.
    """
    from .scale import minmax_unscale
    out = reduce(lambda d, c: one_hot_decode(d, c, levels[c]), levels, df)
    out = minmax_unscale(out, limits)
    scaled = [r["column"] for r in limits.select("column").collect()]
    changes = {}
    for c in scaled:
        value = F.expm1(c) if c in logged else F.col(c)
        if c in dates:
            changes[c] = F.date_from_unix_date(F.round(value).cast("int"))
        else:
            changes[c] = F.round(value, 0 if c in integers else digits)
    return out.withColumns(changes)
