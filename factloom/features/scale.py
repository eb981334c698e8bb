"""Scaling with stored parameters and exact inverses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _params(table: DataFrame) -> dict:
    """One small row per scaled column."""
    return {r["column"]: r for r in table.collect()}


def fit_standard(df: DataFrame, cols, log: bool = False) -> DataFrame:
    """(column, mean, sd) with the population sd, optionally of log1p; one aggregate for all columns."""
    def value(c):
        return F.log1p(c) if log else F.col(c).cast("double")
    entries = [F.struct(F.lit(c).alias("column"), F.avg(value(c)).alias("mean"), F.stddev_pop(value(c)).alias("sd"))
               for c in cols]
    return df.agg(F.array(*entries).alias("p")).select(F.inline("p"))


def standardise(df: DataFrame, params: DataFrame, log: bool = False) -> DataFrame:
    """(x - mean) / sd; a column with sd 0 becomes 0."""
    def scaled(c, p):
        x = F.log1p(c) if log else F.col(c).cast("double")
        return (x - F.lit(p["mean"])) / F.lit(p["sd"] or 1.0)
    return df.withColumns({c: scaled(c, p) for c, p in _params(params).items()})


def log_standardise(df: DataFrame, cols) -> tuple[DataFrame, DataFrame]:
    """log1p and standardise: (scaled table, fitted parameters)."""
    params = fit_standard(df, cols, log=True)
    return standardise(df, params, log=True), params


def un_log_scale(df: DataFrame, params: DataFrame, neg: bool = True, nan: bool = True) -> DataFrame:
    """Exact inverse: scale, mean, expm1, then signs and missing values from the indicator columns."""
    changes, used = {}, []
    for c, p in _params(params).items():
        x = F.expm1(F.col(c) * F.lit(p["sd"] or 1.0) + F.lit(p["mean"]))
        if neg and f"{c}_ispos" in df.columns:
            x = F.when(F.col(f"{c}_ispos") == 0, -x).otherwise(x)
            used.append(f"{c}_ispos")
        if nan and f"{c}_notna" in df.columns:
            x = F.when(F.col(f"{c}_notna") != 0, x)
            used.append(f"{c}_notna")
        changes[c] = x
    return df.withColumns(changes).drop(*used)


def fit_minmax(df: DataFrame, cols) -> DataFrame:
    """(column, min, max)."""
    entries = [F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("double")).alias("min"),
                        F.max(F.col(c).cast("double")).alias("max")) for c in cols]
    return df.agg(F.array(*entries).alias("p")).select(F.inline("p"))


def minmax_scale(df: DataFrame, limits: DataFrame) -> DataFrame:
    """(x - min) / (max - min); NULL for a constant column."""
    return df.withColumns({
        c: F.try_divide(F.col(c).cast("double") - F.lit(p["min"]), F.lit(p["max"] - p["min"]))
        for c, p in _params(limits).items()})


def minmax_unscale(df: DataFrame, limits: DataFrame) -> DataFrame:
    return df.withColumns({
        c: F.col(c) * F.lit(p["max"] - p["min"]) + F.lit(p["min"]) for c, p in _params(limits).items()})
