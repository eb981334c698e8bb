"""Row filters, column choice by name, fills and value limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.keys import _col
from .order import exact_quantiles


def filter_period(df: DataFrame, col: str, low=19991231, high=20190801) -> DataFrame:
    """Rows strictly between two integer dates."""
    return df.where((F.col(col) > low) & (F.col(col) < high))


def exclude_containing(df: DataFrame, col: str, word: str) -> DataFrame:
    """Drop rows whose text contains ``word`` in any case; NULL text is kept."""
    return df.where(F.coalesce(~F.contains(F.lower(F.col(col)), F.lit(word.lower())), F.lit(True)))


def convertible(unit, currencies) -> Column:
    """Units that need no conversion or for which a rate exists."""
    unit = _col(unit)
    return unit.isin(*currencies, "USD") | ~unit.rlike("^[A-Z]{3}$")


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "", exclude=()) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and c not in set(exclude)]


def value_columns(df: DataFrame, exclude=(), indicator_suffixes=("_ispos", "_notna")) -> list[str]:
    """Columns holding values, i.e. neither ids nor companion indicators."""
    return [c for c in df.columns if c not in set(exclude) and not c.endswith(tuple(indicator_suffixes))]


def col_spec(df: DataFrame, exclude=()) -> DataFrame:
    """Table of columns: name, clean name, kind ('binary' for indicators, else 'value'), type, sequence."""
    rows = []
    for i, field in enumerate(f for f in df.schema.fields if f.name not in set(exclude)):
        binary = field.name.endswith(("_ispos", "_notna")) or isinstance(field.dataType, T.BooleanType)
        clean = "".join(ch if ch.isalnum() else "_" for ch in field.name)
        rows.append((i, field.name, clean, "binary" if binary else "value", field.dataType.simpleString()))
    return df.sparkSession.createDataFrame(
        rows, "sequence int, name string, clean_name string, kind string, type string")


def complete_rows(df: DataFrame, cols) -> DataFrame:
    return df.dropna("any", subset=list(cols))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in floating-point columns becomes NULL."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def between_quantiles(df: DataFrame, cols, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Rows whose values lie inside [q(low), q(high)] on every given column."""
    tests = []
    for c in cols:
        limits = exact_quantiles(df, c, {"lo": low, "hi": high}).select(F.struct("lo", "hi").alias("q")).scalar()
        tests.append((c, limits))
    out = df.withColumns({f"_q_{c}": limits for c, limits in tests})
    cond = reduce(lambda a, b: a & b, [F.col(c).between(F.col(f"_q_{c}")["lo"], F.col(f"_q_{c}")["hi"]) for c, _ in tests])
    return out.where(cond).drop(*[f"_q_{c}" for c, _ in tests])


def map_columns(df: DataFrame, cols, fn) -> DataFrame:
    """Apply a column function to every given column."""
    return df.withColumns({c: fn(F.col(c)) for c in cols})


def recode(df: DataFrame, cols, mapping: dict) -> DataFrame:
    """Replace literal values in the given columns; other values stay."""
    def one(c: Column) -> Column:
        out = c
        for old, new in mapping.items():
            out = F.when(c == F.lit(old), F.lit(new)).otherwise(out)
        return out
    return map_columns(df, cols, one)
