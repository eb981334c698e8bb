"""Unions and complements."""

from __future__ import annotations

from pyspark.sql import DataFrame


def union_distinct(*parts: DataFrame) -> DataFrame:
    """Rows of all parts without duplicates; columns are matched by name."""
    return union_all(*parts).distinct()


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def except_keys(df: DataFrame, chosen: DataFrame, key) -> DataFrame:
    """Rows whose key was not chosen."""
    on = [key] if isinstance(key, str) else list(key)
    return df.join(chosen.select(*on), on, "left_anti")
