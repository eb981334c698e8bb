"""Repeatable samples, random order and row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.keys import hash60
from .order import hash_rank, with_position

def sample_n(df: DataFrame, n: int, key: str, seed: int = 0, by=(), where=None) -> DataFrame:
    """n rows of the table, or of each group, in a repeatable random choice. ``key`` identifies a row."""
    rows = df if where is None else df.where(where)
    return hash_rank(rows, key, seed, by, "_rn", "_total").where(F.col("_rn") <= n).drop("_rn", "_total")


def sample_share(df: DataFrame, share: float, key: str, seed: int = 0) -> DataFrame:
    """About ``share`` of the rows, chosen by a hash of the key; needs no shuffle."""
    return df.where(hash60(key, seed) < F.lit(int(share * (1 << 60))))


def shuffle(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in a repeatable random order."""
    return df.orderBy(hash60(key, seed), key)


def with_sequence(df: DataFrame, order, out: str = "sequence") -> DataFrame:
    """1-based row number over the whole table in a total order."""
    return with_position(df, order, "_pos").withColumn(out, F.col("_pos") + 1).drop("_pos")


def exemplars(df: DataFrame, by, distance: str, key: str, limit: int = 30, k: int = 4, seed: int = 0) -> DataFrame:
    """k random rows among the ``limit`` nearest of each group; ``rank`` is the place by distance."""
    near = Window.partitionBy(*by).orderBy(distance, key)
    shortlist = df.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= limit)
    return sample_n(shortlist, k, key, seed, by)
