"""Repeatable splits. All draws are hashes of a key, so a plan may be recomputed at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import uniform
from ..operators.order import hash_rank

NAMES = ("train", "valid", "test")


def split_random(df: DataFrame, key: str, shares, seed: int = 0, names=NAMES, out: str = "split") -> DataFrame:
    """Label every row by a hash of its key; ``shares`` add up to 1, intervals are half-open."""
    u, upto, label = uniform(key, seed), 0.0, None
    for name, share in zip(names[:-1], shares[:-1]):
        upto += share
        label = F.when(u < upto, F.lit(name)) if label is None else label.when(u < upto, F.lit(name))
    return df.withColumn(out, label.otherwise(F.lit(names[-1])))


def split_by_group(df: DataFrame, group: str, shares, seed: int = 0, names=NAMES, out: str = "split") -> DataFrame:
    """Label rows so that all rows of a group are in one set."""
    return split_random(df, group, shares, seed, names, out)


def split_exact(df: DataFrame, key: str, share: float, seed: int = 0, names=NAMES, out: str = "split") -> DataFrame:
    """Nested two-way split with exact sizes: floor(share * n) rows first, then the same share of the rest."""
    ranked = hash_rank(df, key, seed, out="_rank", total="_total")
    first = F.floor(F.col("_total") * F.lit(share))
    second = F.floor((F.col("_total") - first) * F.lit(share))
    label = (F.when(F.col("_rank") <= first, names[0])
             .when(F.col("_rank") <= first + second, names[1]).otherwise(names[2]))
    return ranked.withColumn(out, label).drop("_rank", "_total")


def split_counts(df: DataFrame, key: str, n_test: int, n_valid: int, seed: int = 0, out: str = "split") -> DataFrame:
    """Fixed-size test and validation sets; the rest is for training."""
    ranked = hash_rank(df, key, seed, out="_rank", total="_total")
    label = (F.when(F.col("_rank") <= n_test, "test")
             .when(F.col("_rank") <= n_test + n_valid, "valid").otherwise("train"))
    return ranked.withColumn(out, label).drop("_rank", "_total")
