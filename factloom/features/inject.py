"""Artificial rows, label noise and masks for testing a scoring model."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.amounts import normal_quantile
from ..functions.dates import date_parts, from_epoch_days
from ..functions.keys import uniform
from ..operators.sets import union_all


def uniform_rows(spark: SparkSession, n: int, ranges: dict[str, tuple], seed: int = 0, row_id: str = "row_id") -> DataFrame:
    """n rows; each column uniform in (low, high), rounded to ``digits``: name -> (low, high, digits)."""
    rows = spark.range(n).withColumnRenamed("id", row_id)
    return rows.withColumns({
        c: F.round(F.lit(float(lo)) + uniform(row_id, seed + i) * F.lit(float(hi) - float(lo)), digits)
        for i, (c, (lo, hi, digits)) in enumerate(ranges.items())})


def inject_uniform_rows(df: DataFrame, n: int, ranges: dict[str, tuple], seed: int = 0, flag: str = "is_random",
                        trans_day: str | None = None, delay: str | None = None, debit: str | None = None,
                        debit_share: float = 1 / 3) -> DataFrame:
    """Append n random rows and flag them.

    With ``trans_day`` and ``delay`` (both in ``ranges``, as day numbers) the system day and the
    date parts of both days are derived. ``debit`` names a 0/1 column drawn with ``debit_share``.
    """
    fake = uniform_rows(df.sparkSession, n, ranges, seed, "_row")
    if trans_day and delay:
        fake = fake.withColumn("system_day", F.col(trans_day) + F.col(delay))
        fake = fake.withColumns(date_parts(from_epoch_days(trans_day), "trans_date"))
        fake = fake.withColumns(date_parts(from_epoch_days("system_day"), "system_date"))
    if debit:
        fake = fake.withColumn(debit, F.when(uniform("_row", seed + 1000) < debit_share, 1).otherwise(0))
    keep = [c for c in fake.columns if c in df.columns]
    types = dict(df.dtypes)
    fake = fake.select(*[F.col(c).cast(types[c]).alias(c) for c in keep])
    return union_all(df.withColumn(flag, F.lit(False)), fake.withColumn(flag, F.lit(True)))


def fake_truncated_normal(df: DataFrame, cols, n: int, seed: int = 0) -> DataFrame:
    """n rows from normals fitted to each column (sample sd) and cut to its range."""
    stats = df.agg(*[f(c).alias(f"{name}_{i}") for i, c in enumerate(cols)
                     for name, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("sd", F.stddev_samp))]).first()
    rows = df.sparkSession.range(n).withColumnRenamed("id", "row_id")
    std = NormalDist()
    out = {}
    for i, c in enumerate(cols):
        lo, hi, mean, sd = (float(stats[f"{k}_{i}"]) for k in ("lo", "hi", "mean", "sd"))
        if sd == 0:
            out[c] = F.lit(mean)
            continue
        p_lo, p_hi = std.cdf((lo - mean) / sd), std.cdf((hi - mean) / sd)
        # the middle of a 32-bit hash cell, so that the probability is never 0
        p = F.lit(p_lo) + (uniform("row_id", seed + i) + F.lit(0.5 / 2**32)) * F.lit(p_hi - p_lo)
        x = normal_quantile(p) * F.lit(sd) + F.lit(mean)
        out[c] = F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    return rows.withColumns(out)


def flip_labels(df: DataFrame, label: str, key: str, share: float = 0.05, seed: int = 0) -> DataFrame:
    """Invert 0/1 labels of a random share of the rows."""
    return df.withColumn(label, F.when(uniform(key, seed) < share, 1 - F.col(label)).otherwise(F.col(label)))


def smooth_labels(df: DataFrame, label: str, key: str, low: float = 0.7, high: float = 1.2, seed: int = 0) -> DataFrame:
    """Positive labels become a random number in [low, high)."""
    noise = F.lit(low) + uniform(key, seed) * F.lit(high - low)
    return df.withColumn(label, F.when(F.col(label) == 1, noise).otherwise(F.col(label).cast("double")))


def leave_one_out(df: DataFrame, fields, suffixes=("_ispos", "_notna"), ids=()) -> dict[str, DataFrame]:
    """Per field the table without that field and without its indicators."""
    return {f: df.select(*ids, *[c for c in df.columns if c not in {f, *(f + s for s in suffixes), *ids}])
            for f in fields}


def normal_grid(spark: SparkSession, n: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(x, y) grid of inverse-normal quantiles at n evenly spaced probabilities per axis."""
    std = NormalDist()
    points = [(i, std.inv_cdf(low + (high - low) * i / max(n - 1, 1))) for i in range(n)]
    axis = F.array(*[F.lit(z) for _, z in points])
    return (spark.range(1).select(F.posexplode(axis).alias("row", "x"))
            .select("row", "x", F.posexplode(axis).alias("col", "y")))
