"""Reconstruction errors and what explains them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.groups import max_by_field
from ..operators.order import hash_rank


def recon_error(df: DataFrame, plain, valued, out_suffix: str = "_out", sign_suffix: str = "_ispos",
                out: str = "error") -> DataFrame:
    """Mean absolute error per row; an error in a value counts 1 + |error in its sign| times.

    ``plain`` columns have no sign indicator, ``valued`` ones do; predictions carry ``out_suffix``.
    """
    def miss(c):
        return F.abs(F.col(c) - F.col(c + out_suffix))
    terms = [miss(c) for c in plain] + [miss(c) * (miss(c + sign_suffix) + 1) for c in valued]
    return df.withColumn(out, sum(terms[1:], terms[0]) / F.lit(len(terms)))


def squared_error(df: DataFrame, cols, out_suffix: str = "_out", out: str = "error") -> DataFrame:
    """Mean squared error per row."""
    terms = [F.pow(F.col(c) - F.col(c + out_suffix), F.lit(2.0)) for c in cols]
    return df.withColumn(out, sum(terms[1:], terms[0]) / F.lit(len(terms)))


def error_by_flag(df: DataFrame, flag: str, error: str = "error") -> DataFrame:
    return df.groupBy(flag).agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error"))


def top_anomalies(df: DataFrame, n: int, error: str = "error", key: str = "row_id", flag: str | None = None) -> DataFrame:
    """The n rows with the largest error among those not injected."""
    rows = df if flag is None else df.where(~F.col(flag))
    return rows.orderBy(F.desc(error), F.asc(key)).limit(n)


def top_fields_per_row(df: DataFrame, by, fields, k: int = 3) -> DataFrame:
    """The k fields with the largest error per row, as columns ``field_i`` and ``error_i``.

    ``fields`` maps a field to the columns of squared errors it owns; the largest of them counts.
    """
    def largest(cols):
        cells = [F.col(f"`{c}`") for c in cols]
        return F.greatest(*cells) if len(cells) > 1 else cells[0]
    entries = [F.struct((-largest(cols)).alias("e"), F.lit(f).alias("f")) for f, cols in fields.items()]
    ranked = F.sort_array(F.array(*entries))
    out = df.withColumn("_ranked", ranked)
    picks = []
    for i in range(1, k + 1):
        entry = F.get("_ranked", F.lit(i - 1))
        picks += [entry["f"].alias(f"field_{i}"), (-entry["e"]).alias(f"error_{i}")]
    return out.select(*by, *picks)


def explain_errors(df: DataFrame, by, cols, mapping: DataFrame, out_suffix: str = "_out") -> DataFrame:
    """(row, field, error): squared errors by column, the largest one per original field."""
    errors = df.select(*by, *[F.pow(F.col(f"`{c}`") - F.col(f"`{c}{out_suffix}`"), F.lit(2.0)).alias(c) for c in cols])
    return max_by_field(errors.unpivot(list(by), list(cols), "column", "error"), by, "column", "error", mapping)


def compare_batches(real: DataFrame, fake: DataFrame, key: str, error: str, size: int, seed: int = 0) -> DataFrame:
    """Mean error of random batches of real and fake rows: is_fake, batch, n, mean_error.

    Every row is drawn once; batches have exactly ``size`` rows but for the last one.
    """
    both = (real.select(key, error, F.lit(False).alias("is_fake"))
            .unionByName(fake.select(key, error, F.lit(True).alias("is_fake"))))
    ranked = hash_rank(both, key, seed, ["is_fake"], "_rank", "_total")
    return (ranked.groupBy("is_fake", F.expr(f"(_rank - 1) div {int(size)}").alias("batch"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_error")))


def confusion(df: DataFrame, y: str, yhat: str, labels) -> DataFrame:
    """One row per true label, one count column per predicted label."""
    return df.groupBy(y).pivot(yhat, list(labels)).agg(F.count(F.lit(1))).fillna(0)


def accuracy(df: DataFrame, pairs) -> DataFrame:
    """Share of right predictions per (name, y, yhat) and the share of rows with all right."""
    right = {name: F.col(a).eqNullSafe(F.col(b)) for name, a, b in pairs}
    every = None
    for cond in right.values():
        every = cond if every is None else every & cond
    return df.agg(*[F.avg(c.cast("double")).alias(f"acc_{n}") for n, c in right.items()],
                  F.avg(every.cast("double")).alias("acc_all"))
