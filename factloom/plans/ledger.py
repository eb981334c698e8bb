"""Ledger extraction and anomaly scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..features.encode import fit_levels, level_names, one_hot, one_hot_mapping
from ..features.scale import fit_minmax, minmax_scale
from ..functions.amounts import blank_to, is_numeric
from ..functions.dates import date_parts
from ..functions.keys import account_digits
from ..operators.groups import lump_top_n
from ..operators.sets import union_all, union_distinct
from ..stats.errors import top_fields_per_row
from ..stats.vectors import pca_anomaly


def account_references(current: DataFrame, history: DataFrame, ref: str, out: str) -> DataFrame:
    """(trans_date, document_ref, account): the largest numeric account per document.

    Non-numeric accounts count as 0; current and history are united without duplicates.
    """
    def one(df):
        text = F.trim("account_no")
        account = F.when(is_numeric(text), text.try_cast("bigint")).otherwise(F.lit(0))
        return df.select("trans_date", F.col(ref).alias("document_ref"), account.alias(out))
    return (union_distinct(one(current), one(history))
            .groupBy("trans_date", "document_ref").agg(F.max(out).alias(out)))


def ledger_rows(current: DataFrame, history: DataFrame, customers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """All transactions, current and past, with date parts, delays, account digits and references.

    ``customers`` / ``suppliers``: results of ``account_references`` with ``cust_ref`` / ``supp_ref``.
    Documents without a reference get -1, blank operators 'XX'.
    """
    rows = union_all(current, history)
    keys = ["trans_date", "document_ref"]
    joined = rows.join(suppliers, keys, "left").join(customers, keys, "left")
    return joined.select(
        *[c.alias(n) for n, c in account_digits("account_no").items()],
        "trans_date", *[c.alias(n) for n, c in date_parts("trans_date", "trans_date").items()],
        "system_date", *[c.alias(n) for n, c in date_parts("system_date", "system_date").items()],
        F.datediff("system_date", "trans_date").alias("posting_delay"),
        F.left("document_ref", F.lit(1)).alias("document_ref_l1"),
        "bc_trans_value", "trans_type", blank_to("operator").alias("operator"),
        F.coalesce("cust_ref", F.lit(-1)).alias("cust_ref"), F.coalesce("supp_ref", F.lit(-1)).alias("supp_ref"),
        "document_ref")


def prepare_ledger(rows: DataFrame, factors, numbers, value: str, lump=None, top: int = 100) -> tuple[DataFrame, dict, DataFrame]:
    """(encoded rows, levels by factor, limits): lumping, sign split, log, min-max and one-hot columns."""
    for c in lump or ():
        rows = lump_top_n(rows, c, top)
    rows = rows.withColumn("is_debit", F.when(F.col(value) >= 0, 1).otherwise(0)).withColumn(value, F.log1p(F.abs(value)))
    levels = level_names(fit_levels(rows, factors), factors)
    limits = fit_minmax(rows, [value, *numbers])
    out = minmax_scale(rows, limits).fillna(0.0, [value, *numbers])
    for c in factors:
        out = one_hot(out, c, levels[c])
    return out, levels, limits


def score_ledger(encoded: DataFrame, levels: dict, numbers, key: str, k: int, fields: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows with reconstruction ``error``, top fields per row).

    A linear reconstruction by ``k`` components; an error in a one-hot column counts for its field.
    """
    pairs = one_hot_mapping(levels, [*numbers, "is_debit"])
    cols = [c for c, _ in pairs]
    scored = pca_anomaly(encoded, cols, k)
    squared = scored.select(key, "error", *[F.pow(F.col(f"`{c}`") - F.col(f"`{c}_out`"), F.lit(2.0)).alias(c) for c in cols])
    owned: dict[str, list[str]] = {}
    for c, f in pairs:
        owned.setdefault(f, []).append(c)
    return scored, top_fields_per_row(squared, [key, "error"], owned, fields)

