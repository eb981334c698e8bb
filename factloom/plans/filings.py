"""Tagged facts in long form to encoded wide reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..features.encode import apply_cat
from ..features.scale import log_standardise
from ..features.split import split_by_group
from ..functions.amounts import case_map, is_currency, unit_method
from ..functions.keys import make_key, split_prefix
from ..operators.dedupe import ambiguous_groups, dedupe_by_priority, priority_from_counts, with_priority
from ..operators.filters import complete_rows, convertible, exclude_containing, filter_period
from ..operators.groups import top_n
from ..operators.joins import convert_currency
from ..operators.reshape import pivot_facts

# fixed values: accounting standards in order of preference
STANDARDS = {"us-gaap": 1, "ifrs": 2, "dei": 3}


def join_submissions(facts: DataFrame, submissions: DataFrame) -> DataFrame:
    """Facts with their report's entity, and the composite report key."""
    subs = submissions.select("adsh", F.col("cik").cast("bigint").alias("cik"), "sic", "period", "fp")
    return (facts.join(subs, "adsh", "left")
            .withColumn("report_ref", make_key(["cik", "coreg", "ddate", "qtrs"])))


def dedupe_facts(facts: DataFrame, skip: int = 0) -> DataFrame:
    """One fact per (report, tag): the most common currency first, then the preferred standard, then the smallest values."""
    priorities = priority_from_counts(facts, "uom", is_currency("uom"), skip)
    base = (with_priority(facts, priorities, "uom", "uom_seq")
            .withColumn("version", F.coalesce(split_prefix("version", "/")[0], F.col("version")))
            .withColumn("version_seq", case_map("version", STANDARDS, len(STANDARDS) + 1)))
    tie = ["version_seq", "uom", "version", "ddate", "qtrs", "value"]
    return dedupe_by_priority(base, ["report_ref", "tag"], "uom_seq", tie).drop("uom_seq", "version_seq")


def popular_tags(facts: DataFrame, n: int = 200) -> DataFrame:
    """The n most reported tags that are not about shares or stock and use one kind of unit."""
    usable = exclude_containing(exclude_containing(facts, "uom", "stock"), "tag", "share")
    mixed = ambiguous_groups(facts.withColumn("_m", unit_method("uom")), ["tag"], "_m")
    return top_n(usable.join(mixed, "tag", "left_anti"), "tag", n)


def wide_filings(facts: DataFrame, rates: DataFrame, tags, currencies, index=("report_ref", "sic", "ddate", "qtrs")) -> DataFrame:
    """Listed tags in the base currency, one row per report."""
    chosen = filter_period(facts.where(F.col("tag").isin(*tags) & convertible("uom", currencies)), "ddate")
    dated = chosen.withColumn("month", F.floor(F.col("ddate") / 100).cast("int"))
    return pivot_facts(convert_currency(dated, rates), list(index), "tag", "value_usd", tags)


def encode_filings(wide: DataFrame, cols, entity: str, shares=(0.7, 0.15, 0.15), seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(encoded reports with a ``split`` column, fitted parameters): complete rows, signs, log, scale, split."""
    signed = apply_cat(complete_rows(wide, cols), cols, ("ispos",))
    scaled, params = log_standardise(signed, cols)
    return split_by_group(scaled, entity, shares, seed), params

