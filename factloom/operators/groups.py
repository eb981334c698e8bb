"""Counts, profiles and group-level values."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from .order import HOT_ROWS, entity_windows, exact_quantiles, join_null_safe


def count_by(df: DataFrame, cols, out: str = "n") -> DataFrame:
    """Group counts, most frequent first."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), *cols)


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Frequencies of the non-NULL values of one column."""
    return count_by(df.where(F.col(col).isNotNull()), [col], out)


def top_n(df: DataFrame, col: str, n: int, out: str = "n") -> DataFrame:
    """The n most frequent values."""
    return value_counts(df, col, out).limit(n)


def top_n_per_group(df: DataFrame, by, order, n: int, out: str = "rank") -> DataFrame:
    """The first n rows per group in a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def best_per_group(df: DataFrame, by, metric: str, tie, minimise: bool = True) -> DataFrame:
    """The row with the lowest (or highest) metric per group."""
    lead = F.asc_nulls_last(metric) if minimise else F.desc_nulls_last(metric)
    return top_n_per_group(df, by, [lead, *tie], 1, "_rn").drop("_rn")


def best_run(df: DataFrame, metric: str, tie: str, minimise: bool = True, where=None) -> DataFrame:
    """The run with the best metric, first on ties."""
    lead = F.asc_nulls_last(metric) if minimise else F.desc_nulls_last(metric)
    return (df if where is None else df.where(where)).orderBy(lead, tie).limit(1)


def attach_aggregates(df: DataFrame, by, aggs: dict) -> DataFrame:
    """Attach group aggregates to every row (aggregate first, then join back)."""
    stats = df.groupBy(*by).agg(*[c.alias(name) for name, c in aggs.items()])
    return join_null_safe(df, stats, list(by))


def flag_any(df: DataFrame, by, item: str, items, out: str) -> DataFrame:
    """1 on every row of a group that has any of the items, else 0."""
    return attach_aggregates(df, by, {out: F.max(F.when(F.col(item).isin(*items), 1).otherwise(0))})


def conditional_counts(df: DataFrame, conditions: dict, by=()) -> DataFrame:
    """Row counts by condition, one column each."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def items_with_example(df: DataFrame, item: str, example: str, order) -> DataFrame:
    """Per item the row count and the example of the first row in a total order."""
    return df.groupBy(item).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(example, F.struct(*order)).alias("example"))


def concat_group(df: DataFrame, by, col: str, order, part_rows: int, sep: str = " ", out: str = "text",
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join the texts of a group in order, in parts of ``part_rows`` rows.

    Every group comes as its parts, numbered by ``part`` from 0, so that no text grows with the size of one group.
    """
    numbered = entity_windows(df.where(F.col(col).isNotNull()), by, order, seq="_seq", hot_rows=hot_rows)
    parts = numbered.withColumn("part", F.expr(f"cast((_seq - 1) div {part_rows} as int)"))
    items = F.array_sort(F.collect_list(F.struct("_seq", F.col(col).alias("_t"))))
    return parts.groupBy(*by, "part").agg(
        F.array_join(F.transform(items, lambda s: s["_t"]), sep).alias(out))


def histogram(df: DataFrame, col: str, width: float, by=()) -> DataFrame:
    """Counts per bin [k * width, (k + 1) * width)."""
    return (df.where(F.col(col).isNotNull())
            .groupBy(*by, (F.floor(F.col(col) / F.lit(width)) * F.lit(width)).alias("bin_start"))
            .agg(F.count(F.lit(1)).alias("n")))


def histogram_edges(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins of [low, high]; 0 is below, bins + 1 above, the last bin is closed."""
    bucket = F.when(F.col(col) == high, F.lit(bins)).otherwise(
        F.width_bucket(F.col(col), F.lit(low), F.lit(high), F.lit(bins)))
    return (df.where(F.col(col).isNotNull()).groupBy(bucket.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def describe(df: DataFrame, cols, probs: dict[str, float], by=()) -> DataFrame:
    """Count, mean, sample sd, min, exact quantiles and max; one row per column (and group)."""
    long = df.unpivot(list(by), [F.col(c).cast("double").alias(c) for c in cols], "column", "_v")
    keys = [*by, "column"]
    basics = long.groupBy(*keys).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"),
        F.min("_v").alias("min"), F.max("_v").alias("max"))
    return join_null_safe(basics, exact_quantiles(long, "_v", probs, keys), keys, "left")


def profile(df: DataFrame, cols=None) -> DataFrame:
    """Per column: rows, missing, distinct values and, for numbers, mean, skewness, kurtosis, min, max."""
    cols = list(cols or df.columns)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    none = F.lit(None).cast("double")

    def entry(c):
        number = F.col(c).cast("double")
        stats = {"mean": F.avg, "skewness": F.skewness, "kurtosis": F.kurtosis, "min": F.min, "max": F.max}
        return F.struct(
            F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col(c).isNull()).alias("n_missing"),
            *[(fn(number) if c in numeric else none).alias(name) for name, fn in stats.items()])

    basics = df.agg(F.array(*[entry(c) for c in cols]).alias("p")).select(F.inline("p"))
    # distinct counts from a long form: one pass, merged before the shuffle
    long = df.unpivot([], [F.col(c).cast("string").alias(c) for c in cols], "column", "_v")
    distinct = (long.where(F.col("_v").isNotNull()).groupBy("column").agg(F.count_distinct("_v").alias("n_distinct")))
    return (basics.join(distinct, "column", "left")
            .withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0))))


def correlations(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every pair of columns, over rows where both are known."""
    pairs = list(combinations(cols, 2))
    entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]
    return df.agg(F.array(*entries).alias("p")).select(F.inline("p"))


def crosstab(df: DataFrame, a: str, b: str, b_values) -> DataFrame:
    """Contingency table: one row per value of ``a``, one count column per given value of ``b``."""
    return df.groupBy(a).pivot(b, list(b_values)).agg(F.count(F.lit(1))).fillna(0)


def lump_top_n(df: DataFrame, col: str, n: int, other: str = "Other", out: str | None = None) -> DataFrame:
    """Keep the n most frequent levels, write ``other`` for the rest; NULL stays NULL."""
    top = top_n(df, col, n).select(col, F.lit(True).alias("_top"))
    lumped = df.join(top, col, "left")
    text = F.col(col).cast("string")
    kept = F.when(F.col(col).isNull(), text).when(F.col("_top"), text).otherwise(F.lit(other))
    return lumped.withColumn(out or col, kept).drop("_top")


def cluster_coverage(df: DataFrame, cluster: str, none_label: int = -1) -> DataFrame:
    """Number of clusters and the share of rows that belong to one."""
    member = F.col(cluster) != none_label
    return df.agg(F.count_distinct(F.when(member, F.col(cluster))).alias("n_clusters"),
                  F.avg(F.when(member, 1.0).otherwise(0.0)).alias("share_clustered"))


def max_by_field(df: DataFrame, by, column: str, value: str, mapping: DataFrame) -> DataFrame:
    """Largest value per original field, where several one-hot columns map to one field.

    The mapping has a row per column, so it goes to the tasks: a shuffle by column would put all rows into as many tasks.
    """
    return (df.join(F.broadcast(mapping.select(F.col("column").alias(column), "field")), column)
            .groupBy(*by, "field").agg(F.max(value).alias(value)))
