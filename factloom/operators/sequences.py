"""Per-entity order: numbering, intervals, runs, sliding windows and growth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.dates import DAYS_PER_MONTH
from .order import CHUNK_ROWS, HOT_ROWS, entity_windows, join_null_safe


def with_entity_sequence(df: DataFrame, by, order, out: str = "sequence", hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based row number per entity in a total order."""
    return entity_windows(df, by, order, seq=out, hot_rows=hot_rows)


def with_lag_lead(df: DataFrame, by, order, col: str, offset: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach ``<col>_lag`` and ``<col>_lead``."""
    return entity_windows(df, by, order, {
        f"{col}_lag": lambda w: F.lag(col, offset).over(w),
        f"{col}_lead": lambda w: F.lead(col, offset).over(w)}, before=offset, after=offset, hot_rows=hot_rows)


def tag_current_previous(df: DataFrame, entity, period: str, item: str,
                         suffixes=("_curr", "_prev")) -> DataFrame:
    """Keep the latest periods of an entity, one per suffix, and append the suffix to the item."""
    w = Window.partitionBy(*entity).orderBy(F.desc(period))
    periods = (df.where(F.col(period).isNotNull()).select(*entity, period).distinct()
               .withColumn("period_seq", F.row_number().over(w)).where(F.col("period_seq") <= len(suffixes)))
    names = F.array(*[F.lit(s) for s in suffixes])
    return (df.join(periods, [*entity, period], "inner")
            .withColumn(item, F.concat(F.col(item), F.get(names, F.col("period_seq") - 1))))


def with_interval_months(df: DataFrame, by, date: str, tie, out: str = "interval_months",
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """Whole months since the previous report; the first report (or a zero gap) takes the next gap.

    A report with neither gets 0.
    """
    def months(a, b):
        return F.round(F.datediff(b, a) / F.lit(DAYS_PER_MONTH)).cast("int")

    day = F.col(date)
    gaps = entity_windows(df, by, [date, *tie], {
        "_back": lambda w: F.coalesce(months(F.lag(day).over(w), day), F.lit(0)),
        "_ahead": lambda w: F.coalesce(months(day, F.lead(day).over(w)), F.lit(0))},
        before=1, after=1, hot_rows=hot_rows)
    return gaps.withColumn(out, F.when(F.col("_back") == 0, F.col("_ahead")).otherwise(F.col("_back"))).drop("_back", "_ahead")


def with_run_number(df: DataFrame, by, interval: str, order, out: str = "run", islands: bool = True,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based number within runs of reports that share an interval.

    With ``islands`` a run ends where the interval changes; without, all reports of an entity with
    the same interval are numbered through, whatever lies between.
    """
    if not islands:
        return entity_windows(df, [*by, interval], order, seq=out, hot_rows=hot_rows)
    both = entity_windows(entity_windows(df, by, order, seq="_all", hot_rows=hot_rows),
                          [*by, interval], order, seq="_same", hot_rows=hot_rows)
    marked = both.withColumn("_island", F.col("_all") - F.col("_same"))
    firsts = marked.groupBy(*by, interval, "_island").agg(F.min("_same").alias("_first"))
    return (join_null_safe(marked, firsts, [*by, interval, "_island"])
            .withColumn(out, F.col("_same") - F.col("_first") + 1)
            .drop("_all", "_same", "_island", "_first"))


def entities_with_min_sequence(df: DataFrame, by, interval: str, n: int, months: int | None = None,
                               run: str = "run") -> DataFrame:
    """(entity, interval, max_run) for entities whose longest run has at least ``n`` reports."""
    longest = df.groupBy(*by, interval).agg(F.max(run).alias("max_run")).where(F.col("max_run") >= n)
    return longest if months is None else longest.where(F.col(interval) == months)


def rows_with_min_sequence(df: DataFrame, by, interval: str, n: int, months: int | None = None) -> DataFrame:
    """All reports of qualifying (entity, interval) pairs, with the longest run attached."""
    keep = entities_with_min_sequence(df, by, interval, n, months)
    return df.join(keep, [*by, interval], "inner")


def sliding_sequences(df: DataFrame, by, order, cols, n: int, hot_rows: int = HOT_ROWS,
                      chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Every window of n consecutive rows of an entity, as rows.

    Result: the entity columns, ``sequence_grp`` (number of the window's first row), ``step``
    (1 to n) and ``cols``.
    """
    row = F.struct(*cols)
    lists = entity_windows(df, by, order, {
        "_window": lambda w: F.collect_list(row).over(w.rowsBetween(0, n - 1))},
        seq="sequence_grp", after=n - 1, hot_rows=hot_rows, chunk_rows=chunk_rows)
    return (lists.where(F.size("_window") == n)
            .select(*by, "sequence_grp", F.posexplode("_window").alias("_pos", "_row"))
            .select(*by, "sequence_grp", (F.col("_pos") + 1).alias("step"), "_row.*"))


def first_n(df: DataFrame, by, order, n: int, min_rows: int | None = None, out: str = "sequence") -> DataFrame:
    """The first n rows of each entity that has at least ``min_rows`` (default n) rows."""
    qualified = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= (min_rows or n)).select(*by)
    w = Window.partitionBy(*by).orderBy(*order)
    firsts = df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)
    return firsts.join(qualified, list(by), "left_semi")


def window_growth(windows: DataFrame, by, col: str, step: str = "step", out: str = "growth") -> DataFrame:
    """(end - start) / start of each window, 0 when the start is 0, attached to all its rows.

    ``by`` identifies a window, which has a fixed number of rows.
    """
    w = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start, end = F.first(col).over(w), F.last(col).over(w)
    return (windows.withColumn(f"{col}_start", start)
            .withColumn(out, F.when(F.col(f"{col}_start") == 0, F.lit(0.0))
                        .otherwise((end - F.col(f"{col}_start")) / F.col(f"{col}_start"))))


def scale_to_byte(df: DataFrame, col: str, limit: float = 0.5, out: str | None = None) -> DataFrame:
    """Clip to [-limit, limit], shift to 0, log1p, and scale by the table's maximum to 0..255."""
    def squeeze(c):
        return F.log1p(F.least(F.greatest(F.col(c), F.lit(-limit)), F.lit(limit)) + F.lit(limit))
    top = df.agg(F.max(squeeze(col))).scalar()
    scaled = F.round(F.try_divide(F.col("_s"), F.col("_top")) * 255)
    return (df.withColumn("_s", squeeze(col)).withColumn("_top", top)
            .withColumn(out or f"{col}_255", scaled).drop("_s", "_top"))


def order_agreement(df: DataFrame, by, a, b, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Attach each row's place in two total orders per group and whether they agree."""
    both = entity_windows(entity_windows(df, by, a, seq="place_a", hot_rows=hot_rows), by, b, seq="place_b", hot_rows=hot_rows)
    return both.withColumn("agrees", F.col("place_a") == F.col("place_b"))


def to_sequences(df: DataFrame, by, order: str, cols, out: str = "steps") -> DataFrame:
    """One row per sample with an array of steps, each an array of features.

    A sample is one window of a fixed number of rows, see ``sliding_sequences`` and ``first_n``.
    """
    features = F.array(*[F.col(c).cast("double") for c in cols])
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), features.alias("_f"))))
    return df.groupBy(*by).agg(F.transform(ordered, lambda s: s["_f"]).alias(out))


def from_sequences(df: DataFrame, by, cols, steps: str = "steps") -> DataFrame:
    """Back to one row per step: the sample columns, ``step`` (1-based) and the features."""
    return (df.select(*by, F.posexplode(steps).alias("_p", "_f"))
            .select(*by, (F.col("_p") + 1).alias("step"), *[F.col("_f")[i].alias(c) for i, c in enumerate(cols)]))
