"""Dates written as text or integers, month arithmetic and date parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .keys import _col

DAYS_PER_MONTH = 30.436875  # mean Gregorian month


def parse_yyyymmdd(col) -> Column:
    """Integer or text yyyymmdd to a date; anything invalid becomes NULL."""
    return F.to_date(F.try_to_timestamp(_col(col).cast("string"), F.lit("yyyyMMdd")))


def epoch_days(col) -> Column:
    return F.unix_date(F.to_date(_col(col)))


def from_epoch_days(col) -> Column:
    return F.date_from_unix_date(_col(col).cast("int"))


def epoch_months(col) -> Column:
    """Whole months since 1970-01-01."""
    return F.round(epoch_days(col) / F.lit(DAYS_PER_MONTH)).cast("int")


def duration_months(start, end) -> Column:
    """Whole months between two dates, by mean month length."""
    return F.round(F.datediff(_col(end), _col(start)) / F.lit(DAYS_PER_MONTH)).cast("int")


def yyyymmdd(col) -> Column:
    """Date to the integer yyyymmdd."""
    d = _col(col)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def year_month(col) -> Column:
    """Date to the integer yyyymm."""
    d = _col(col)
    return F.year(d) * 100 + F.month(d)


def date_parts(col, prefix: str) -> dict[str, Column]:
    """Month, day of month and day of week (Sunday = 1)."""
    d = _col(col)
    return {f"{prefix}_mth": F.month(d), f"{prefix}_dom": F.dayofmonth(d), f"{prefix}_dow": F.dayofweek(d)}


def period_bounds(col) -> tuple[Column, Column]:
    """(open, close) as yyyymmdd text from period text.

    The text holds either one date (an instant) or a start date followed by an end date; separators
    are removed first. An instant has an empty open part.
    """
    digits = F.regexp_replace(_col(col), r"[\s-]", "")
    ranged = F.length(digits) > 8
    period_open = F.when(ranged, F.substring(digits, 1, 8)).otherwise(F.lit(""))
    period_close = F.when(ranged, F.substring(digits, 9, 8)).otherwise(F.substring(digits, 1, 8))
    return period_open, period_close
