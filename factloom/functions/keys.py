"""Composite keys, key parsing and hash-based uniforms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def make_key(cols, sep: str = "_", missing: str = "nan") -> Column:
    """Join columns as text; a NULL part is written as ``missing`` so that the key is never NULL."""
    parts = []
    for c in cols:
        if parts:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_col(c).cast("string"), F.lit(missing)))
    return F.concat(*parts)


def parse_report_ref(ref, pattern: str = r"^(\d+)(?:\.0)?_.*?(\d{8})") -> dict[str, Column]:
    """Entity and date of a composite report key, as ``{"entity", "report_date"}``."""
    ref = _col(ref)
    entity = F.regexp_extract(ref, pattern, 1)
    day = F.regexp_extract(ref, pattern, 2)
    return {
        "entity": F.when(entity != "", entity),
        "report_date": F.to_date(F.try_to_timestamp(F.when(day != "", day), F.lit("yyyyMMdd"))),
    }


def account_digits(account, n: int = 7, prefix: str = "account_digit") -> dict[str, Column]:
    """The first ``n - 1`` characters by position, and the last character as the n-th."""
    account = _col(account).cast("string")
    cols = {f"{prefix}{i}": F.substring(account, i, 1) for i in range(1, n)}
    cols[f"{prefix}{n}"] = F.right(account, F.lit(1))
    return cols


def split_prefix(col, sep: str = ":") -> tuple[Column, Column]:
    """(prefix, rest) around the first separator; without one the prefix is NULL and the rest is the text."""
    col = _col(col)
    at = F.instr(col, sep)
    prefix = F.when(at > 0, F.substring_index(col, sep, 1))
    rest = F.when(at > 0, F.substr(col, at + F.lit(len(sep)))).otherwise(col)
    return prefix, rest


def _digest(key, seed: int) -> Column:
    return F.md5(F.concat(_col(key).cast("string"), F.lit(f":{seed}")))


def uniform(key, seed: int = 0) -> Column:
    """A repeatable number in [0, 1) from a key: the same row gets the same number in any plan."""
    return F.conv(F.substring(_digest(key, seed), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash60(key, seed: int = 0) -> Column:
    """A repeatable 60-bit integer from a key, used to put rows in random order."""
    return F.conv(F.substring(_digest(key, seed), 1, 15), 16, 10).cast("bigint")
