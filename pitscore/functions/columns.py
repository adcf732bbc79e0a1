"""Column expressions shared by the operators. All stay inside JVM codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_key(year: str | Column, month: str | Column) -> Column:
    """``year * 100 + month``: an integer that sorts like the calendar."""
    return col(year) * 100 + col(month)


def period_of(date: str | Column, days_back: int = 0) -> Column:
    """Period key of a date, optionally moved back a number of days first."""
    d = col(date)
    if days_back:
        d = F.date_sub(d, days_back)
    return period_key(F.year(d), F.month(d))


def relative_change(value: str | Column, base: str | Column) -> Column:
    """``(value - base) / |base|``; NULL for a zero or missing base (ANSI-safe)."""
    return F.try_divide(col(value) - col(base), F.abs(col(base)))


def sign_flag(value: str | Column) -> Column:
    """1 for a value >= 0, 0 below, NULL for NULL."""
    v = col(value)
    return F.when(v >= 0, 1).when(v < 0, 0)


def share_pct(part: str | Column, total: str | Column, digits: int = 2) -> Column:
    """Rounded percentage; NULL when the total is 0."""
    return F.round(F.try_divide(col(part), col(total)) * 100, digits)


def missing(value: str | Column, data_type: str) -> Column:
    """True for NULL, and for NaN in floating columns."""
    v = col(value)
    return (v.isNull() | F.isnan(v)) if data_type in ("double", "float") else v.isNull()


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def in_months(date_month: str | Column, months: Iterable[int]) -> Column:
    return col(date_month).isin(list(months))


def hash_permille(keys: Iterable[str | Column], seed: int) -> Column:
    """0..999 from the md5 of the key values and a seed: the same row always gets the same number,
    whatever the partitioning, the run or the engine."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(1000)).cast("int")
