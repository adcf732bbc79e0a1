"""Lags and percentage changes over ordered series.

Windows are per series. A panel holding one row per series and date keeps each window group within
the calendar, whatever the data volume; run ``keep_one`` on raw panels first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitscore.functions.columns import relative_change, sign_flag


def _names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def series_window(partition: str | Sequence[str], order: str | Sequence[str]):
    return Window.partitionBy(*_names(partition)).orderBy(*_names(order))


def lag_column(
    df: DataFrame,
    partition_var: str | Sequence[str],
    order_var: str | Sequence[str],
    variable: str,
    nlag: int,
    name: str,
) -> DataFrame:
    return df.withColumn(name, F.lag(variable, nlag).over(series_window(partition_var, order_var)))


def get_percentage_change(
    dataset: DataFrame,
    partition_var: str | Sequence[str],
    order_var: str | Sequence[str],
    variable: str,
    nlag: int,
    variable_name: str,
) -> DataFrame:
    """``(x - lag(x, n)) / |lag(x, n)|`` per series; NULL when the lag is 0 or missing."""
    lagged = F.lag(variable, nlag).over(series_window(partition_var, order_var))
    return dataset.withColumn(variable_name, relative_change(variable, lagged))


def percentage_changes(
    df: DataFrame,
    partition_var: str | Sequence[str],
    order_var: str | Sequence[str],
    lags: Mapping[str, tuple[str, int]],
) -> DataFrame:
    """Many changes at once, ``{name: (variable, nlag)}``: one window node, one projection."""
    w = series_window(partition_var, order_var)
    return df.select(
        "*", *[relative_change(v, F.lag(v, n).over(w)).alias(name) for name, (v, n) in lags.items()]
    )


def amplitude(high: str = "high_price", close: str = "close") -> Column:
    return F.col(high) - F.col(close)


def with_target(
    df: DataFrame,
    partition_var: str | Sequence[str],
    order_var: str | Sequence[str],
    price: str,
    shift: int = 1,
    var_name: str = "var_target",
    cat_name: str = "cat_target",
) -> DataFrame:
    """Change of the price ``shift`` rows back over the row before it, and its sign flag, for every row."""
    w = series_window(partition_var, order_var)
    newer, older = F.lag(price, shift).over(w), F.lag(price, shift + 1).over(w)
    return df.withColumn(var_name, relative_change(newer, older)).withColumn(cat_name, sign_flag(var_name))


def add_target(
    df: DataFrame,
    partition_var: str | Sequence[str],
    order_var: str | Sequence[str],
    price: str,
    shift: int = 1,
    var_name: str = "var_target",
    cat_name: str = "cat_target",
) -> DataFrame:
    """Change of the price ``shift`` rows back over the row before it, and its sign flag.

    With ``shift=1``: ``(p[t-1] - p[t-2]) / |p[t-2]|``. Rows without a flag are dropped, so the first
    two rows of a series vanish. ``shift=0`` is the same-day change, ``shift=-1`` the next day's.
    """
    flagged = with_target(df, partition_var, order_var, price, shift, var_name, cat_name)
    return flagged.filter(F.col(cat_name).isNotNull())
