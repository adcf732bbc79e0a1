"""Features of a statement panel: one row per (key, reference date)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitscore.functions import vocabulary as V
from pitscore.functions.columns import relative_change
from pitscore.operators.rolling import RollingFeatures


def statement_lags(
    df: DataFrame,
    by: Sequence[str],
    date: str,
    amounts: Sequence[str] = tuple(V.TRACKED_AMOUNTS),
    lags: Mapping[str, int] | None = None,
) -> DataFrame:
    """Amount of the statement exactly ``months`` earlier, and the change since then.

    ``amt_tot_<amount>_<lag>_lag`` and ``pct_tx_<amount>_<lag>``. A calendar-month match per key: the
    month number is the order, and a range frame of one point picks the row that many months back, so
    all lags share one window shuffle. Two statements in one month: the later one counts.
    """
    lags = dict(V.STATEMENT_LAGS) if lags is None else dict(lags)
    month_no = F.year(date) * 12 + F.month(date)
    w = Window.partitionBy(*by).orderBy("_mn")
    out = df.withColumn("_mn", month_no)
    found = {}
    for lag, months in lags.items():
        frame = w.rangeBetween(-months, -months)
        found[f"_st_{lag}"] = F.max(F.struct(F.col(date).alias("d"), *amounts)).over(frame)
    out = out.select("*", *[c.alias(n) for n, c in found.items()])
    features = []
    for a in amounts:
        for lag in lags:
            features.append(F.col(f"_st_{lag}")[a].alias(f"amt_tot_{a}_{lag}_lag"))
    for a in amounts:
        for lag in lags:
            features.append(relative_change(a, F.col(f"_st_{lag}")[a]).alias(f"pct_tx_{a}_{lag}"))
    return out.select(*df.columns, *features)


def statement_rolling(
    df: DataFrame,
    by: Sequence[str],
    date: str,
    amounts: Sequence[str] = tuple(V.TRACKED_AMOUNTS),
    windows: Sequence[int] = tuple(V.STATEMENT_WINDOWS),
    slope_windows: Sequence[int] = tuple(V.STATEMENT_SLOPE_WINDOWS),
) -> DataFrame:
    """Mean and deviation over the last 1-4 statements, slope over the last 3, 6 and 12."""
    p = RollingFeatures(df, by, [date])
    for a in amounts:
        p.stats(a, windows)
        p.slopes(a, slope_windows)
    wanted = [f"amt_{s}_{a}_{n}" for s in ("avg", "std") for a in amounts for n in windows]
    wanted += [f"amt_beta_{a}_{n}" for n in slope_windows for a in amounts]
    return p.build().select(*df.columns, *wanted)


def statement_features(df: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """All statement features of the model table, from the raw statement amounts."""
    return statement_rolling(statement_lags(df, by, date), by, date)
