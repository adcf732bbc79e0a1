"""Joins of a panel to the latest record known at a period.

No operator here pairs every row with every eligible record. Records and rows are stacked and one
running window carries the latest record forward, so the work is linear in both inputs.

Group sizes are bounded by the calendar, not by the data:

* ``asof_join`` windows per ``series``; a series with one row per date holds at most one row per day.
* ``asof_join_by_period`` windows over the distinct periods of a key, then joins back on
  (key, period). Use it when a key may hold any number of rows; the equi join splits under AQE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitscore.operators.rows import keep_one


def _carry_latest(
    rows: DataFrame,
    records: DataFrame,
    part: Sequence[str],
    period: str,
    record_period: str,
    record_order: Sequence[str],
    payload: Sequence[str],
    packed: str | None = None,
) -> DataFrame:
    """Rows plus the payload of the last record with ``record_period <= period`` in the same part.

    Records come from :func:`_packed` and take the rows' own period column, so the result stays sorted by it
    within each part. ``packed`` names a column that keeps the payload as one struct.
    """
    order_names = [f"_o{i}" for i in range(len(record_order))]
    left = rows.withColumn("_side", F.lit(1))
    right = records.select(
        *part,
        F.col(record_period).alias(period),
        F.lit(0).alias("_side"),
        *[F.col(c).alias(n) for c, n in zip(record_order, order_names, strict=True)],
        "_rec",
    )
    w = (
        Window.partitionBy(*part)
        .orderBy(period, "_side", *order_names)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        left.unionByName(right, allowMissingColumns=True)
        .withColumn("_rec", F.last("_rec", ignorenulls=True).over(w))
        .filter(F.col("_side") == 1)
    )
    if packed is not None:
        return found.select(*rows.columns, F.col("_rec").alias(packed))
    return found.select(*rows.columns, *[F.col("_rec")[c].alias(c) for c in payload])


def _packed(
    records: DataFrame, keys: Sequence[str], record_period: str, record_order: Sequence[str], payload: Sequence[str]
) -> DataFrame:
    """Records with their payload as the struct ``_rec``, so that copying, sorting and carrying one moves a
    single value instead of a column for each of its fields."""
    return records.select(*dict.fromkeys([*keys, record_period, *record_order]), F.struct(*payload).alias("_rec"))


def _clean_records(records, keys, record_period):
    cond = F.col(record_period).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return records.filter(cond)


def _without_key(rows, records, keys, payload):
    """Rows whose key is whole, and those where a part of it is NULL, with NULL for the payload."""
    gone = F.lit(False)
    for k in keys:
        gone = gone | F.col(k).isNull()
    nothing = [F.lit(None).cast(records.schema[c].dataType).alias(c) for c in payload]
    return rows.filter(~gone), rows.filter(gone).select(*rows.columns, *nothing)


def asof_join(
    rows: DataFrame,
    records: DataFrame,
    by: Sequence[str],
    series: Sequence[str],
    period: str,
    record_period: str,
    record_order: Sequence[str],
    payload: Sequence[str],
    series_from: DataFrame | None = None,
    keyed: bool = False,
    within_range: bool = False,
    packed: str | None = None,
) -> DataFrame:
    """Left as-of join: each row gets the latest record of its key with ``record_period <= period``.

    ``series`` contains ``by`` and is how the panel is partitioned for later lags, so the join and
    the lags share one shuffle of the rows; with the lags' date as ``period`` they share the sort too.
    Each key's records are copied to its series; the copies number series times records per key. The list
    of series is read from ``series_from``: any frame holding every series of ``rows``, such as the raw
    scan, so that preparing the rows is not planned twice.

    Rows without a key match nothing and are passed by the window, so that many of them do not land in one
    task. ``keyed`` says that there are none: then the rows are read once, and later lags find them shuffled.

    ``within_range`` copies a record to a series only if it is the latest at some point between the series'
    first and last ``period`` (which ``series_from`` must then hold): for keys with many short series the
    copies follow their lengths, not series times records. It costs a sort of the records by key.

    ``packed`` (with ``keyed`` only) names a struct to keep the payload in: fields of a wide one are better taken
    out after the windows that follow, as every operator in between handles each column of a row.
    """
    if packed is not None and not keyed:
        raise ValueError("packed asks for keyed rows")
    if not keyed:
        whole, lost = _without_key(rows, records, by, payload)
        found = asof_join(
            whole, records, by, series, period, record_period, record_order, payload, series_from, True, within_range
        )
        return found.unionByName(lost)
    extra = [c for c in series if c not in by]
    records = _packed(_clean_records(records, by, record_period), by, record_period, record_order, payload)
    if extra:
        source = rows if series_from is None else series_from
        if within_range:
            records = copies_within_range(source, records, by, series, period, record_period, record_order)
        else:
            records = source.select(*series).distinct().join(records, on=list(by))
    return _carry_latest(rows, records, series, period, record_period, record_order, payload, packed)


def copies_within_range(
    rows: DataFrame, records: DataFrame, by: Sequence[str], series: Sequence[str], period: str, record_period: str,
    record_order: Sequence[str],
) -> DataFrame:
    """The records copied to those series of their key during whose range of ``period`` they are the latest.

    A record is the latest from its own period until that of the next one. Of a series' records that is one
    from before its first row, and those that appear between its first and last row.
    """
    later = Window.partitionBy(*by).orderBy(record_period, *record_order)
    timed = records.withColumn("_until", F.lead(record_period).over(later))
    own, until = F.col(record_period), F.col("_until")
    timed = timed.filter(until.isNull() | (until > own))
    ranges = rows.groupBy(*series).agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    met = (own <= F.col("_last")) & (until.isNull() | (until > F.col("_first")))
    return ranges.join(timed, on=list(by)).filter(met).drop("_first", "_last", "_until")


def asof_join_by_period(
    rows: DataFrame,
    records: DataFrame,
    by: Sequence[str],
    period: str,
    record_period: str,
    record_order: Sequence[str],
    payload: Sequence[str],
    keys_from: DataFrame | None = None,
    keyed: bool = False,
) -> DataFrame:
    """Same result as ``asof_join`` for keys with any number of rows.

    The record is resolved once per distinct (key, period), then joined back on both. Keys and periods
    are read from ``keys_from`` when given: a frame holding all of them, cheaper than ``rows``. Rows without
    a key, and ``keyed``, as there.
    """
    if not keyed:
        whole, lost = _without_key(rows, records, by, payload)
        found = asof_join_by_period(
            whole, records, by, period, record_period, record_order, payload, keys_from, keyed=True
        )
        return found.unionByName(lost)
    keys = (rows if keys_from is None else keys_from).select(*by, period).distinct()
    resolved = _carry_latest(
        keys,
        _packed(_clean_records(records, by, record_period), by, record_period, record_order, payload),
        by,
        period,
        record_period,
        record_order,
        payload,
    )
    return rows.join(resolved, on=[*by, period], how="left").select(*rows.columns, *payload)


def shifted_period_join(
    records: DataFrame,
    by: Sequence[str],
    date: str,
    year: str,
    month: str,
    days: int = 180,
    lag_name: str = "dt_refer_lag",
) -> DataFrame:
    """Match each record's date moved back ``days`` with a record of that key, year and month.

    Left equi join, then one row per (key, matched date): the latest shifted date survives. Records
    without a match keep their key and shifted date; one row per key stands for them.
    """
    shifted = records.select(*by, F.date_sub(date, days).alias(lag_name)).select(
        *by, lag_name, F.year(lag_name).alias("_y"), F.month(lag_name).alias("_m")
    )
    matches = records.withColumn("_y", F.col(year)).withColumn("_m", F.col(month))
    joined = shifted.join(matches, on=[*by, "_y", "_m"], how="left").drop("_y", "_m")
    return keep_one(joined, [*by, date], [F.col(lag_name).desc()])


def component_theta_join(
    rows: DataFrame,
    records: DataFrame,
    by: Sequence[str],
    year: str,
    month: str,
    record_year: str,
    record_month: str,
    record_order: Sequence[str],
    payload: Sequence[str],
    keys_from: DataFrame | None = None,
) -> DataFrame:
    """Left join on key with ``year >= record_year`` and ``month >= record_month``, one row kept.

    This is not a calendar order: December is never visible in a later January. Among the eligible
    records the one with the latest (year, month), then ``record_order``, survives.

    A record of month m is visible in months m..12, so it is copied to those (at most 12) months;
    within one key and month a running maximum by year then finds the survivor.
    """
    order_names = [f"_o{i}" for i in range(len(record_order))]
    part = [*by, "_m"]
    keys = (
        (rows if keys_from is None else keys_from)
        .select(*by, F.col(year).alias("_y"), F.col(month).alias("_m"))
        .distinct()
        .withColumn("_side", F.lit(1))
    )
    copies = _clean_records(records, [*by, record_month], record_year).select(
        *by,
        F.explode(F.sequence(F.col(record_month), F.lit(12))).alias("_m"),
        F.col(record_year).alias("_y"),
        F.lit(0).alias("_side"),
        F.struct(
            (F.col(record_year) * 100 + F.col(record_month)).alias("_p"),
            *[F.col(c).alias(n) for c, n in zip(record_order, order_names, strict=True)],
            *[F.col(c).alias(f"_v{i}") for i, c in enumerate(payload)],
        ).alias("_rec"),
    )
    w = (
        Window.partitionBy(*part)
        .orderBy("_y", "_side")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    resolved = (
        keys.unionByName(copies, allowMissingColumns=True)
        .withColumn("_rec", F.max("_rec").over(w))
        .filter(F.col("_side") == 1)
        .select(
            *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)],
            "_y",
            "_m",
            *[F.col("_rec")[f"_v{i}"].alias(c) for i, c in enumerate(payload)],
        )
    )
    cond = (F.col(year) == F.col("_y")) & (F.col(month) == F.col("_m"))
    for i, k in enumerate(by):
        cond = cond & (F.col(k) == F.col(f"_k{i}"))
    return rows.join(resolved, cond, "left").select(*rows.columns, *payload)


def with_group_total(
    df: DataFrame, group: Sequence[str], value: str, name: str = "total"
) -> DataFrame:
    """Attach the group's sum of ``value`` to each row with a window: one shuffle, no join."""
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(*group)))


def join_group_total(detail: DataFrame, totals: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left equi join of detail rows with a table of group totals; a NULL group finds no total."""
    return detail.join(totals, on=list(group), how="left")
