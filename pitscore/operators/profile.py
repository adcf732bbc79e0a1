"""Table profiling and class mix."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitscore.functions.columns import missing, share_pct
from pitscore.operators.asof import join_group_total, with_group_total
from pitscore.sources.io import share_package


def grouped_count(
    df: DataFrame, groups: Sequence[str], column: str, name: str = "qty"
) -> DataFrame:
    """Non-null count of ``column``; a group of NULLs stays with 0."""
    return df.groupBy(*groups).agg(F.count(column).alias(name))


def class_share(df: DataFrame, period: Sequence[str], target: str) -> DataFrame:
    """Share of each target class in its period, in percent. The total comes from a window over the
    already aggregated classes, so the data is shuffled once."""
    counts = grouped_count(df, [*period, target], target)
    return with_group_total(counts, period, "qty").withColumn("pct", share_pct("qty", "total"))


def class_share_by_join(df: DataFrame, period: Sequence[str], target: str) -> DataFrame:
    """Join form of ``class_share``; a NULL period finds no total."""
    totals = grouped_count(df, period, target, "total")
    return join_group_total(grouped_count(df, [*period, target], target), totals, period).withColumn(
        "pct", share_pct("qty", "total")
    )


def freshness(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.max(date).alias("max_date"))


def event_rate(
    df: DataFrame, target: str, groups: Sequence[str], name: str = "event_rate"
) -> DataFrame:
    """Mean target and row count per group, as drawn in the risk group charts."""
    return df.groupBy(*groups).agg(F.avg(target).alias(name), F.count(target).alias("n"))


def dataset_description(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Per column: type, missing count (NULL and NaN), missing percent, distinct non-missing values.

    Exact form: every row becomes one (column, value) row per column in a single scan, and those are counted.
    A value keeps its own type in a field of that type, so nothing is compared as text. Equal values combine
    map-side before the shuffle, and the key is (column, value). ``approximate=True`` keeps one sketch per
    column instead: a single pass without a shuffle of values, for tables whose columns are mostly unique.
    A table without columns has no rows, one without rows none either.
    """
    types = dict(df.dtypes)
    if approximate:
        return _sketch_description(df, types)
    if not types:
        empty = "column string, type string, n_missing bigint, pct_missing double, n_distinct bigint"
        return df.sparkSession.createDataFrame([], empty)
    kinds = {t: f"v{k}" for k, t in enumerate(dict.fromkeys(types.values()))}
    values = []
    for k, (c, t) in enumerate(types.items()):
        gone = missing(f"`{c}`", t)
        present = F.when(~gone, F.col(f"`{c}`"))
        own = [(present if kind == t else F.lit(None).cast(kind)).alias(v) for kind, v in kinds.items()]
        values.append(F.struct(F.lit(k).alias("no"), gone.alias("gone"), *own))
    per_value = df.select(F.inline(F.array(*values))).groupBy("no", "gone", *kinds.values()).agg(F.count(F.lit(1)).alias("n"))
    per_column = per_value.groupBy("no").agg(
        F.coalesce(F.sum(F.when(F.col("gone"), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.sum("n").alias("_rows"),
        F.count_if(~F.col("gone")).alias("n_distinct"),
    )
    names = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type")) for c, t in types.items()])
    return per_column.select(
        names[F.col("no")]["column"].alias("column"),
        names[F.col("no")]["type"].alias("type"),
        "n_missing",
        (F.try_divide(F.col("n_missing"), F.col("_rows")) * 100).alias("pct_missing"),
        "n_distinct",
    )


def _sketch_description(df: DataFrame, types: dict[str, str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, (c, t) in enumerate(types.items()):
        gone = missing(F.col(f"`{c}`"), t)
        aggs.append(F.count_if(gone).alias(f"_m{i}"))
        aggs.append(F.approx_count_distinct(F.when(~gone, F.col(f"`{c}`"))).alias(f"_d{i}"))
    lines = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.lit(t).alias("type"),
                F.col(f"_m{i}").alias("n_missing"),
                (F.try_divide(F.col(f"_m{i}"), F.col("_rows")) * 100).alias("pct_missing"),
                F.col(f"_d{i}").alias("n_distinct"),
            )
            for i, (c, t) in enumerate(types.items())
        ]
    )
    return df.agg(*aggs).select(F.inline(lines))


ROUNDING_SHIFT = 0.0123456789


#: Groups that a task holds before it sends their totals on.
_HELD_GROUPS = 4096


def _group_numbers(batch: pa.RecordBatch, n_keys: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Keys of the groups in a batch, the rows in order of their groups, and where each group begins there."""
    code = np.zeros(batch.num_rows, np.int64)
    for key in batch.columns[:n_keys]:
        coded = key.dictionary_encode(null_encoding="encode")
        code = np.unique(code * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    some = batch.take(pa.array(order[starts]))
    return list(zip(*(some.column(k).to_pylist() for k in range(n_keys)), strict=True)) if n_keys else [()], order, starts


def _group_totals(n_keys: int, n_features: int):
    """Function over batches of keys and an array of features that gives rows of keys, number of the feature,
    how many values there are, and their sum: a row for each feature and group of a task."""

    def lines(held: dict[tuple, list[np.ndarray]], fields: Sequence[pa.Field]) -> Iterator[pa.RecordBatch]:
        groups, names = list(held), [*(f.name for f in fields), "_no", "_n", "_total"]
        for start in range(0, len(groups), 64):
            part = groups[start : start + 64]
            keys = [pa.array([g[k] for g in part], f.type) for k, f in enumerate(fields)]
            row = pa.array(np.repeat(np.arange(len(part)), n_features))
            counts, sums = (np.concatenate([held[g][i] for g in part]) for i in (0, 1))
            number = np.tile(np.arange(n_features, dtype=np.int32), len(part))
            arrays = [*(key.take(row) for key in keys), pa.array(number), pa.array(counts), pa.array(sums, mask=counts == 0)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        fields: list[pa.Field] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = list(batch.schema)[:n_keys]
            groups, order, starts = _group_numbers(batch, n_keys)
            values = batch.column(n_keys).flatten()
            there = pc.is_valid(values).to_numpy(zero_copy_only=False).reshape(-1, n_features)[order]
            x = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False).reshape(-1, n_features)[order]
            counts = np.add.reduceat(there, starts, axis=0, dtype=np.int64)
            sums = np.add.reduceat(x, starts, axis=0)
            for group, *found in zip(groups, counts, sums, strict=True):
                known = held.setdefault(group, [0, 0.0])
                known[:] = [a + b for a, b in zip(known, found, strict=True)]
            if len(held) > _HELD_GROUPS:
                yield from lines(held, fields)
                held.clear()
        yield from lines(held, fields)

    return run


def feature_totals(df: DataFrame, features: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """``groups, feature, n, total``: how many values each feature has, and their sum, in one pass.

    Two aggregates for each of hundreds of features are too much for one aggregation buffer, so tasks total
    their Arrow batches and Spark adds up a short row per task, group and feature. A batch has the features as
    one array, as a column of its own for each costs Spark more than the sums. Sums are shifted by a fixed odd
    fraction before rounding, so that a sum that ends in an exact half is not rounded by its last bit.
    """
    spark, features = df.sparkSession, list(features)
    share_package(spark)
    keys = [f"_g{i}" for i in range(len(groups))]
    values = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], values.alias("_values"))
    schema = StructType([*rows.select(*keys).schema]).add("_no", "integer").add("_n", "long").add("_total", "double")
    parts = rows.mapInArrow(_group_totals(len(keys), len(features)), schema)
    if not keys:  # without groups there is a line for each feature of no rows, too
        nothing = spark.range(len(features)).selectExpr("CAST(id AS INT) AS _no", "0L AS _n", "CAST(NULL AS DOUBLE) AS _total")
        parts = parts.unionByName(nothing)
    sums = parts.groupBy(*keys, "_no").agg(F.sum("_n").alias("n"), (F.sum("_total") + ROUNDING_SHIFT).alias("_sum"))
    name = F.array(*[F.lit(f) for f in features])[F.col("_no")]
    total = F.when(name.startswith("pct_"), F.round("_sum", 3)).otherwise(F.round("_sum", 1))
    named = [F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)]
    return sums.select(*named, name.alias("feature"), "n", total.alias("total"))
