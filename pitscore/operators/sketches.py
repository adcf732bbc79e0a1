"""Mergeable sketches of a table's columns, kept per part (a year, say) and united when read.

Adding a part reads that part only: its counts, distinct-count sketches and quantile sketches become rows of
a stored table, and a description or the edges of prebins come from uniting rows. Sketches have a bounded
size, so the stored table grows with columns and parts, not with rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore.functions.columns import missing

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
_CHUNK = 64
SCHEMA = "column string, type string, n_rows bigint, n_missing bigint, distinct binary, quantiles binary"


def column_sketches(df: DataFrame, columns: Sequence[str], part: str) -> DataFrame:
    """One row per part and column: ``column, type, n_rows, n_missing, distinct, quantiles``.

    NaN counts as missing. ``distinct`` is an HLL sketch of the values as text, ``quantiles`` a KLL sketch of
    numbers (empty for other types). Columns are read in chunks, each in one scan, and a (part, column) is
    combined map-side, so only sketches are shuffled.
    """
    types = dict(df.dtypes)

    def line(c):
        gone, t = missing(F.col(f"`{c}`"), types[c]), types[c]
        number = F.col(f"`{c}`").cast("double") if t in _NUMBERS or t.startswith("decimal") else F.lit(None).cast("double")
        return F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("type"), gone.alias("_gone"),
            F.when(~gone, F.col(f"`{c}`").cast("string")).alias("_text"), F.when(~gone, number).alias("_number"),
        )

    frames = []
    for i in range(0, len(columns), _CHUNK):
        lines = df.select(F.col(part).alias(part), F.inline(F.array(*[line(c) for c in columns[i : i + _CHUNK]])))
        frames.append(
            lines.groupBy(part, "column", "type").agg(
                F.count(F.lit(1)).alias("n_rows"), F.count_if("_gone").alias("n_missing"),
                F.hll_sketch_agg("_text").alias("distinct"), F.kll_sketch_agg_double("_number").alias("quantiles"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


def store_sketches(df: DataFrame, columns: Sequence[str], part: str, path: str) -> None:
    """Adds the sketches of the parts that ``df`` holds, whole, to the table at ``path``; a part that is there
    already is replaced, others stay as they are."""
    rows = column_sketches(df, columns, part)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def united(sketches: DataFrame) -> DataFrame:
    """One row per column, over all parts given: ``column, type, n_rows, n_missing, n_distinct`` (estimated,
    standard error below two percent) and the united quantile sketch."""
    return sketches.groupBy("column", "type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def description(sketches: DataFrame) -> DataFrame:
    """``column, type, n_missing, pct_missing, n_distinct``, as ``dataset_description`` has them, without a scan
    of the data."""
    percent = F.try_divide(F.col("n_missing"), F.col("n_rows")) * 100
    return united(sketches).select("column", "type", "n_missing", percent.alias("pct_missing"), "n_distinct")


def edges(sketches: DataFrame, features: Sequence[str], max_prebins: int = 10) -> dict[str, list[float]]:
    """Prebin edges of the features for ``binning.iv_table(..., edges=...)``: at most ``max_prebins - 1``
    numbers a feature reach the driver. A feature without values has none."""
    wanted = F.array(*[F.lit(k / max_prebins) for k in range(1, max_prebins)])
    rows = united(sketches.filter(F.col("column").isin(list(features)))).filter(F.kll_sketch_get_n_double("quantiles") > 0)
    found = rows.select("column", F.kll_sketch_get_quantile_double("quantiles", wanted).alias("edges")).collect()
    out: dict[str, list[float]] = {f: [] for f in features}
    return out | {r["column"]: sorted(set(r["edges"])) for r in found}
