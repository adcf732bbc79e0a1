"""Row and column operators: projection, null fill, one row per key, ordering, append."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitscore.functions.columns import col

_UNSORTABLE = ("map", "variant")


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def features_except(df: DataFrame, excluded: Iterable[str]) -> list[str]:
    """Feature names chosen by exclusion, in table order."""
    drop = set(excluded)
    return [c for c in df.columns if c not in drop]


def select_features(df: DataFrame, excluded: Iterable[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *features_except(df, [*excluded, *keep]))


def fill_numeric(df: DataFrame, value: float = 0) -> DataFrame:
    """Replace NULL and NaN in numeric columns; strings and dates stay as they are."""
    return df.na.fill(value)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """Keep one row per key: the first in ``order``, then by every remaining column.

    The remaining columns make the order total up to identical rows, so the survivor never depends on
    partitioning. ``row_number() = 1`` is planned with a group limit below the shuffle: each map task
    forwards one row per key, so a key with a huge number of copies does not travel.
    """
    rest = [c for c, t in df.dtypes if c not in keys and not t.startswith(_UNSORTABLE)]
    w = Window.partitionBy(*keys).orderBy(*[col(c) for c in order], *rest)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def rank_by(df: DataFrame, score: str, tiebreak: str, ascending: bool = False) -> DataFrame:
    """Global order by a score with a name tiebreak."""
    first = F.col(score).asc_nulls_last() if ascending else F.col(score).desc_nulls_last()
    return df.orderBy(first, F.col(tiebreak))


def top_n(df: DataFrame, score: str, tiebreak: str, n: int) -> DataFrame:
    """First ``n`` rows by score: planned as a per-task top-n, never a full sort."""
    return rank_by(df, score, tiebreak).limit(n)


def append_splits(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Append named frames by column name; the name goes into a ``split`` column."""
    out = None
    for name, frame in frames.items():
        tagged = frame.withColumn("split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no frames to append")
    return out
