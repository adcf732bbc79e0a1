"""Train / test / out-of-time assignment as a column; ids stay in the same row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.functions.columns import col, hash_permille, in_months

# The calendar months of the out-of-time design; month 10 is in neither list.
TRAIN_MONTHS = [2, 4, 6, 8, 12]
OUT_MONTHS = [1, 3, 5, 7, 9, 11]


def month_split(
    month: str | Column,
    train: Sequence[int] = TRAIN_MONTHS,
    out: Sequence[int] = OUT_MONTHS,
) -> Column:
    """``train``, ``out`` or ``unused`` by calendar month."""
    return (
        F.when(in_months(month, train), "train").when(in_months(month, out), "out").otherwise("unused")
    )


def hash_split(keys: Sequence[str | Column], test_share: float = 0.3, seed: int = 7) -> Column:
    """``train`` or ``test`` by a stable hash of the row's keys."""
    train_permille = 1000 - round(test_share * 1000)
    return F.when(hash_permille(keys, seed) < train_permille, "train").otherwise("test")


def assign_splits(
    df: DataFrame,
    month: str | Column,
    keys: Sequence[str],
    test_share: float = 0.3,
    seed: int = 7,
    train: Sequence[int] = TRAIN_MONTHS,
    out: Sequence[int] = OUT_MONTHS,
) -> DataFrame:
    """Out-of-time split by month, then the training months cut into train and test."""
    by_month = month_split(col(month), train, out)
    return df.withColumn(
        "split", F.when(by_month == "train", hash_split(keys, test_share, seed)).otherwise(by_month)
    )
