"""Running class counts over sorted scores: the one frame behind KS, AUC, precision curves and binning.

A window over all scores of a group would run in one task. The frame is built in two levels instead:

1. ``score_counts``: rows collapse to one row per distinct (group, score), combined map-side, so a score
   shared by a third of the rows costs nothing.
2. Distinct scores are cut into ranges at values drawn from each group's own scores. Each range's running count starts
   from the total of the ranges below it (a table of at most groups x ranges rows).

The cut points are the scores with the smallest hashes: an even sample of the distinct scores that is a
function of the data alone, so a re-executed task or a second reading of the plan sees the same cuts.
They only decide where the work is split. The counts are exact whatever they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DRAWS_PER_RANGE = 4


def default_ranges(spark: SparkSession) -> int:
    """A power of two, at least four ranges per shuffle partition, sixteen at least."""
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(16, 1 << (wanted - 1).bit_length())


def class_counts(df: DataFrame, score: str, target: str, groups: Sequence[str] = ()) -> DataFrame:
    """``groups, score, n1, n0``: events and non-events per distinct score, for targets 0 and 1 only."""
    return df.groupBy(*groups, F.col(score).alias("score")).agg(
        F.count_if(F.col(target) == 1).alias("n1"), F.count_if(F.col(target) == 0).alias("n0")
    )


def score_counts(df: DataFrame, score: str, target: str, groups: Sequence[str] = ()) -> DataFrame:
    """``class_counts`` with NULL and other targets left out."""
    return class_counts(df.filter(F.col(target).isin(0, 1)), score, target, groups)


def _cut_points(counts: DataFrame, keys: Sequence[str], ranges: int) -> DataFrame:
    """The cuts of each group: every fourth of its drawn scores, in order. Scores are drawn over all groups
    by hash, so a group has as many cuts as its share of the distinct scores; a group without any is small.
    All groups together have at most ``ranges * 4`` draws, which bounds what is broadcast."""
    drawn = (
        counts.filter(F.col("n1") + F.col("n0") > 0)
        .select(*keys, "score", F.xxhash64(*keys, "score").alias("h"))
        .orderBy("h", "score")
        .limit(ranges * _DRAWS_PER_RANGE)
    )
    values = F.array_sort(F.collect_set("score"))
    cuts = F.filter(values, lambda x, i: i % _DRAWS_PER_RANGE == 0)
    return drawn.groupBy(*keys).agg(cuts.alias("_cuts")) if keys else drawn.agg(cuts.alias("_cuts"))


def _with_range(df: DataFrame, ranges: int) -> DataFrame:
    """``_range``: how many cuts lie below the score, by bisection in generated code."""
    df = df.withColumn("_range", F.lit(0))
    step = ranges // 2
    while step:
        # past the end of the cuts the comparison is NULL, which counts as not beyond
        beyond = F.col("score") > F.get("_cuts", F.col("_range") + (step - 1))
        df = df.withColumn("_range", F.col("_range") + F.when(beyond, step).otherwise(0))
        step //= 2
    return df


def running_counts(
    counts: DataFrame,
    groups: Sequence[str] = (),
    ranges: int | None = None,
    keep_missing: bool = False,
) -> DataFrame:
    """Add ``c1, c0`` (counts at or below the score) and ``t1, t0`` (group totals).

    NULL scores are dropped, or sorted first with ``keep_missing``.
    """
    groups = list(groups)
    ranges = ranges or default_ranges(counts.sparkSession)
    if not keep_missing:
        counts = counts.filter(F.col("score").isNotNull())
    # text keys without NULLs, so that a NULL group joins like any other
    keys = [f"_k{i}" for i in range(2 * len(groups))]
    named = [F.coalesce(F.col(g).cast("string"), F.lit("")) for g in groups]
    named += [F.col(g).isNull() for g in groups]
    keyed = counts.select("*", *[k.alias(n) for k, n in zip(named, keys, strict=True)])
    cuts = _cut_points(keyed, keys, ranges)
    if groups:
        keyed = keyed.join(F.broadcast(cuts), keys, "left")
    else:
        keyed = keyed.withColumn("_cuts", cuts.scalar())
    ranged = _with_range(keyed, ranges * _DRAWS_PER_RANGE).select(*counts.columns, "_range", *keys)
    # one row per group and range: bounded, so these windows stay small
    below = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = (
        ranged.groupBy(*keys, "_range")
        .agg(F.sum("n1").alias("_s1"), F.sum("n0").alias("_s0"))
        .select(
            *keys,
            "_range",
            F.coalesce(F.sum("_s1").over(below), F.lit(0)).alias("_b1"),
            F.coalesce(F.sum("_s0").over(below), F.lit(0)).alias("_b0"),
            F.sum("_s1").over(whole).alias("t1"),
            F.sum("_s0").over(whole).alias("t0"),
        )
    )
    inside = (
        Window.partitionBy(*keys, "_range")
        .orderBy("score")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.withColumn("_c1", F.sum("n1").over(inside)).withColumn("_c0", F.sum("n0").over(inside))
    # the join keys are the window's partition keys: the running counts are not shuffled again
    return local.join(offsets, [*keys, "_range"]).select(
        *groups,
        "score",
        "n1",
        "n0",
        (F.col("_c1") + F.col("_b1")).alias("c1"),
        (F.col("_c0") + F.col("_b0")).alias("c0"),
        "t1",
        "t0",
    )


def ranked(
    df: DataFrame, score: str, target: str, groups: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    return running_counts(score_counts(df, score, target, groups), groups, ranges)
