"""Optimal binning, information value and risk groups.

A binning is found in three relational steps, the same for one score or for hundreds of features:

1. Prebins of about equal size from exact running counts: the prebin of a value is the share of rows
   below it, so no quantile table has to be joined back. Equal values never straddle a cut.
2. Every way of merging neighbouring prebins is a bit mask: bit j set means a cut after prebin j. With
   at most 10 prebins there are at most 512 masks per variable, whatever the row count.
3. Masks failing the constraints are dropped; the highest information value wins, ties to the smaller
   mask. If none is left the variable stays in one bin.

Intervals are right-closed. A bin without events or without non-events adds 0 to the information value.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitscore.functions.columns import col, missing
from pitscore.operators.ranking import class_counts, running_counts, score_counts
from pitscore.sources.io import materialize

TRENDS = (None, "auto", "auto_asc_desc", "ascending", "descending", "peak", "valley")
_UNPIVOT_CHUNK = 64


def woe(n1: Column, n0: Column, t1: Column, t0: Column) -> Column:
    """Log of the non-event share over the event share; NULL when either is 0."""
    share1, share0 = F.try_divide(n1, t1), F.try_divide(n0, t0)
    return F.when((n1 > 0) & (n0 > 0), F.ln(share0 / share1))


def iv_term(n1: Column, n0: Column, t1: Column, t0: Column) -> Column:
    gap = F.try_divide(n0, t0) - F.try_divide(n1, t1)
    return F.coalesce(gap * woe(n1, n0, t1, t0), F.lit(0.0))


#: 2 ** (prebins - 1) merges are tried per variable.
MOST_PREBINS = 12


def prebins(
    counts: DataFrame,
    groups: Sequence[str] = (),
    max_prebins: int = 10,
    ranges: int | None = None,
    keep_missing: bool = False,
) -> DataFrame:
    """``prebin`` (1..k per group), its value range ``lo, hi``, and ``n1, n0``."""
    run = running_counts(counts, groups, ranges, keep_missing)
    n_below = F.col("c1") + F.col("c0") - F.col("n1") - F.col("n0")
    n_all = F.col("t1") + F.col("t0")
    if max_prebins > MOST_PREBINS:
        raise ValueError(f"at most {MOST_PREBINS} prebins: each one more doubles the merges tried")
    slot = F.floor(F.try_divide(n_below * max_prebins, n_all))
    slots = (
        run.withColumn("_slot", slot)
        .groupBy(*groups, "_slot")
        .agg(
            F.min("score").alias("lo"),
            F.max("score").alias("hi"),
            F.sum("n1").alias("n1"),
            F.sum("n0").alias("n0"),
        )
    )
    w = Window.partitionBy(*groups).orderBy("_slot")
    return slots.withColumn("prebin", F.row_number().over(w)).drop("_slot")


def supervised_prebins(
    counts: DataFrame,
    groups: Sequence[str] = (),
    depth: int = 3,
    min_share: float = 0.05,
    ranges: int | None = None,
    keep_missing: bool = False,
) -> DataFrame:
    """As :func:`prebins`, but cut where the classes part best: at most ``2 ** depth`` prebins.

    Level by level each segment is cut after the score that lowers the Gini impurity most, if both sides keep
    ``min_share`` of the group's rows; of equal falls (to nine digits) the lowest score. A candidate's left side
    follows from the running counts and the segment's own ends, so a level takes two aggregates over the
    distinct scores and no window over a segment.
    """
    if 2**depth > MOST_PREBINS + 4:
        raise ValueError("depth is at most 4: merging tries every mask over the prebins")
    groups = list(groups)
    rows = materialize(running_counts(counts, groups, ranges, keep_missing)).withColumn("_node", F.lit(0))
    keys = [*groups, "_node"]

    def same(other: str):
        found = [F.col(f"r.{k}").eqNullSafe(F.col(f"{other}.{k}")) for k in keys]
        return reduce(lambda a, b: a & b, found)

    def impurity(n1, n0):  # times the rows
        return F.coalesce(F.try_divide(n1 * n0 * 2.0, n1 + n0), F.lit(0.0))

    for _ in range(depth):
        ends = rows.groupBy(*keys).agg(
            F.min(F.col("c1") - F.col("n1")).alias("b1"), F.min(F.col("c0") - F.col("n0")).alias("b0"),
            F.max("c1").alias("e1"), F.max("c0").alias("e0"),
        )
        ends = materialize(ends)
        tried = rows.alias("r").join(ends.alias("e"), same("e")).select("r.*", "b1", "b0", "e1", "e0")
        l1, l0 = F.col("c1") - F.col("b1"), F.col("c0") - F.col("b0")
        r1, r0 = F.col("e1") - F.col("c1"), F.col("e0") - F.col("c0")
        fall = impurity(l1 + r1, l0 + r0) - impurity(l1, l0) - impurity(r1, r0)
        least = (F.col("t1") + F.col("t0")) * min_share
        tried = tried.filter((l1 + l0 >= least) & (r1 + r0 >= least)).withColumn("_fall", F.round(fall, 9)).filter("_fall > 0")
        cuts = tried.groupBy(*keys).agg(F.max_by("score", F.struct("_fall", -F.col("score"))).alias("_cut"))
        rows = rows.alias("r").join(materialize(cuts).alias("c"), same("c"), "left").select("r.*", "_cut")
        right = F.coalesce(F.col("score") > F.col("_cut"), F.lit(False)).cast("int")
        rows = rows.withColumn("_node", F.col("_node") * 2 + right).drop("_cut")
    pre = rows.groupBy(*keys).agg(
        F.min("score").alias("lo"), F.max("score").alias("hi"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0")
    )
    w = Window.partitionBy(*groups).orderBy("_node")
    return pre.withColumn("prebin", F.row_number().over(w)).drop("_node")


def _trend_ok(trend: str | None) -> Column:
    ups, downs, turns = F.col("ups") > 0, F.col("downs") > 0, F.col("turns")
    if trend is None:
        return F.lit(True)
    if trend == "auto":
        return turns <= 1
    if trend == "auto_asc_desc":
        return ~(ups & downs)
    if trend == "ascending":
        return ~downs
    if trend == "descending":
        return ~ups
    first = F.coalesce(F.col("first_step"), F.lit(0.0))
    if trend == "peak":
        return (turns <= 1) & ~((turns == 1) & (first < 0))
    if trend == "valley":
        return (turns <= 1) & ~((turns == 1) & (first > 0))
    raise ValueError(f"unknown trend {trend!r}; use one of {TRENDS}")


def merge_prebins(
    pre: DataFrame,
    groups: Sequence[str] = (),
    min_n_bins: int = 1,
    max_n_bins: int | None = None,
    min_bin_share: float = 0.1,
    trend: str | None = "auto",
) -> DataFrame:
    """Best merge of neighbouring prebins: ``bin, lo, hi, n1, n0`` per group.

    A mask is feasible when it has the wanted number of bins, every bin holds ``min_bin_share`` of the
    group's rows and both classes, and the event rates follow the trend. ``auto`` allows one change of
    direction.
    """
    groups = list(groups)
    whole = Window.partitionBy(*groups)
    sized = pre.withColumn("_k", F.max("prebin").over(whole)).select(
        "*", F.sum("n1").over(whole).alias("t1"), F.sum("n0").over(whole).alias("t0")
    )
    n_masks = F.expr("shiftleft(cast(1 as bigint), _k - 1)")
    trials = sized.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), n_masks - 1)))
    # bits below the prebin's own position are the cuts to its left
    left_bits = F.expr("mask & (shiftleft(cast(1 as bigint), prebin - 1) - 1)")
    bins = (
        trials.withColumn("bin", (F.bit_count(left_bits) + 1).cast("int"))
        .groupBy(*groups, "mask", "bin")
        .agg(
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum("n1").alias("n1"),
            F.sum("n0").alias("n0"),
            F.max("t1").alias("t1"),
            F.max("t0").alias("t0"),
        )
    )
    by_mask = Window.partitionBy(*groups, "mask").orderBy("bin")
    rate = F.try_divide(F.col("n1"), F.col("n1") + F.col("n0"))
    steps = bins.withColumn("_rate", rate).withColumn(
        "_step", F.signum(F.col("_rate") - F.lag("_rate").over(by_mask))
    )
    moves = steps.withColumn("_move", F.when(F.col("_step") != 0, F.col("_step")))
    moves = moves.withColumn(
        "_prev",
        F.last("_move", ignorenulls=True).over(by_mask.rowsBetween(Window.unboundedPreceding, -1)),
    )
    n = F.col("n1") + F.col("n0")
    judged = moves.groupBy(*groups, "mask").agg(
        F.array_sort(F.collect_list(F.struct("bin", "lo", "hi", "n1", "n0"))).alias("_bins"),
        F.sum(iv_term(F.col("n1"), F.col("n0"), F.col("t1"), F.col("t0"))).alias("_iv"),
        F.min(F.try_divide(n, F.col("t1") + F.col("t0"))).alias("_smallest"),
        F.min(F.least("n1", "n0")).alias("_rarest"),
        F.count_if(F.col("_move") > 0).alias("ups"),
        F.count_if(F.col("_move") < 0).alias("downs"),
        F.count_if(F.col("_move") != F.col("_prev")).alias("turns"),
        F.min_by("_move", F.when(F.col("_move").isNotNull(), F.col("bin"))).alias("first_step"),
    )
    ok = (
        (F.size("_bins") >= min_n_bins)
        & (F.col("_smallest") >= min_bin_share)
        & (F.col("_rarest") > 0)
        & _trend_ok(trend)
    )
    if max_n_bins is not None:
        ok = ok & (F.size("_bins") <= max_n_bins)
    # the single bin (mask 0) stands in when nothing is feasible
    ranked = judged.withColumn("_ok", ok).filter(F.col("_ok") | (F.col("mask") == 0))
    order = Window.partitionBy(*groups).orderBy(
        F.col("_ok").desc(), F.round("_iv", 9).desc(), F.col("mask")
    )
    best = ranked.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") == 1)
    return best.select(*groups, F.inline("_bins"))


def optimal_bins(
    df: DataFrame,
    score: str,
    target: str,
    min_n_bins: int = 4,
    max_prebins: int = 10,
    min_bin_share: float = 0.1,
    trend: str | None = "auto",
    ranges: int | None = None,
    supervised: bool = False,
) -> DataFrame:
    """Optimal 1-D binning of a score; the ``hi`` of every bin but the last are its splits. ``supervised`` takes
    prebins from :func:`supervised_prebins` instead of ones of equal size."""
    counts = score_counts(df, score, target)
    pre = supervised_prebins(counts, ranges=ranges) if supervised else prebins(counts, (), max_prebins, ranges)
    return merge_prebins(pre, (), min_n_bins, None, min_bin_share, trend)


def fit_splits(df: DataFrame, score: str, target: str, **options) -> list[float]:
    """The splits of ``optimal_bins`` as a list (at most ``max_prebins - 1`` numbers reach the driver)."""
    rows = optimal_bins(df, score, target, **options).select("bin", "hi").orderBy("bin").collect()
    return [r["hi"] for r in rows[:-1]]


def binning_table(bins: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per bin: count, share, events, non-events, event rate, WoE and IV contribution."""
    whole = Window.partitionBy(*groups)
    n1, n0 = F.col("n1"), F.col("n0")
    t1, t0 = F.sum("n1").over(whole), F.sum("n0").over(whole)
    sized = bins.select("*", t1.alias("_t1"), t0.alias("_t0"))
    t1, t0 = F.col("_t1"), F.col("_t0")
    return sized.select(
        *groups,
        "bin",
        "lo",
        "hi",
        (n1 + n0).alias("count"),
        F.try_divide(n1 + n0, t1 + t0).alias("count_share"),
        n0.alias("non_event"),
        n1.alias("event"),
        F.try_divide(n1, n1 + n0).alias("event_rate"),
        woe(n1, n0, t1, t0).alias("woe"),
        iv_term(n1, n0, t1, t0).alias("iv"),
    )


def risk_group(
    score: str | Column, splits: Sequence[float], low: float = -1, high: float = 1000
) -> Column:
    """Label 1..k+1 of the right-closed interval holding the score; NULL outside ``(low, high]``."""
    edges = [low, *splits, high]
    if any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError(f"edges must increase strictly: {edges}")
    s = col(score)
    group = F.when((s <= low) | s.isNull() | F.isnan(s.cast("double")), None)
    for label, edge in enumerate(edges[1:], start=1):
        group = group.when(s <= edge, label)
    return group


def _as_rows(
    df: DataFrame, features: Sequence[str], target: str, edges: dict[str, list[float]] | None = None
) -> list[DataFrame]:
    """``_y, variable, score`` rows, one frame per chunk of features; missing values have a NULL score.
    With ``edges``, also ``_slot``: how many of the feature's edges lie below the value.

    Chunks keep generated code small and each reads only its columns. The rows are generated, not
    unpivoted: such a plan is recognized as equal when read twice, so its shuffle is reused.
    """
    types = dict(df.dtypes)

    def pair(c):
        value = F.when(~missing(c, types[c]), F.col(c).cast("double"))
        fields = [F.lit(c).alias("variable"), value.alias("score")]
        if edges is not None:
            below = [(value > e).cast("int") for e in edges[c]]
            fields.append(F.coalesce(reduce(add, below, F.lit(0)), F.lit(0)).alias("_slot"))
        return F.struct(*fields)

    frames = []
    for i in range(0, len(features), _UNPIVOT_CHUNK):
        pairs = F.array(*[pair(c) for c in features[i : i + _UNPIVOT_CHUNK]])
        frames.append(
            df.filter(F.col(target).isin(0, 1)).select(F.col(target).alias("_y"), F.inline(pairs))
        )
    return frames


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _exact_prebins(
    df: DataFrame, features: Sequence[str], target: str, max_prebins: int, ranges: int | None, supervised: bool
) -> DataFrame:
    counts = _stack([class_counts(f, "score", "_y", ["variable"]) for f in _as_rows(df, features, target)])
    counts = counts.withColumn("_gone", F.col("score").isNull())
    if supervised:
        return supervised_prebins(counts, ["variable", "_gone"], ranges=ranges, keep_missing=True)
    return prebins(counts, ["variable", "_gone"], max_prebins, ranges, keep_missing=True)


def fit_edges(
    df: DataFrame, features: Sequence[str], target: str, max_prebins: int = 10, accuracy: int = 1000
) -> dict[str, list[float]]:
    """Approximate prebin edges per feature from one quantile sketch each. At most ``max_prebins - 1``
    numbers per feature reach the driver; sketches of different features merge in different tasks."""
    wanted = [k / max_prebins for k in range(1, max_prebins)]
    edges: dict[str, list[float]] = {c: [] for c in features}
    for frame in _as_rows(df, features, target):
        quantiles = F.percentile_approx("score", wanted, accuracy)
        for row in frame.groupBy("variable").agg(quantiles.alias("edges")).collect():
            edges[row["variable"]] = sorted(set(row["edges"] or []))
    return edges


def _sketched_prebins(
    df: DataFrame, features: Sequence[str], target: str, edges: dict[str, list[float]]
) -> DataFrame:
    """Prebins cut at sketched edges: only (variable, slot) totals are shuffled, never values."""
    frames = [
        rows.groupBy("variable", F.col("score").isNull().alias("_gone"), "_slot").agg(
            F.min("score").alias("lo"),
            F.max("score").alias("hi"),
            F.count_if(F.col("_y") == 1).alias("n1"),
            F.count_if(F.col("_y") == 0).alias("n0"),
        )
        for rows in _as_rows(df, features, target, edges)
    ]
    w = Window.partitionBy("variable", "_gone").orderBy("_slot")
    return _stack(frames).withColumn("prebin", F.row_number().over(w)).drop("_slot")


def feature_bins(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    min_n_bins: int = 1,
    max_prebins: int = 10,
    min_bin_share: float = 0.1,
    trend: str | None = "auto",
    ranges: int | None = None,
    accuracy: int | None = None,
    edges: dict[str, list[float]] | None = None,
    supervised: bool = False,
) -> DataFrame:
    """Optimal bins of every feature, with missing values in a bin of their own (``bin`` 0).

    Prebins are exact unless ``accuracy`` is given: then their edges come from quantile sketches, which
    suits very large tables of mostly unique values. ``supervised`` cuts prebins where classes part best. ``edges`` hands over edges found before, from stored
    sketches, say. Counts and IV are exact for the bins either way.
    """
    if edges is not None:
        pre = _sketched_prebins(df, features, target, edges)
    elif accuracy is None:
        pre = _exact_prebins(df, features, target, max_prebins, ranges, supervised)
    else:
        pre = _sketched_prebins(df, features, target, fit_edges(df, features, target, max_prebins, accuracy))
    bins = merge_prebins(pre, ["variable", "_gone"], min_n_bins, None, min_bin_share, trend)
    return bins.withColumn("bin", F.when(F.col("_gone"), 0).otherwise(F.col("bin"))).drop("_gone")


def iv_table(df: DataFrame, features: Sequence[str], target: str, **options) -> DataFrame:
    """Information value per feature: ``name, iv, n_bins``, highest first."""
    table = binning_table(feature_bins(df, features, target, **options), ["variable"])
    return (
        table.groupBy(F.col("variable").alias("name"))
        .agg(F.sum("iv").alias("iv"), F.count_if(F.col("bin") > 0).alias("n_bins"))
        .orderBy(F.col("iv").desc(), "name")
    )


def features_below_cap(iv: DataFrame, cap: float = 0.54) -> DataFrame:
    """Features with ``iv`` under an upper cap: too good a predictor is usually a leak."""
    return iv.filter(F.col("iv") < cap)


def feature_names(iv: DataFrame, cap: float = 0.54) -> list[str]:
    """The capped feature names (one short row per feature reaches the driver)."""
    rows = features_below_cap(iv, cap).orderBy(F.col("iv").desc(), "name").select("name").collect()
    return [r["name"] for r in rows]
