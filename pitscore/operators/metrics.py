"""Evaluation of a binary score as grouped aggregates. ``groups`` is usually the split, or split and
period; every metric returns one row per group (curves: one row per distinct score)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.functions.columns import count_if
from pitscore.operators.ranking import ranked

CELLS = ["n00", "n01", "n10", "n11"]


def _aggregate(df: DataFrame, groups: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)


def _ratio(part: Column, whole: Column) -> Column:
    """0.0 when undefined, as is usual for precision and recall."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def confusion(df: DataFrame, target: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """Counts named ``n<actual><predicted>`` per group."""
    actual, said = F.col(target), F.col(prediction)
    cells = [
        count_if((actual == a) & (said == p)).alias(f"n{a}{p}") for a in (0, 1) for p in (0, 1)
    ]
    return _aggregate(df, groups, *cells)


def recall_precision(
    df: DataFrame, target: str, prediction: str, groups: Sequence[str] = ()
) -> DataFrame:
    c = confusion(df, target, prediction, groups)
    n01, n10, n11 = F.col("n01"), F.col("n10"), F.col("n11")
    return c.select(
        *groups, _ratio(n11, n11 + n10).alias("recall"), _ratio(n11, n11 + n01).alias("precision")
    )


def classification_report(
    df: DataFrame, target: str, prediction: str, groups: Sequence[str] = ()
) -> DataFrame:
    """Rows ``0``, ``1``, ``accuracy``, ``macro avg``, ``weighted avg`` per group, all derived from the
    four counts. The accuracy row carries the accuracy in ``f1``."""
    n = {k: F.col(k) for k in CELLS}

    def scores(hit, false_hit, missed):
        p = _ratio(hit, hit + false_hit)
        r = _ratio(hit, hit + missed)
        return p, r, _ratio(2 * p * r, p + r)

    total = n["n00"] + n["n01"] + n["n10"] + n["n11"]
    rows = {
        "0": (*scores(n["n00"], n["n10"], n["n01"]), n["n00"] + n["n01"]),
        "1": (*scores(n["n11"], n["n01"], n["n10"]), n["n10"] + n["n11"]),
    }
    null = F.lit(None).cast("double")
    s0, s1 = rows["0"][3], rows["1"][3]
    rows["accuracy"] = (null, null, _ratio(n["n00"] + n["n11"], total), total)
    rows["macro avg"] = (*[(rows["0"][i] + rows["1"][i]) / 2 for i in range(3)], total)
    rows["weighted avg"] = (
        *[_ratio(rows["0"][i] * s0 + rows["1"][i] * s1, total) for i in range(3)],
        total,
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("label"),
                p.alias("precision"),
                r.alias("recall"),
                f.alias("f1"),
                s.alias("support"),
            )
            for name, (p, r, f, s) in rows.items()
        ]
    )
    return confusion(df, target, prediction, groups).select(*groups, F.inline(lines))


def _ks(digits: int | None) -> Column:
    gap = F.abs(
        F.try_divide(F.col("c1"), F.col("t1")) - F.try_divide(F.col("c0"), F.col("t0"))
    )
    value = F.max(gap)
    return (value if digits is None else F.round(value, digits)).alias("ks")


def _auc() -> Column:
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    wins = F.sum(n1 * (F.col("c0") - n0 + n0 / 2))
    return F.try_divide(wins, F.max("t1").cast("double") * F.max("t0")).alias("auc")


def _precision() -> Column:
    tp = F.col("t1") - F.col("c1") + F.col("n1")
    fp = F.col("t0") - F.col("c0") + F.col("n0")
    step = F.try_divide(F.col("n1"), F.col("t1")) * F.try_divide(tp, tp + fp)
    return F.coalesce(F.sum(step), F.lit(0.0)).alias("average_precision")


def ks(
    df: DataFrame,
    target: str,
    prob: str,
    groups: Sequence[str] = (),
    digits: int | None = 4,
    ranges: int | None = None,
) -> DataFrame:
    """Largest distance between the two classes' cumulative shares; NULL when a class is empty."""
    return _aggregate(ranked(df, prob, target, groups, ranges), groups, _ks(digits))


def ks_by_date_ref(
    dataset: DataFrame,
    variable_period: str,
    variable_target_categorical: str,
    variable_target_prob: str,
    groups: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """One KS per period, keyed ``period_ref_<period>``."""
    per = ks(
        dataset,
        variable_target_categorical,
        variable_target_prob,
        [*groups, variable_period],
        ranges=ranges,
    )
    key = F.concat(F.lit("period_ref_"), F.col(variable_period).cast("string"))
    return per.select(*groups, key.alias("period_ref"), "ks")


def roc_auc(
    df: DataFrame, target: str, score: str, groups: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Share of (event, non-event) pairs ranked right, ties counting half; exact, from counts only.

    On a 0/1 prediction this is the mean of the two classes' hit rates.
    """
    return _aggregate(ranked(df, score, target, groups, ranges), groups, _auc())


def average_precision(
    df: DataFrame, target: str, score: str, groups: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Sum over thresholds of recall gained times precision reached (steps, not trapezoids)."""
    return _aggregate(ranked(df, score, target, groups, ranges), groups, _precision())


def ranking_metrics(
    df: DataFrame, target: str, score: str, groups: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """``ks``, ``auc`` and ``average_precision`` from one reading of the running counts."""
    r = ranked(df, score, target, groups, ranges)
    return _aggregate(r, groups, _ks(4), _auc(), _precision())


def _thinned(r: DataFrame, groups: Sequence[str], cells: int) -> DataFrame:
    """Of the running counts at most three points for each of ``cells`` + 1 equal shares of the rows: the first
    and the last one, and the one where the classes lie farthest apart (ties: the lower score)."""
    apart = F.abs(F.try_divide(F.col("c1"), F.col("t1")) - F.try_divide(F.col("c0"), F.col("t0")))
    cell = F.floor(F.try_divide((F.col("c1") + F.col("c0")) * cells, F.col("t1") + F.col("t0")))
    columns = ["score", "n1", "n0", "c1", "c0", "t1", "t0"]
    point = F.struct(*columns)
    far = F.max_by(point, F.struct(F.round(apart, 12), -F.col("score")))
    kept = r.groupBy(*groups, cell.alias("_cell")).agg(F.array_distinct(F.array(F.min_by(point, "score"), F.max_by(point, "score"), far)).alias("_p"))
    return kept.select(*groups, F.inline("_p"))


def roc_curve(
    df: DataFrame, target: str, score: str, groups: Sequence[str] = (), cells: int = 500, ranges: int | None = None
) -> DataFrame:
    """``threshold, fpr, tpr`` of bounded size: at most ``3 * (cells + 1)`` points a group, however many
    scores there are. The area under it differs from the exact one by at most ``n * n / (8 * cells * t1 * t0)``
    (1 / (2 * cells) for classes of equal size), and the point of the largest KS distance is on it."""
    r = _thinned(ranked(df, score, target, groups, ranges), groups, cells)
    return _roc(r, groups)


def ks_curve(
    df: DataFrame, target: str, score: str, groups: Sequence[str] = (), cells: int = 500, ranges: int | None = None
) -> DataFrame:
    """``threshold, cdf_event, cdf_nonevent, distance`` of bounded size, as :func:`roc_curve`; the largest
    distance is the exact KS."""
    return _ks_curve(_thinned(ranked(df, score, target, groups, ranges), groups, cells), groups)


def roc_points(
    df: DataFrame, target: str, score: str, groups: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """False and true positive rate at each distinct score used as threshold (``score >= threshold``)."""
    return _roc(ranked(df, score, target, groups, ranges), groups)


def _roc(r: DataFrame, groups: Sequence[str]) -> DataFrame:
    fp = F.col("t0") - F.col("c0") + F.col("n0")
    tp = F.col("t1") - F.col("c1") + F.col("n1")
    return r.select(
        *groups,
        F.col("score").alias("threshold"),
        F.try_divide(fp, F.col("t0")).alias("fpr"),
        F.try_divide(tp, F.col("t1")).alias("tpr"),
    )


def ks_points(
    df: DataFrame, target: str, score: str, groups: Sequence[str] = (), ranges: int | None = None
) -> DataFrame:
    """Both classes' cumulative shares, and their distance, at each distinct score."""
    return _ks_curve(ranked(df, score, target, groups, ranges), groups)


def _ks_curve(r: DataFrame, groups: Sequence[str]) -> DataFrame:
    cdf1 = F.try_divide(F.col("c1"), F.col("t1"))
    cdf0 = F.try_divide(F.col("c0"), F.col("t0"))
    return r.select(
        *groups,
        F.col("score").alias("threshold"),
        cdf1.alias("cdf_event"),
        cdf0.alias("cdf_nonevent"),
        F.abs(cdf1 - cdf0).alias("distance"),
    )
