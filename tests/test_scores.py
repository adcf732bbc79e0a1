"""Edge cases and properties of profiling, metrics and binning."""

import itertools
import math
import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from pitscore.operators import binning, metrics, profile
from pitscore.operators.ranking import ranked


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "prob double, y int")


def random_scores(n, seed, levels=None):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.random() if levels is None else rng.randrange(levels) / levels
        out.append((s, int(rng.random() < 0.2 + 0.6 * s)))
    return out


def brute_ks(pairs):
    one = sorted(s for s, y in pairs if y == 1)
    zero = sorted(s for s, y in pairs if y == 0)
    return max(
        abs(sum(v <= s for v in one) / len(one) - sum(v <= s for v in zero) / len(zero)) for s, _ in pairs
    )


@pytest.mark.parametrize("levels", [None, 3, 20])
@pytest.mark.parametrize("ranges", [2, 16, 256])
def test_metrics_equal_brute_force(spark, levels, ranges):
    pairs = random_scores(300, 11, levels)
    df = frame(spark, pairs).repartition(5)
    assert metrics.ks(df, "y", "prob", digits=None, ranges=ranges).first()[0] == pytest.approx(brute_ks(pairs))
    ones = [s for s, y in pairs if y]
    zeros = [s for s, y in pairs if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros)
    auc = metrics.roc_auc(df, "y", "prob", ranges=ranges).first()[0]
    assert auc == pytest.approx(wins / len(ones) / len(zeros))
    flipped = metrics.roc_auc(df.withColumn("prob", -F.col("prob")), "y", "prob").first()[0]
    assert auc + flipped == pytest.approx(1)
    ap, seen = 0.0, 0.0
    for t in sorted({s for s, _ in pairs}, reverse=True):
        tp = sum(s >= t for s in ones)
        fp = sum(s >= t for s in zeros)
        ap += (tp - seen) / len(ones) * tp / (tp + fp)
        seen = tp
    assert metrics.average_precision(df, "y", "prob", ranges=ranges).first()[0] == pytest.approx(ap)


def test_auc_equals_the_library_evaluator(spark):
    df = frame(spark, random_scores(2000, 3)).withColumn("label", F.col("y").cast("double"))
    judge = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", numBins=0)
    assert metrics.roc_auc(df, "y", "prob").first()[0] == pytest.approx(judge.evaluate(df))


def test_hot_score_and_hot_group(spark):
    # a third of the rows share one score, another third one group
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.col("id") / 9000).alias("prob"),
        F.when(F.col("id") % 3 == 1, F.lit(0)).otherwise(F.col("id") % 40).alias("g"),
        (F.col("id") % 7 < 3).cast("int").alias("y"),
    )
    r = ranked(df, "prob", "y", ["g"])
    assert r.agg(F.sum("n1") + F.sum("n0")).first()[0] == 9000
    last = r.groupBy("g").agg((F.max("c1") + F.max("c0")).alias("n"), F.max(F.col("t1") + F.col("t0")).alias("t"))
    assert last.filter("n <> t").count() == 0


def test_period_with_one_class_has_no_ks(spark):
    df = spark.createDataFrame([(1, 0.2, 1), (1, 0.3, 1), (2, 0.1, 0), (2, 0.9, 1)], "m int, prob double, y int")
    out = {r["period_ref"]: r["ks"] for r in metrics.ks_by_date_ref(df, "m", "y", "prob").collect()}
    assert out == {"period_ref_1": None, "period_ref_2": 1.0}


def test_label_auc_is_mean_of_hit_rates(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] + [(0, 0)] * 4 + [(1, 0)] * 2, "p int, y int")
    assert metrics.roc_auc(df, "y", "p").first()[0] == pytest.approx((3 / 4 + 4 / 6) / 2)


def test_undefined_precision_is_zero(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "p int, y int")
    assert tuple(metrics.recall_precision(df, "y", "p").first()) == (0.0, 0.0)


def test_report_by_hand(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(0, 1)] + [(0, 0)] * 4 + [(1, 0)] * 2, "p int, y int")
    rows = {r["label"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert rows["1"]["precision"] == pytest.approx(0.6) and rows["1"]["recall"] == pytest.approx(0.75)
    assert rows["accuracy"]["f1"] == pytest.approx(0.7) and rows["macro avg"]["support"] == 10
    f1 = [rows["0"]["f1"], rows["1"]["f1"]]
    assert rows["weighted avg"]["f1"] == pytest.approx((f1[0] * 6 + f1[1] * 4) / 10)


def test_description_counts_null_and_nan(spark):
    df = spark.createDataFrame(
        [(1.0, None, "a"), (float("nan"), None, "a"), (None, None, None), (1.0, None, "b")],
        "x double, gone string, s string",
    )
    for approximate in (False, True):
        out = {r["column"]: r for r in profile.dataset_description(df, approximate).collect()}
        assert (out["x"]["n_missing"], out["x"]["n_distinct"], out["x"]["pct_missing"]) == (2, 1, 50.0)
        assert (out["gone"]["n_missing"], out["gone"]["n_distinct"]) == (4, 0)
        assert (out["s"]["n_missing"], out["s"]["n_distinct"], out["s"]["type"]) == (1, 2, "string")


def test_class_share_keeps_null_target(spark):
    df = spark.createDataFrame([(2020, 1, 1), (2020, 1, 0), (2020, 1, None)], "y int, m int, t int")
    for form in (profile.class_share, profile.class_share_by_join):
        out = {r["t"]: (r["qty"], r["total"], r["pct"]) for r in form(df, ["y", "m"], "t").collect()}
        assert out == {1: (1, 2, 50.0), 0: (1, 2, 50.0), None: (0, 2, 0.0)}


def test_risk_group_edges(spark):
    splits = [0.1, 0.5]
    values = [(-1.0,), (-0.5,), (0.1,), (0.10001,), (0.5,), (1000.0,), (1000.5,), (None,), (float("nan"),)]
    df = spark.createDataFrame(values, "s double")
    got = [r[0] for r in df.select(binning.risk_group("s", splits)).collect()]
    assert got == [None, 1, 1, 2, 2, 3, None, None, None]
    with pytest.raises(ValueError):
        binning.risk_group("s", [0.5, 0.1])


def brute_bins(pre, min_n, share, unimodal=True):
    """Best merge by trying every cut set over (n1, n0) prebins."""
    t1, t0 = sum(a for a, _ in pre), sum(b for _, b in pre)
    best = None
    for cuts in itertools.product([0, 1], repeat=len(pre) - 1):
        bins, cur = [], [0, 0]
        for i, (a, b) in enumerate(pre):
            cur = [cur[0] + a, cur[1] + b]
            if i == len(pre) - 1 or cuts[i]:
                bins.append(tuple(cur))
                cur = [0, 0]
        if len(bins) < min_n or any(a == 0 or b == 0 or (a + b) / (t1 + t0) < share for a, b in bins):
            continue
        rates = [a / (a + b) for a, b in bins]
        moves = [d for d in (y - x for x, y in itertools.pairwise(rates)) if d]
        turns = sum((x > 0) != (y > 0) for x, y in itertools.pairwise(moves))
        if unimodal and turns > 1:
            continue
        iv = sum((b / t0 - a / t1) * math.log((b / t0) / (a / t1)) for a, b in bins)
        if best is None or iv > best[0] + 1e-12:
            best = (iv, len(bins))
    return best


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_optimal_bins_equal_brute_force(spark, seed):
    df = frame(spark, random_scores(700, seed))
    pre = binning.prebins(binning.score_counts(df, "prob", "y")).orderBy("prebin").collect()
    assert len(pre) == 10
    want = brute_bins([(r["n1"], r["n0"]) for r in pre], 4, 0.1)
    table = binning.binning_table(binning.optimal_bins(df, "prob", "y")).collect()
    assert sum(r["iv"] for r in table) == pytest.approx(want[0]) and len(table) == want[1]
    splits = binning.fit_splits(df, "prob", "y")
    assert splits == sorted(splits) and len(splits) == len(table) - 1


@pytest.mark.parametrize("trend", ["ascending", "auto_asc_desc", "peak", "valley", None])
def test_trends(spark, trend):
    df = frame(spark, random_scores(1500, 4))
    rates = [
        r["event_rate"]
        for r in binning.binning_table(binning.optimal_bins(df, "prob", "y", trend=trend)).orderBy("bin").collect()
    ]
    moves = [b - a for a, b in itertools.pairwise(rates)]
    if trend in ("ascending", "auto_asc_desc"):
        assert all(m >= 0 for m in moves)
    assert len(rates) >= 4


def test_infeasible_binning_is_one_bin(spark):
    df = frame(spark, [(0.1, 1), (0.1, 0), (0.2, 1), (0.2, 0)] * 10)
    assert binning.optimal_bins(df, "prob", "y", min_n_bins=4).count() == 1


def test_information_value_edges(spark):
    rows = [(float(i % 10), None if i % 4 == 0 else 1.0, None, int(i % 10 >= 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "good double, gaps double, empty double, y int")
    out = {r["name"]: r for r in binning.iv_table(df, ["good", "gaps", "empty"], "y").collect()}
    assert out["good"]["iv"] == 0.0 and out["good"]["n_bins"] == 1  # a cut would leave a bin without events
    assert out["empty"]["iv"] == 0.0 and out["empty"]["n_bins"] == 0
    assert all(r["iv"] >= 0 for r in out.values())
    bins = binning.feature_bins(df, ["gaps"], "y").filter("bin = 0").collect()
    assert bins[0]["n1"] + bins[0]["n0"] == 50
    assert [r["name"] for r in binning.features_below_cap(binning.iv_table(df, ["good"], "y")).collect()] == ["good"]


def test_sketched_edges_equal_exact_ones_at_full_accuracy(spark):
    rng = random.Random(9)
    rows = [(rng.random(), float(rng.randrange(6)), None if rng.random() < 0.3 else rng.random()) for _ in range(800)]
    rows = [(*r, int(rng.random() < 0.2 + 0.6 * r[0])) for r in rows]
    df = spark.createDataFrame(rows, "unique double, ties double, gaps double, y int")
    names = ["unique", "ties", "gaps"]
    exact = binning.feature_bins(df, names, "y").orderBy("variable", "bin").collect()
    sketched = binning.feature_bins(df, names, "y", accuracy=100000).orderBy("variable", "bin").collect()
    assert exact == sketched
