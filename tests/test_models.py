"""Training, search, selection, sinks and the full flow on planted signals."""

import random

import pytest
from pyspark.sql import functions as F

from pitscore.operators import metrics, modeling, selection
from pitscore.plans import scoring
from pitscore.sources import io


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        a, b, noise, noise2 = rng.random(), rng.random(), rng.random(), rng.random()
        y = int(rng.random() < (0.1 + 0.8 * (a + b > 1)))
        month = 1 + i % 12
        rows.append((i, f"c{i % 7}", "T", 2022 + i % 2, month, y, a, b, noise, noise2))
    df = spark.createDataFrame(
        rows,
        "date int, id_cnpj string, ticker string, dt_year int, dt_month int, cat_target int, "
        "a double, b double, noise double, noise2 double",
    )
    return io.materialize(scoring.training_table(df))


FEATURES = ["a", "b", "noise", "noise2"]


def test_balanced_weights(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)], "y int")
    out = modeling.with_balanced_weight(df, "y", "w").groupBy("y").agg(F.sum("w").alias("s")).collect()
    assert {r["s"] for r in out} == {2.0}


@pytest.mark.parametrize(
    "family, params", [("boosted", {"maxIter": 5, "maxDepth": 3}), ("forest", {"numTrees": 10, "maxDepth": 4})]
)
def test_signal_is_found(planted, family, params):
    model, scored, rows = scoring.fit_and_evaluate(planted, FEATURES, "r1", family=family, **params)
    got = {(r["split"], r["metric"]): r["value"] for r in rows.filter("period is null").collect()}
    assert got[("out", "roc")] > 0.75 and got[("test", "ks")] > 0.4
    cells = sum(got[("out", f"cm_{c}")] for c in ("00", "01", "10", "11"))
    assert cells == scored.filter("split = 'out'").count() == 1500
    assert scored.filter("prob < 0 or prob > 1 or prediction not in (0, 1)").count() == 0
    top = [r["name"] for r in modeling.importances(model, FEATURES).limit(2).collect()]
    assert set(top) == {"a", "b"}
    periods = rows.filter("metric = 'ks_by_period' and split = 'out'").count()
    assert periods == 6


def test_metric_sink_is_idempotent(spark, planted, tmp_path):
    path = str(tmp_path / "metrics")
    df = planted.withColumn("prediction", (F.col("a") > 0.5).cast("int"))
    lines = io.metric_rows(
        metrics.recall_precision(df, "cat_target", "prediction", ["split"]), "r", ["recall", "precision"], "split"
    )
    params = io.param_rows(spark, "p", {"maxDepth": 3})
    io.write_metrics(lines, path)
    io.write_metrics(lines, path)
    io.write_metrics(params, path)
    back = io.read_metrics(spark, path)
    assert back.filter("run = 'r'").count() == lines.count()
    assert back.filter("run = 'p'").first()["value"] == 3.0


def test_model_roundtrip(planted, tmp_path):
    model = modeling.train(planted, FEATURES, "cat_target", "forest", numTrees=3)
    io.save_model(model, str(tmp_path / "m"))
    a = modeling.score(model, planted).select("date", "prob").orderBy("date").collect()
    b = modeling.score(io.load_model(str(tmp_path / "m")), planted).select("date", "prob").orderBy("date").collect()
    assert a == b


def test_search_keeps_the_best_trial(planted):
    space = {"forest": {"maxDepth": (1, 4), "numTrees": (3, 6), "minInstancesPerNode": (10, 60)}}
    _, family, params, log = modeling.search(
        planted.filter("split = 'train'"),
        planted.filter("split = 'test'"),
        FEATURES,
        "cat_target",
        space,
        ("forest",),
        trials=3,
    )
    assert family == "forest" and len(log) == 3
    assert params == max(log, key=lambda r: (r[3], -r[0]))[2]


def test_drawn_parameters_stay_in_range():
    for name, families in modeling.SEARCH_SPACES.items():
        for space in families.values():
            for p in modeling.draw_params(space, 20):
                for k, (low, high, *_) in space.items():
                    assert low <= p[k] <= high, (name, k)
            assert modeling.draw_params(space, 5) == modeling.draw_params(space, 5)


def test_positions_are_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").alias("k"))
    out = selection.hash_position(df, ["k"], 3)
    assert sorted(r["_pos"] for r in out.collect()) == list(range(5000))
    table = out.withColumn("x", F.col("k"))
    pairs = selection.shadow_frame(table, ["x"], 5000, 1234).collect()
    assert len(pairs) == 5000 and sorted(r["_shadow_0"] for r in pairs) == list(range(5000))
    assert all(r["_shadow_0"] != r["x"] for r in pairs)


def test_selection_keeps_signal_and_drops_noise(planted):
    report, _, scored, _ = scoring.select_and_refit(
        planted, FEATURES, "sel", rounds=10, family="forest", numTrees=5
    )
    got = {r["features"]: r["decision"] for r in report.collect()}
    assert got["a"] == got["b"] == "confirmed"
    assert got["noise"] != "confirmed" and got["noise2"] != "confirmed"
    assert [r["rank"] for r in report.collect()] == sorted(r["rank"] for r in report.collect())
    assert "noise" not in scored.columns


def test_verdicts():
    assert selection.decide(20, 20, 10) == "confirmed"
    assert selection.decide(0, 20, 10) == "rejected"
    assert selection.decide(10, 20, 10) == "tentative"


def test_feature_ranking_and_cap(planted):
    iv = scoring.rank_features(planted, FEATURES)
    names = [r["name"] for r in iv.collect()]
    assert set(names[:2]) == {"a", "b"}
    assert "a" not in scoring.capped_features(iv, planted, cap=0.05)


def test_risk_groups_follow_the_score(planted):
    scored = planted.withColumn("prob", (F.col("a") + F.col("b")) / 2)
    labelled, rates = scoring.risk_groups(scored)
    assert labelled.filter("gh is null").count() == 0
    by_group = [r["e"] for r in labelled.groupBy("gh").agg(F.avg("cat_target").alias("e")).orderBy("gh").collect()]
    assert by_group[-1] > by_group[0] and len(by_group) >= 4
    assert rates.agg(F.sum("n")).first()[0] == 3000


def test_work_dir_comes_from_the_session(spark):
    assert io.work_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_shadow_rounds_shuffle_donors_only(spark):
    rows = spark.range(3000).select(F.col("id").alias("_pos"), F.hash("id").alias("x"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    kept = selection.by_position(rows)
    try:
        assert kept.count() == 3000
        pairs = selection.shadow_frame(kept, ["x"], 3000, 7)
        text = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and text.count("ENSURE_REQUIREMENTS") == 1
        assert pairs.exceptAll(selection.shadow_frame(rows, ["x"], 3000, 7)).isEmpty() and pairs.count() == 3000
    finally:
        kept.unpersist()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
