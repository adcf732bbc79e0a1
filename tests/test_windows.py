"""Windows and totals computed on Arrow batches, against the same in SQL."""

from __future__ import annotations

import gc
import math
import random
import weakref

import numpy as np
from pyspark.sql import functions as F

from pitscore.operators import rolling, windows
from pitscore.operators.profile import feature_totals
from pitscore.plans import model_table as plan
from pitscore.sources import fixtures

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def series(spark, lengths, odd=False):
    rng, rows = random.Random(3), []
    for s, n in enumerate(lengths):
        for d in range(n):
            values = [rng.choice([None, float("nan"), 0.0, -1.5, 7.25]) if odd and rng.random() < 0.3 else round(rng.uniform(-50, 50), 2) for _ in "xy"]
            rows.append((f"{s:02d}", "T", d, *values))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id_cnpj string, ticker string, day int, x double, y double").repartition(3)


def families(df):
    sizes = [1, 2, 5, 7, 30, 31, 60, 77, 90, 130]
    p = rolling.RollingFeatures(df, plan.SERIES, ["day"]).stats("x", sizes).changes("x", sizes).changes("y", [3])
    p.slopes("x", sizes).breakouts("x", sizes, True).breakouts("x", sizes, False).breakouts("y", [4], True)
    return p.strength("x", sizes)


def same(a, b):
    if a is None or b is None:
        return a is b
    return math.isnan(b) if math.isnan(a) else a == b or abs(a - b) <= 1e-7 * max(1.0, abs(a))


def compare(spark, df, batch):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(batch))
    try:
        want, ours = families(df).build(), families(df).build_in_arrow()
        assert ours.dtypes == want.dtypes
        order = ["id_cnpj", "day"]
        want, ours = want.orderBy(*order).collect(), ours.orderBy(*order).collect()
    finally:
        spark.conf.set(BATCH, before)
    assert len(ours) == len(want) > 0
    for a, b in zip(ours, want, strict=True):
        for name in a.asDict():
            if name not in ("id_cnpj", "ticker"):
                assert same(b[name], a[name]), (name, a["id_cnpj"], a["day"], a[name], b[name])


def test_arrow_windows_equal_sql_over_batch_borders(spark):
    compare(spark, series(spark, [140, 1, 2, 35, 64]), 13)


def test_arrow_windows_keep_nulls_and_nan_as_sql_does(spark):
    compare(spark, series(spark, [9, 150, 33], odd=True), 40)


def test_a_batch_leaves_nothing_behind():
    rng, families = np.random.default_rng(1), [("stats", "x", [7, 360], "x"), ("slopes", "x", [361], "x"), ("strength", "x", [90], "x")]
    families += [("breakouts", "x", [120], "x", True), ("breakouts", "x", [120], "x", False), ("changes", "x", [5], "x")]
    gc.collect()
    gc.disable()  # workers go through many batches before garbage is looked for
    try:
        block = windows.Block(np.arange(1, 901), {"x": (rng.uniform(1, 2, 900), rng.random(900) < 0.9)})
        found, gone = windows.features_of(block, families), weakref.ref(block)
        parts = weakref.ref(block.extremes("x", True))
        assert len(found) == 13
        del block, found
        assert gone() is None and parts() is None
    finally:
        gc.enable()


def test_full_model_table_computes_windows_in_one_arrow_step(spark, small):
    full = plan.build_full_model_table(fixtures.messy_prices(spark, small), fixtures.messy_statements(spark, small), "1995-03-31")
    text = full._jdf.queryExecution().executedPlan().toString()
    above = text[: text.index("Union")]
    # the carried statement, the target's lags and the row number; no frame of a feature, and no second shuffle
    assert above.count("ArrowEvalPython") == 1 and above.count("Window [") <= 3 and above.count("Exchange") == 1
    assert "_statement" in above and "struct(" not in above


def test_feature_totals_equal_plain_aggregates(spark):
    rows = [(g, k, *v) for g in ("a", None) for k in (1, None) for v in ((1.25, 2, None), (None, 3, None), (float(k or 9), -4, None))]
    rows += [("n", 1, float("nan"), 1, None), ("n", 1, 1.0, None, None)]
    df = spark.createDataFrame(rows, "g string, k int, x double, pct_y int, z double").repartition(5)
    for groups in (["g", "k"], ["k"], []):
        aggregates = [a for f in ("x", "pct_y", "z") for a in (F.count(f).alias(f"n_{f}"), F.sum(F.col(f).cast("double")).alias(f"t_{f}"))]
        want = {}
        for r in df.groupBy(*groups).agg(*aggregates).collect():
            for f, digits in (("x", 1), ("pct_y", 3), ("z", 1)):
                t = r[f"t_{f}"]
                want[*(r[g] for g in groups), f] = (r[f"n_{f}"], None if t is None else str(round(t + 0.0123456789, digits)))
        out = feature_totals(df, ["x", "pct_y", "z"], groups)
        assert out.columns == [*groups, "feature", "n", "total"] and dict(out.dtypes)["n"] == "bigint"
        got = {(*(r[g] for g in groups), r["feature"]): (r["n"], None if r["total"] is None else str(r["total"])) for r in out.collect()}
        assert got == want
    assert feature_totals(df.limit(0), ["x"], ["g"]).collect() == []
    assert [(r["feature"], r["n"], r["total"]) for r in feature_totals(df.limit(0), ["x"], []).collect()] == [("x", 0, None)]


def test_feature_totals_of_many_groups(spark):
    df = spark.range(20_000).select((F.col("id") % 9_000).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).alias("one"))
    out = feature_totals(df.coalesce(1), ["x", "one"], ["g"])
    assert out.count() == 18_000 and out.filter("feature = 'one'").agg(F.sum("n"), F.sum(F.round("total"))).first() == (20_000, 20_000.0)
    assert out.filter("feature = 'x'").agg(F.sum(F.floor("total"))).first()[0] == 20_000 * 19_999 // 2
