"""Queries of the learners against their SQL, the halving search, and the steps of feature selection."""

import glob
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_oracle import canonical

from pitscore import learned, learned_oracle
from pitscore.operators import binning, modeling, selection, tuning
from pitscore.operators.ensembles import coded_rows
from pitscore.operators.trees import codes_of


@pytest.mark.parametrize("name", sorted(learned_oracle.ORACLES))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    ours, theirs = learned.QUERIES[name](spark, small).toPandas(), con.sql(learned_oracle.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    assert canonical(ours).equals(canonical(theirs))


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(2)
    a, b, noise, noise2 = rng.random((4, 1200))
    y = (rng.random(1200) < 0.1 + 0.8 * (a + b > 1)).astype(int)
    rows = [(i, *map(float, r[:-1]), int(r[-1])) for i, r in enumerate(zip(a, b, noise, noise2, y, strict=True))]
    df = spark.createDataFrame(rows, "id int, a double, b double, noise double, noise2 double, y int")
    return df.withColumn("split", F.when(F.col("id") % 3 == 0, "test").otherwise("train"))


def column_fit(fits):
    """A model is a column's name; counts the fits on all rows."""

    def fit(family, params, rows):
        fits.append((params["column"], rows.count()))
        return params["column"], lambda df: df.withColumn("prob", F.col(params["column"]))

    return fit


CANDIDATES = [("column", {"column": c, "n": k}) for k in range(2) for c in ("noise", "a", "noise2", "b", "id")]


def test_halving_fits_few_on_all_rows(planted, tmp_path):
    train, test = planted.where("split = 'train'"), planted.where("split = 'test'")
    fits, log = [], str(tmp_path / "log")
    model, _, params, records = tuning.successive_halving(train, test, "y", ["id"], CANDIDATES, column_fit(fits), log_path=log, parallelism=1)
    aucs = {c: modeling.roc_auc(test.withColumn("prob", F.col(c)), "y", "prob").first()["auc"] for c in ("noise", "a", "noise2", "b", "id")}
    assert model == params["column"] == max(aucs, key=aucs.get)  # what a search over all of them finds
    sizes = [n for _, n in fits]
    assert len(fits) == 10 + 4 + 2 and sizes.count(train.count()) == 2 and sizes == sorted(sizes)
    rows = records.collect()
    assert sum(r.promoted for r in rows if r.rung == 0) == 4 and sum(r.promoted for r in rows if r.rung == 2) == 1
    # the log is enough to go on from: only the winner is fitted again
    again = []
    *_, params2, records2 = tuning.successive_halving(train, test, "y", ["id"], CANDIDATES, column_fit(again), log_path=log, parallelism=1)
    assert params2 == params and [c for c, _ in again] == [model]
    assert sorted(map(tuple, records2.collect())) == sorted(map(tuple, rows))


def test_smaller_samples_lie_within_larger_ones(planted):
    seen = []

    def fit(family, params, rows):
        seen.append({r.id for r in rows.select("id").collect()})
        return None, lambda df: df.withColumn("prob", F.col("a"))

    one = [("column", {})]
    tuning.successive_halving(planted, planted, "y", ["id"], one, fit, (0.05, 0.3, 1.0))
    assert seen[0] < seen[1] < seen[2] and 20 < len(seen[0]) < 110 and len(seen[2]) == 1200
    tuning.successive_halving(planted.repartition(7), planted, "y", ["id"], one, fit, (0.05, 0.3, 1.0))
    assert seen[:3] == seen[3:]


def test_halving_of_tree_families(planted):
    train, test = planted.where("split = 'train'"), planted.where("split = 'test'")
    space = {"iterations": (2, 3), "depth": (1, 2), "alpha": (0.0, 1.0, 0.5), "min_rows": (5, 20)}
    candidates = [("penalised", p) for p in modeling.draw_params(space, 2)] + [("budgeted", {"trees": 3, "depth": 2, "max_leaves": 3})]
    fit = tuning.tree_fit(["a", "b", "noise"], "y", budgeted={"keys": ["id"]})
    model, family, _, log = tuning.successive_halving(train, test, "y", ["id"], candidates, fit, (0.4, 1.0))
    best = log.where("rung = 1").first()
    auc = modeling.roc_auc(modeling.score(model, test), "y", "prob").first()["auc"]
    assert best.family == family and abs(best.value - auc) < 1e-12 and auc > 0.7


@pytest.mark.parametrize("fractions, eta", [((0.5,), 3), ((1.0, 0.5), 3), ((0.5, 1.0), 1)])
def test_halving_refuses_odd_settings(planted, fractions, eta):
    with pytest.raises(ValueError):
        tuning.successive_halving(planted, planted, "y", ["id"], CANDIDATES, column_fit([]), fractions, eta)


def test_promotion_of_ties_and_undefined_values():
    assert tuning.promoted([(0, 0.5), (1, 0.5), (2, float("-inf")), (3, 0.5)], 2) == [0, 1]
    assert tuning.promoted([(4, float("-inf"))], 3) == [4]


def test_two_step_verdicts(spark):
    hits = {"always": 20, "often": 15, "half": 10, "seldom": 4, "never": 0}
    got = selection.two_step(hits, 20)
    assert got == {"always": "confirmed", "often": "tentative", "half": "tentative", "seldom": "tentative", "never": "rejected"}
    # fifteen of twenty passes the step over features, not the one over rounds; a looser limit lets it pass
    assert selection.two_step(hits, 20, 0.5)["often"] == "confirmed"
    rows = [(f, h, float(h)) for f, h in hits.items()]
    for alpha in (0.05, 0.5):
        table = selection.verdict_table(spark.createDataFrame(rows, "features string, hits int, importance double"), 20, alpha)
        assert {r.features: r.decision for r in table.collect()} == selection.two_step(hits, 20, alpha)
    assert selection.two_step({}, 5) == {}


def test_shadows_need_no_exchange(spark, planted):
    table, _ = coded_rows(planted, ["a", "b", "noise"], "y", ["id"])
    shadowed = selection.with_shadows(table, [0, 2], 3, 1)
    plan = shadowed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    codes = np.concatenate([codes_of(b.column(b.schema.names.index("_codes")), 4) for b in shadowed.toArrow().to_batches()])
    whole = np.concatenate([codes_of(b.column(b.schema.names.index("_codes")), 3) for b in table.toArrow().to_batches()])
    assert (codes[:, :2] == whole[:, [0, 2]]).all()
    assert sorted(map(tuple, codes[:, 2:])) == sorted(map(tuple, codes[:, :2]))
    assert (codes[:, 2:] == codes[:, :2]).all(axis=1).mean() < 0.05
    assert codes.tobytes() == np.concatenate(
        [codes_of(b.column(b.schema.names.index("_codes")), 4) for b in shadowed.toArrow().to_batches()]
    ).tobytes()


@pytest.mark.parametrize("family, params", [("budgeted", {"trees": 5, "depth": 3}), ("penalised", {"iterations": 3, "depth": 2})])
def test_relevant_features_are_confirmed(planted, family, params):
    report = selection.all_relevant(planted, ["a", "noise", "b", "noise2"], "y", ["id"], 12, 0.3, family, **params)
    rows = {r.features: r for r in report.collect()}
    assert rows["a"].support and rows["b"].support and not rows["noise"].support and not rows["noise2"].support
    assert [r.rank for r in report.collect()] == sorted(r.rank for r in rows.values())
    assert selection.supported(report) == ["a", "b"]


def plain_prebins(pairs, depth=3, share=0.05):
    """Recursive best cuts over (value, class) pairs."""
    n = len(pairs)

    def impurity(rows):
        ones = sum(y for _, y in rows)
        return 2 * ones * (len(rows) - ones) / len(rows)

    def cut(rows, depth):
        best = None
        for v in sorted({x for x, _ in rows}):
            left, right = [r for r in rows if r[0] <= v], [r for r in rows if r[0] > v]
            if min(len(left), len(right)) >= max(share * n, 1):
                fall = round(impurity(rows) - impurity(left) - impurity(right), 9)
                if fall > 0 and (best is None or fall > best[0]):
                    best = (fall, left, right)
        if depth == 0 or best is None:
            return [rows]
        return cut(best[1], depth - 1) + cut(best[2], depth - 1)

    return [(min(r)[0], max(r)[0], sum(y for _, y in r), sum(1 - y for _, y in r)) for r in cut(pairs, depth)]


def test_supervised_prebins_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    parts = {"a": rng.normal(size=300).round(1), "b": rng.integers(0, 4, 200).astype(float), "c": np.zeros(50)}
    rows = [(g, float(x), int(rng.random() < 0.2 + 0.5 * (abs(x) > 1))) for g, v in parts.items() for x in v]
    df = spark.createDataFrame([*rows, ("b", None, 1), ("b", float("nan"), 0)], "g string, x double, y int").repartition(4)
    counts = binning.class_counts(df.where("x is not null and not isnan(x)"), "x", "y", ["g"]).withColumnRenamed("x", "score")
    got = binning.supervised_prebins(counts, ["g"]).orderBy("g", "prebin").collect()
    for g in parts:
        want = plain_prebins([(x, y) for h, x, y in rows if h == g])
        assert [(r.lo, r.hi, r.n1, r.n0) for r in got if r.g == g] == want
    wide = df.withColumn("z", F.col("x") * 2)
    iv = binning.iv_table(wide, ["x", "z"], "y", supervised=True).collect()
    assert abs(iv[0].iv - iv[1].iv) < 1e-9 and iv[0].iv > 0
    with pytest.raises(ValueError):
        binning.supervised_prebins(counts, ["g"], depth=5)
