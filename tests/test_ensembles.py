"""Histogram-grown trees against plain fits on the values themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscore.operators import ensembles as E
from pitscore.operators.trees import Tree, best_first

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(3)
    n = 600
    x = np.stack([rng.integers(0, 9, n), rng.integers(0, 6, n), rng.normal(size=n).round(1)], axis=1).astype(float)
    x[rng.random(n) < 0.1, 0] = np.nan
    y = (np.nan_to_num(x[:, 0], nan=4) + 2 * (x[:, 1] > 3) + rng.normal(size=n) > 5).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark, points):
    x, y = points
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), int(t), "k") for i, (r, t) in enumerate(zip(x, y, strict=True))]
    rows += [(-1, 1.0, 1.0, 1.0, None, "k"), (-2, 1.0, 1.0, 1.0, 2, "k")]  # no class
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y int, prob string").repartition(5)


def below(x, f, edge):
    return np.isnan(x[:, f]) | (x[:, f] <= edge) if edge is not None else np.isnan(x[:, f])


def plain_tree(x, stats, gain, depth, node=0, rows=None, least=0.0):
    """{node: (feature, edge, gain)} and the rows of every leaf."""
    rows = np.arange(len(x)) if rows is None else rows
    best = None
    for f in range(x.shape[1]):
        values = x[rows, f]
        for edge in [None, *np.unique(values[~np.isnan(values)])]:
            left = below(x[rows], f, edge)
            g = gain(stats[:, rows[left]].sum(axis=1), stats[:, rows[~left]].sum(axis=1))
            if g > -np.inf and (best is None or g > best[0] + 1e-9):
                best = (g, f, edge, left)
    if depth == 0 or best is None or best[0] <= least:
        return {}, {node: rows}
    g, f, edge, left = best
    splits, leaves = {node: (f, edge, g)}, {}
    for child, own in ((2 * node + 1, rows[left]), (2 * node + 2, rows[~left])):
        s, lv = plain_tree(x, stats, gain, depth - 1, child, own, least)
        splits |= s
        leaves |= lv
    return splits, leaves


def plain_boosting(x, y, rounds, depth, rate, alpha, lam, min_rows, dropped=lambda r, n: []):
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))

    def quality(s):
        return max(abs(s[0]) - alpha, 0) ** 2 / (s[1] + lam)

    def gain(a, b):
        return -np.inf if min(a[2], b[2]) < min_rows else 0.5 * (quality(a) + quality(b) - quality(a + b))

    outs, weights = [], []
    for r in range(rounds):
        gone = dropped(r, len(outs))
        margin = sum((w_ * o for t, (w_, o) in enumerate(zip(weights, outs, strict=True)) if t not in gone), np.zeros(len(y)))
        p = 1 / (1 + np.exp(-margin))
        stats = np.stack([w * (p - y), w * p * (1 - p), np.ones(len(y))])
        _, leaves = plain_tree(x, stats, gain, depth)
        out = np.zeros(len(y))
        for rows in leaves.values():
            g, h, _ = stats[:, rows].sum(axis=1)
            out[rows] = -math.copysign(max(abs(g) - alpha, 0), g) / (h + lam)
        outs.append(out)
        k = len(gone)
        weights = [v * k / (k + 1) if t in gone else v for t, v in enumerate(weights)] + [rate / (k + 1)]
    return 1 / (1 + np.exp(-sum(v * o for v, o in zip(weights, outs, strict=True))))


def exact_edges(x):
    return [np.unique(x[~np.isnan(x[:, f]), f]).tolist() for f in range(x.shape[1])]


def scores(model, table):
    rows = model.score(table.where("id >= 0")).orderBy("id").collect()
    return np.array([r.prob for r in rows]), np.array([r.prediction for r in rows])


@pytest.mark.parametrize("alpha, lam, min_rows", [(0.0, 0.0, 5), (3.0, 10.0, 20)])
def test_boosting_equals_plain_fit(table, points, alpha, lam, min_rows):
    x, y = points
    model = E.fit_boosted(table, FEATURES, "y", 3, 3, 0.3, alpha, lam, min_rows, edges=exact_edges(x))
    prob, label = scores(model, table)
    want = plain_boosting(x, y, 3, 3, 0.3, alpha, lam, min_rows)
    assert np.allclose(prob, want)
    assert (label == (want > 0.5)).all() and (label == y).mean() > 0.8


def test_dropout_and_rewritten_margins_equal_plain_fit(table, points, monkeypatch):
    monkeypatch.setattr(E, "REFRESH", 2)
    x, y = points
    rng = E.random.Random(5)
    gone = [[t for t in range(r) if rng.random() < 0.4] for r in range(6)]
    model = E.fit_boosted(table, FEATURES, "y", 6, 2, 0.5, 0.5, 1.0, 10, drop=0.4, seed=5, edges=exact_edges(x))
    assert any(gone) and np.allclose(scores(model, table)[0], plain_boosting(x, y, 6, 2, 0.5, 0.5, 1.0, 10, lambda r, n: gone[r]))


def test_penalties_shrink_leaves(table, points):
    edges = exact_edges(points[0])
    sizes = []
    for alpha, lam in ((0, 0), (0, 50), (20, 0), (20, 50), (1e6, 0)):
        (tree,) = E.fit_boosted(table, FEATURES, "y", 1, 1, 1.0, alpha, lam, 5, edges=edges).trees
        sizes.append(max(abs(tree.value)))
    assert sizes[0] > sizes[1] > sizes[3] and sizes[0] > sizes[2] > sizes[3] > sizes[4] == 0


def gini(w0, w1, whole, min_rows):
    def impurity(s):
        a, b = w0 * s[0], w1 * s[1]
        return 2 * a * b / (a + b) if a + b else 0.0

    def gain(a, b):
        return -np.inf if min(a[2], b[2]) < min_rows else (impurity(a + b) - impurity(a) - impurity(b)) / whole

    return gain


@pytest.mark.parametrize("max_leaves", [None, 5])
def test_forest_equals_plain_trees(table, points, max_leaves):
    x, y = points
    model = E.fit_forest(table, FEATURES, "y", ["id"], 1, 4, max_leaves, 8, subset=None, bootstrap=False, edges=exact_edges(x))
    w0, w1 = len(y) / (2 * (y == 0).sum()), len(y) / (2 * y.sum())
    stats = np.stack([y == 0, y == 1, np.ones(len(y))]).astype(float)
    splits, leaves = plain_tree(x, stats, gini(w0, w1, len(y), 8), 4)
    if max_leaves:
        kept, front = set(), [0]
        while len(kept) + 1 < max_leaves:
            node = max((n for n in front if n in splits), key=lambda n: splits[n][2])
            kept.add(node)
            front = [n for n in front if n != node] + [2 * node + 1, 2 * node + 2]
        splits = {n: s for n, s in splits.items() if n in kept}
    (tree,) = model.trees
    assert set(np.flatnonzero(tree.feature >= 0)) == set(splits)
    if max_leaves is None:
        prob = scores(model, table)[0]
        for rows in leaves.values():
            c0, c1 = (y[rows] == 0).sum() * w0, y[rows].sum() * w1
            assert np.allclose(prob[rows], c1 / (c0 + c1))
    else:
        assert len(tree.leaves()) == max_leaves


def test_bags_have_their_own_weights_and_budget(spark, table, points):
    x, y = points
    model = E.fit_forest(table, FEATURES, "y", ["id"], 6, 6, 10, 3, edges=exact_edges(x))
    keys = table.where("id >= 0").orderBy("id").select(F.xxhash64("id")).toPandas().values[:, 0].view(np.uint64)
    codes = np.stack([E.code_matrix([E.pa.array(x[:, f])], [exact_edges(x)[f]])[:, 0] for f in range(3)], axis=1)
    for t, tree in enumerate(model.trees):
        bag = E._bag(keys, t, 7)
        assert 0.8 < bag.mean() < 1.2 and len(tree.leaves()) <= 10
        c0, c1 = bag[y == 0].sum(), bag[y == 1].sum()
        assert tree.stats[0][:2] == (c0, c1)
        place = tree.place(codes)
        for leaf in tree.leaves():
            own = place == leaf
            a, b = bag[own & (y == 0)].sum(), bag[own & (y == 1)].sum()
            assert tuple(tree.stats[leaf]) == (a, b, (bag[own] > 0).sum())
            assert np.isclose(tree.value[leaf], b / c1 / (a / c0 + b / c1))
    assert len({tuple(t.feature) for t in model.trees}) > 1
    again = E.fit_forest(table.repartition(2), FEATURES, "y", ["id"], 6, 6, 10, 3, edges=exact_edges(x))
    assert np.allclose(scores(model, table)[0], scores(again, table)[0])


def test_edges_from_sketches(table, points):
    x, y = points
    model = E.fit_boosted(table, FEATURES, "y", 1, 2, min_rows=5, max_bins=32)
    assert model.edges[0] == tuple(range(9)) and model.edges[1] == tuple(range(6))


def test_models_are_stored_and_edge_tables_fit(spark, table, points, tmp_path):
    model = E.fit_boosted(table, FEATURES, "y", 2, 2, min_rows=5)
    model.save(spark, str(tmp_path / "m"))
    back = E.TreeModel.load(spark, str(tmp_path / "m"))
    assert np.array_equal(scores(model, table)[0], scores(back, table)[0])
    assert abs(sum(model.importances()) - 1) < 1e-9 and model.nodes(spark).where("feature is not null").count() > 0
    scored = model.score(table)
    assert scored.columns == ["id", "a", "b", "c", "y", "prediction", "prob"]
    for rows in (table.limit(0), table.where("y = 1"), table.where("id < 0")):
        assert scores(E.fit_boosted(rows, FEATURES, "y", 2, 2), table)[0].shape == (600,)
        assert scores(E.fit_forest(rows, FEATURES, "y", ["id"], 2, 2), table)[0].shape == (600,)


def test_best_first_opens_by_gain():
    tree = Tree(2)
    tree.feature[:3], tree.gain[:3] = 0, [0.5, 0.1, 0.3]
    tree.stats = {n: (1, 1, 1) for n in range(7)}
    assert best_first(tree, 3).leaves() == [1, 5, 6] and set(tree.stats) == {0, 1, 2, 5, 6}
