"""Boosted trees with L1 and L2 penalties and dropout, and forests with a leaf budget.

Both grow on :mod:`pitscore.operators.trees`. What Spark ML's tree learners lack, and these have: leaf values
shrunk by a soft threshold (``alpha``) and a ridge (``lam``), dropout of earlier trees while boosting, class
weights taken from each bag, and trees limited to their most useful leaves.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from pitscore.operators.binning import fit_edges
from pitscore.operators.trees import CODES, Tree, best_first, code_matrix, codes_of, grow
from pitscore.operators.trees import coded as code_rows
from pitscore.sources.io import delete_path, materialize, scratch_path, share_package

#: Trees whose weight differs from the one in the stored margins, before these are written anew.
REFRESH = 8
_MARGIN, _Y, _W, _KEY = "_margin", "_y", "_w", "_key"
#: Chance of at most k draws of a row into a bag (Poisson with mean 1).
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


@dataclass(frozen=True)
class TreeModel:
    """Weighted trees over bin codes. ``kind`` is ``boosted`` (sum of leaf values, then the logistic function)
    or ``forest`` (mean of leaf values)."""

    kind: str
    features: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]
    params: dict = field(default_factory=dict)

    def raw(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out += weight * tree.value[tree.place(codes)]
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        raw = self.raw(codes)
        return 1 / (1 + np.exp(-raw)) if self.kind == "boosted" else raw

    def score(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` (0/1) and ``prob``; all other columns stay. Missing features go with a split's
        left side."""
        share_package(df.sparkSession)
        base = df.drop("prediction", "prob")
        names, n = base.columns, len(base.columns)
        schema = StructType([*base.schema.fields, StructField("prediction", IntegerType()), StructField("prob", DoubleType())])
        values = [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(self.features)]

        def run(batches):
            for batch in batches:
                prob = self.probability(code_matrix(batch.columns[n:], self.edges))
                made = [pa.array(prob > 0.5).cast(pa.int32()), pa.array(prob)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [*names, "prediction", "prob"])

        return base.select("*", *values).mapInArrow(run, schema)

    def importances(self) -> list[float]:
        """Share of each feature in the gain of all splits; a forest's trees count alike."""
        total = np.zeros(len(self.features))
        for tree in self.trees:
            inner = tree.feature >= 0
            own = np.bincount(tree.feature[inner], tree.gain[inner], len(total))
            total += own / own.sum() if self.kind == "forest" and own.sum() else own
        return (total / total.sum() if total.sum() else total).tolist()

    def nodes(self, spark: SparkSession) -> DataFrame:
        """``tree, node, feature, threshold, gain, stats, value``: a row per node; leaves have no feature. A row
        goes left if its value is at most the threshold or missing (threshold null: only if missing)."""
        rows = []
        for t, tree in enumerate(self.trees):
            for n in sorted(tree.stats):
                f, cut = int(tree.feature[n]), int(tree.cut[n])
                edge = float(self.edges[f][cut - 1]) if f >= 0 and cut else None
                leaf = f < 0
                rows.append((t, n, None if leaf else self.features[f], edge, float(tree.gain[n]), [float(x) for x in tree.stats[n]], float(tree.value[n]) if leaf else None))
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, gain double, stats array<double>, value double")

    def save(self, spark: SparkSession, path: str) -> None:
        held = {k: getattr(self, k) for k in ("kind", "features", "edges", "weights", "params")}
        held["trees"] = [t.as_dict() for t in self.trees]
        spark.createDataFrame([(json.dumps(held),)], "model string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        d = json.loads(spark.read.text(path).first()[0])
        trees = tuple(Tree.from_dict(t) for t in d["trees"])
        return cls(d["kind"], tuple(d["features"]), tuple(map(tuple, d["edges"])), trees, tuple(d["weights"]), d["params"])


def _prepared(df: DataFrame, features: Sequence[str], target: str, max_bins: int, edges, extra: dict) -> tuple[DataFrame, tuple]:
    """Rows of either class as ``_y``, the extra columns and codes."""
    share_package(df.sparkSession)
    rows = df.filter(F.col(target).isin(0, 1)).withColumn(_Y, F.col(target).cast("double"))
    if edges is None:
        found = fit_edges(rows, features, target, max_bins, accuracy=10_000)
        edges = tuple(tuple(found[f]) for f in features)
    rows = rows.withColumns({k: v for k, v in extra.items() if k != _Y})
    return code_rows(rows, features, edges, [_Y, *extra]), edges


def _columns(features, edges) -> tuple[tuple, tuple]:
    return tuple(features), tuple(map(tuple, edges))


def coded_rows(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], max_bins: int = 64, edges=None) -> tuple[DataFrame, tuple]:
    """Rows of either class, ready for both learners as their ``coded`` argument: class, hash of the keys, balanced weight and codes."""
    y, key = F.col(target), F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
    rows = df.filter(y.isin(0, 1))
    return _prepared(rows, features, target, max_bins, edges, {_KEY: key, _W: _balanced(rows, target), _MARGIN: F.lit(0.0)})


def _balanced(rows: DataFrame, target: str):
    n1, n0 = rows.agg(F.count_if(F.col(target) == 1), F.count_if(F.col(target) == 0)).first()
    share = (n1 + n0) / max(1, (n1 > 0) + (n0 > 0))
    return F.when(F.col(target) == 1, share / max(1, n1)).otherwise(share / max(1, n0))


def soft(g, alpha: float):
    """Gradient after the L1 penalty: drawn ``alpha`` towards 0."""
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def leaf_value(g, h, alpha: float, lam: float):
    return -soft(g, alpha) / np.maximum(h + lam, 1e-300)


def _penalised_gain(alpha: float, lam: float, min_rows: int):
    def quality(g, h):
        return soft(g, alpha) ** 2 / np.maximum(h + lam, 1e-300)

    def judge(tree, node, left, total):
        right = total[:, None] - left
        gain = 0.5 * (quality(left[0], left[1]) + quality(right[0], right[1]) - quality(total[0], total[1]))
        return np.where((left[2] >= min_rows) & (right[2] >= min_rows), gain, -np.inf)

    return judge


def fit_boosted(
    df: DataFrame, features: Sequence[str], target: str, iterations: int = 100, depth: int = 6, rate: float = 0.1,
    alpha: float = 0.0, lam: float = 0.0, min_rows: int = 20, drop: float = 0.0, max_bins: int = 64, seed: int = 7,
    edges: Sequence[Sequence[float]] | None = None, balanced: bool = True, coded: DataFrame | None = None,
) -> TreeModel:
    """Gradient boosting of the log-loss, level by level, with balanced class weights.

    A leaf holds ``-S(G) / (H + lam)``, S the soft threshold at ``alpha``; a split's gain is half the growth of
    ``S(G)**2 / (H + lam)``. With ``drop``, each earlier tree is left out of a round by that chance; with k left
    out, the new tree enters with ``rate / (k + 1)`` and those keep ``k / (k + 1)`` of their weight. Rows of
    targets other than 0 and 1 are passed by; missing values have a bin of their own. Edges come from quantile
    sketches unless given; ``coded`` is a table from :func:`coded_rows` to use instead of ``df``. An iteration costs a
    job per level; without any split the model stays at one half.

    A row's margin is stored for the tree weights of some round. What has changed since is added up in the
    tasks, and after ``REFRESH`` changes the margins are written anew and the old table goes.
    """
    if coded is None:
        rows = df.filter(F.col(target).isin(0, 1))
        weight = _balanced(rows, target) if balanced else F.lit(1.0)
        coded, edges = _prepared(rows, features, target, max_bins, edges, {_W: weight, _MARGIN: F.lit(0.0)})
    spark, n_features = coded.sparkSession, len(features)
    path = scratch_path(spark, "margins")
    coded.select(_Y, _W, _MARGIN, CODES).write.parquet(path)
    table = spark.read.parquet(path)
    rng, trees = random.Random(seed), []
    weights: list[float] = []
    stored: list[float] = []
    bins = max(map(len, edges), default=0) + 2
    judge = _penalised_gain(alpha, lam, min_rows)

    def margins(codes, held, changes):
        out = held.to_numpy(zero_copy_only=False).copy()
        for tree, change in changes:
            out += change * tree.value[tree.place(codes)]
        return out

    for _ in range(iterations):
        dropped = [t for t in range(len(trees)) if rng.random() < drop] if drop else []
        now = [0.0 if t in dropped else w for t, w in enumerate(weights)]
        changes = [(trees[t], now[t] - stored[t]) for t in range(len(trees)) if now[t] != stored[t]]

        def rows_of(state, changes=changes):
            tree = state[0]

            def rows(codes, columns):
                y, w = (c.to_numpy(zero_copy_only=False) for c in columns[:2])
                p = 1 / (1 + np.exp(-margins(codes, columns[2], changes)))
                yield 0, tree.place(codes), [w * (p - y), w * p * (1 - p), np.ones(len(y))]

            return rows

        (tree,) = grow(table, [_Y, _W, _MARGIN], n_features, bins, [Tree(depth)], rows_of, judge)
        for n in tree.leaves():
            if n in tree.stats:
                tree.value[n] = leaf_value(*tree.stats[n][:2], alpha, lam)
        k = len(dropped)
        for t in dropped:
            weights[t] *= k / (k + 1)
        trees.append(tree)
        weights.append(rate / (k + 1))
        stored.append(0.0)
        changes = [(trees[t], weights[t] - stored[t]) for t in range(len(trees)) if weights[t] != stored[t]]
        if len(changes) >= REFRESH and len(trees) < iterations:
            table, path = _refreshed(table, path, n_features, margins, changes)
            stored = list(weights)
    delete_path(spark, path)
    params = {"alpha": alpha, "lam": lam, "rate": rate, "drop": drop, "depth": depth, "min_rows": min_rows}
    return TreeModel("boosted", *_columns(features, edges), tuple(trees), tuple(weights), params)


def _refreshed(table: DataFrame, path: str, n_features: int, margins, changes) -> tuple[DataFrame, str]:
    spark, names = table.sparkSession, [_Y, _W, _MARGIN, CODES]

    def run(batches):
        for batch in batches:
            y, w, held, raw = batch.columns
            yield pa.RecordBatch.from_arrays([y, w, pa.array(margins(codes_of(raw, n_features), held, changes)), raw], names)

    fresh = scratch_path(spark, "margins")
    schema = f"{_Y} double, {_W} double, {_MARGIN} double, {CODES} binary"
    table.select(*names).mapInArrow(run, schema).write.parquet(fresh)
    delete_path(spark, path)
    return spark.read.parquet(fresh), fresh


def _bag(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's bag, by its key and the tree alone."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(float) / float(1 << 53), side="right").astype(float)


def _class_weights(total, balanced: bool) -> tuple[float, float]:
    c0, c1 = total[0], total[1]
    if not balanced:
        return 1.0, 1.0
    classes = max(1, (c0 > 0) + (c1 > 0))
    return tuple((c0 + c1) / (classes * c) if c > 0 else 0.0 for c in (c0, c1))


def fit_forest(
    df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], trees: int = 30, depth: int = 5,
    max_leaves: int | None = None, min_rows: int = 1, min_gain: float = 0.0, subset: str | int | None = "sqrt",
    bootstrap: bool = True, balanced: bool = True, max_bins: int = 64, seed: int = 7,
    edges: Sequence[Sequence[float]] | None = None, coded: DataFrame | None = None,
) -> TreeModel:
    """Random forest by Gini impurity, all trees grown side by side: a job per level for the whole forest.

    A row is in a tree's bag as often as a Poisson draw by its ``keys`` and the tree says, so bags do not depend
    on the partitioning. With ``balanced``, classes weigh the same within each bag. ``min_gain`` is the least
    weighted decrease of impurity relative to the bag, ``min_rows`` counts distinct rows of the bag.
    ``max_leaves`` keeps the splits of largest gain, opened from the root. A node tries ``subset`` features
    (``sqrt``, a number, or all if None), drawn by seed, tree and node. A leaf holds the weighted share of 1s.
    """
    table = coded
    if coded is None:
        key = F.xxhash64(*keys) if keys else F.lit(0).cast("bigint")
        table, edges = _prepared(df, features, target, max_bins, edges, {_KEY: key})
        table = materialize(table)
    n = len(features)
    size = n if subset is None else max(1, int(math.sqrt(n))) if subset == "sqrt" else min(n, int(subset))
    weights: dict[int, tuple[float, float]] = {}

    def rows_of(state):
        def rows(codes, columns):
            y = columns[0].to_numpy(zero_copy_only=False)
            row_keys = columns[1].to_numpy(zero_copy_only=False).view(np.uint64)
            for t, tree in enumerate(state):
                w = _bag(row_keys, t, seed) if bootstrap else np.ones(len(y))
                yield t, tree.place(codes), [w * (y == 0), w * (y == 1), (w > 0).astype(float)]

        return rows

    def judge(tree, node, left, total):
        w0, w1 = weights[tree] if tree in weights else _class_weights(total, balanced)
        root = sums.get(tree, total[0] * w0 + total[1] * w1)

        def impurity(c0, c1):  # times the weight
            whole = w0 * c0 + w1 * c1
            return 2 * w0 * c0 * w1 * c1 / np.maximum(whole, 1e-300)

        right = total[:, None] - left
        fall = impurity(total[0], total[1]) - impurity(left[0], left[1]) - impurity(right[0], right[1])
        return np.where((left[2] >= min_rows) & (right[2] >= min_rows), fall / max(root, 1e-300), -np.inf)

    sums: dict[int, float] = {}

    def seen(tree, total):
        weights[tree] = _class_weights(total, balanced)
        sums[tree] = total[0] * weights[tree][0] + total[1] * weights[tree][1]

    def drawn(tree, node):
        return frozenset(range(n) if size >= n else random.Random(f"{seed}:{tree}:{node}").sample(range(n), size))

    bins = max(map(len, edges), default=0) + 2
    grown = grow(table, [_Y, _KEY], n, bins, [Tree(depth) for _ in range(trees)], rows_of, judge, min_gain, drawn if size < n else None, seen)
    for t, tree in enumerate(grown):
        if max_leaves is not None:
            best_first(tree, max_leaves)
        for leaf in tree.leaves():
            c0, c1 = tree.stats.get(leaf, (0.0, 0.0))[:2]
            w0, w1 = weights.get(t, (1.0, 1.0))
            tree.value[leaf] = w1 * c1 / (w0 * c0 + w1 * c1) if w0 * c0 + w1 * c1 else 0.5
    params = {"depth": depth, "max_leaves": max_leaves, "min_rows": min_rows, "min_gain": min_gain, "trees": trees}
    return TreeModel("forest", *_columns(features, edges), tuple(grown), (1 / max(trees, 1),) * trees, params)
