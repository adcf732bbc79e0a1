"""Training, scoring and search of tree classifiers with Spark ML."""

from __future__ import annotations

import random
import threading
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.operators.ensembles import TreeModel, fit_boosted, fit_forest
from pitscore.operators.metrics import average_precision, roc_auc

SEED = 7
FEATURES = "_features"
WEIGHT = "_weight"
_ML_COLUMNS = ["rawPrediction", "probability", FEATURES, WEIGHT]

# Search ranges as (low, high) for whole numbers and (low, high, step) for fractions.
SEARCH_SPACES = {
    "capped": {
        "forest": {
            "maxDepth": (2, 5),
            "minInfoGain": (0.0, 1.0, 0.1),
            "minInstancesPerNode": (10, 60),
            "numTrees": (30, 50),
        },
        "boosted": {"maxDepth": (2, 10), "maxIter": (5, 150), "minInstancesPerNode": (50, 15000)},
    },
    "all_variables": {
        "boosted": {"maxDepth": (5, 12), "maxIter": (50, 1000), "minInstancesPerNode": (1000, 25000)},
        "forest": {
            "maxDepth": (5, 14),
            "minInfoGain": (0.0, 1.0, 0.1),
            "minInstancesPerNode": (10, 60),
            "numTrees": (25, 50),
        },
    },
    "selected": {
        "boosted": {"maxDepth": (2, 5), "maxIter": (50, 1000), "minInstancesPerNode": (1000, 25000)},
        "forest": {
            "maxDepth": (5, 14),
            "minInfoGain": (0.0, 1.0, 0.1),
            "minInstancesPerNode": (10, 60),
            "numTrees": (25, 50),
        },
    },
    "penalised": {
        "penalised": {
            "alpha": (0.0, 1.0, 0.025),
            "depth": (5, 12),
            "drop": (0.0, 0.1, 0.1),
            "iterations": (50, 1000),
            "lam": (0.0, 1.0, 0.025),
            "min_rows": (1000, 25000),
        },
        "budgeted": {
            "depth": (5, 14),
            "max_leaves": (10, 40),
            "min_gain": (0.0, 1.0, 0.1),
            "min_rows": (10, 60),
            "trees": (25, 50),
        },
    },
}


def with_balanced_weight(df: DataFrame, target: str, name: str = WEIGHT) -> DataFrame:
    """Row weight ``n / (classes * n_class)``, so classes weigh the same. Targets other than 0 and 1, NULL
    too, are no class and get no weight. Two counts reach the driver."""
    y = F.col(target)
    n1, n0 = df.agg(F.count_if(y == 1), F.count_if(y == 0)).first()
    classes = (n1 > 0) + (n0 > 0)
    weight = F.when(y == 1, (n1 + n0) / max(1, classes * n1)).when(y == 0, (n1 + n0) / max(1, classes * n0))
    return df.withColumn(name, weight.cast("double"))


def assembler(features: Sequence[str]) -> VectorAssembler:
    """Feature vector; rows with missing values are kept (fill them first to treat them as 0)."""
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES, handleInvalid="keep")


def classifier(family: str, target: str, **params):
    common = {"featuresCol": FEATURES, "labelCol": target, "weightCol": WEIGHT, "seed": SEED}
    if family == "boosted":
        return GBTClassifier(**common, **params)
    if family == "forest":
        return RandomForestClassifier(**common, **params)
    raise ValueError(f"unknown family {family!r}; use 'boosted' or 'forest'")


#: Families grown by this library instead of Spark ML.
GROWN = {"penalised": fit_boosted, "budgeted": fit_forest}


def train(
    df: DataFrame, features: Sequence[str], target: str, family: str = "boosted", **params
) -> PipelineModel | TreeModel:
    """Fit a tree classifier with balanced class weights. The fit reads ``df`` several times: pass a
    materialized table. Families: ``boosted`` and ``forest`` (Spark ML), ``penalised`` (boosting with L1, L2
    and dropout) and ``budgeted`` (a forest with a leaf budget and weights per bag; takes ``keys``)."""
    if family in GROWN:
        return GROWN[family](df, features, target, **params)
    weighted = with_balanced_weight(df.filter(F.col(target).isin(0, 1)), target)
    return Pipeline(stages=[assembler(features), classifier(family, target, **params)]).fit(weighted)


def score(model: PipelineModel | TreeModel, df: DataFrame) -> DataFrame:
    """Add ``prediction`` (0/1) and ``prob`` (probability of 1); ids stay in the row."""
    if isinstance(model, TreeModel):
        return model.score(df)
    out = model.transform(df).withColumn("prob", vector_to_array("probability")[1])
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop(*_ML_COLUMNS)


def importances(model: PipelineModel | TreeModel, features: Sequence[str], digits: int | None = 2) -> DataFrame:
    """``name, importance``, highest first (one row per feature)."""
    from pyspark.sql import SparkSession

    values = model.importances() if isinstance(model, TreeModel) else model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    out = SparkSession.getActiveSession().createDataFrame(rows, "name string, importance double")
    if digits is not None:
        out = out.withColumn("importance", F.round("importance", digits))
    return out.orderBy(F.col("importance").desc(), "name")


def draw_params(space: dict, trials: int, seed: int = SEED) -> list[dict]:
    """``trials`` random settings from a space. The same space and seed give the same settings for any
    table; pass a space whose leaf sizes suit the data."""
    rng = random.Random(seed)
    out = []
    for _ in range(trials):
        params = {}
        for name, (low, high, *step) in sorted(space.items()):
            if step:
                params[name] = round(low + step[0] * rng.randint(0, round((high - low) / step[0])), 10)
            else:
                params[name] = rng.randint(low, high)
        out.append(params)
    return out


OBJECTIVES = {"auc": roc_auc, "average_precision": average_precision}


def search(
    train_rows: DataFrame,
    held_out: DataFrame,
    features: Sequence[str],
    target: str,
    space: str | dict = "all_variables",
    families: Sequence[str] = ("boosted",),
    trials: int = 10,
    metric: str = "auc",
    parallelism: int = 4,
    seed: int = SEED,
) -> tuple[PipelineModel, str, dict, list[tuple]]:
    """Random search: fit every drawn setting on ``train_rows``, keep the best on ``held_out``.

    ``metric`` is ``auc`` or ``average_precision``, computed from exact running counts as everywhere else
    in this library. Both frames are read once per fit, so pass materialized tables. Fits run side by side
    as Spark jobs; besides those under way only the best model so far is kept. Of equally good trials the
    first wins. Returns model, family, parameters and ``(trial, family, params, metric)`` records.
    """
    spaces = SEARCH_SPACES[space] if isinstance(space, str) else space
    judge = OBJECTIVES[metric]
    to_vector = assembler(features)
    weighted = with_balanced_weight(train_rows.filter(F.col(target).isin(0, 1)), target)
    fit_rows, check_rows = to_vector.transform(weighted), to_vector.transform(held_out)
    jobs = []
    for k, family in enumerate(families):
        share = trials // len(families) + (1 if k < trials % len(families) else 0)
        jobs += [(family, p) for p in draw_params(spaces[family], share, seed + k)]
    best, lock = [], threading.Lock()

    def run(trial):
        family, params = jobs[trial]
        fitted = classifier(family, target, **params).fit(fit_rows)
        scored = fitted.transform(check_rows).select(target, vector_to_array("probability")[1].alias("prob"))
        found = judge(scored, target, "prob").first()
        value = float("-inf") if found is None or found[metric] is None else found[metric]
        with lock:
            if not best or (value, -trial) > best[0][:2]:
                best[:] = [(value, -trial, fitted)]
        return value

    with ThreadPool(min(parallelism, len(jobs))) as pool:
        values = pool.map(run, range(len(jobs)))
    log = [(i, f, p, v) for i, ((f, p), v) in enumerate(zip(jobs, values, strict=True))]
    _, trial, model = best[0]
    return PipelineModel([to_vector, model]), *jobs[-trial], log
