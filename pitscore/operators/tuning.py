"""Successive halving: a search that learns from its trials where to spend its fits.

All candidates are fitted on a small sample, the best go on to a larger one, and only the last few see all
rows. A row is in the sample of a fraction if the hash of its keys says so, so smaller samples lie within
larger ones. Every trial is judged by the exact metric on the held-out rows. The log is a table; a search that
finds its own log goes on from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore.functions.columns import hash_permille
from pitscore.operators.modeling import OBJECTIVES, SEED, score, train
from pitscore.sources.io import materialize

LOG_SCHEMA = "rung int, trial int, family string, params string, fraction double, value double, promoted boolean"
#: Shares of the training rows that the rungs fit on, and of each rung's trials the part (1 / ETA) that goes on.
FRACTIONS, ETA = (0.111, 0.333, 1.0), 3

_NOT_FITTED = object()

#: Fits a family's setting on rows and returns the model and what adds ``prob`` to a frame.
Fit = Callable[[str, dict, DataFrame], tuple[object, Callable[[DataFrame], DataFrame]]]


def tree_fit(features: Sequence[str], target: str, **fixed) -> Fit:
    """Fits any family of :func:`pitscore.operators.modeling.train`; ``fixed`` holds parameters by family."""

    def fit(family, params, rows):
        model = train(rows, features, target, family, **fixed.get(family, {}), **params)
        return model, lambda df: score(model, df)

    return fit


def _as_text(params: dict) -> str:
    return json.dumps(params, sort_keys=True)


def _read_log(spark: SparkSession, path: str | None) -> dict:
    """Values of the trials in a log, by fraction, family and parameters; none where there is no log yet."""
    if path is None:
        return {}
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return {}
    rows = spark.read.schema(LOG_SCHEMA).parquet(path).collect()
    return {(r.fraction, r.family, r.params): r.value for r in rows}


def promoted(values: Sequence[tuple[int, float]], eta: int) -> list[int]:
    """Of ``(trial, value)`` pairs the best ``1 / eta``, at least one; of equal values the first trials."""
    ranked = sorted(values, key=lambda v: (-v[1], v[0]))
    return sorted(t for t, _ in ranked[: -(-len(ranked) // eta)])


def successive_halving(
    train_rows: DataFrame,
    held_out: DataFrame,
    target: str,
    keys: Sequence[str],
    candidates: Sequence[tuple[str, dict]],
    fit: Fit,
    fractions: Sequence[float] = FRACTIONS,
    eta: int = ETA,
    metric: str = "auc",
    seed: int = SEED,
    log_path: str | None = None,
    parallelism: int = 4,
) -> tuple[object, str, dict, DataFrame]:
    """The best candidate's model, family, parameters, and the log (``LOG_SCHEMA``, a row per fit).

    ``candidates`` are families with settings, as from ``draw_params``. Fractions must rise and end with 1;
    they count in thousandths. With n candidates about n / eta reach the second rung, n / eta**2 the third:
    only those are fitted on all rows, where a random search fits all n. ``log_path`` names a folder that
    holds the log, a part per rung, written when the rung is done: fits found there are not repeated.
    A metric that is undefined (one class only) counts as the worst.
    """
    fractions = list(fractions)
    if not candidates or eta < 2 or fractions[-1] != 1 or any(a >= b for a, b in zip(fractions, fractions[1:], strict=False)):
        raise ValueError("needs candidates, eta of two or more, and fractions that rise to 1")
    spark, judge = train_rows.sparkSession, OBJECTIVES[metric]
    share = hash_permille(keys, seed)
    samples = [train_rows]
    for f in reversed(fractions[:-1]):  # each cut from the next larger one
        samples.insert(0, materialize(samples[0].filter(share < round(1000 * f))))
    known, records, models = _read_log(spark, log_path), [], {}
    alive = list(range(len(candidates)))

    for rung, (fraction, rows) in enumerate(zip(fractions, samples, strict=True)):

        def run(trial, fraction=fraction, rows=rows):
            family, params = candidates[trial]
            key = (fraction, family, _as_text(params))
            if key in known:
                return known[key], _NOT_FITTED
            model, scored = fit(family, params, rows)
            found = judge(scored(held_out), target, "prob").first()
            value = float("-inf") if found is None or found[metric] is None else float(found[metric])
            return value, model

        with ThreadPool(min(parallelism, len(alive))) as pool:
            found = pool.map(run, alive)
        last = rung == len(fractions) - 1
        kept = promoted([(t, v) for t, (v, _) in zip(alive, found, strict=True)], len(alive) if last else eta)
        own = [(rung, t, candidates[t][0], _as_text(candidates[t][1]), fraction, v, t in kept) for t, (v, _) in zip(alive, found, strict=True)]
        records += own
        models = {t: m for t, (_, m) in zip(alive, found, strict=True) if t in kept}
        if log_path is not None:
            spark.createDataFrame(own, LOG_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{log_path}/part={rung}")
        alive = kept
    (winner,) = alive
    family, params = candidates[winner]
    model = models[winner]
    if model is _NOT_FITTED:
        model, _ = fit(family, params, train_rows)
    return model, family, params, spark.createDataFrame(records, LOG_SCHEMA)
