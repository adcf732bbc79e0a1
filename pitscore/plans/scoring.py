"""Feature ranking, training, evaluation and risk groups over a model table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.functions import vocabulary as V
from pitscore.operators import metrics as M
from pitscore.operators.binning import feature_names, fit_splits, iv_table, risk_group
from pitscore.operators.modeling import importances, score, search, train
from pitscore.operators.profile import event_rate
from pitscore.operators.rows import features_except, fill_numeric
from pitscore.operators.selection import shadow_selection, supported
from pitscore.operators.splits import assign_splits
from pitscore.sources.io import materialize, metric_rows, param_rows, trial_rows

KEYS = ["date", "id_cnpj", "ticker"]
TARGET = "cat_target"
PERIOD = "dt_month"


def training_table(
    model_table: DataFrame, first_year: int = 2022, keys: Sequence[str] = tuple(KEYS), fill: bool = True
) -> DataFrame:
    """Recent years, missing numbers as 0, and a ``split`` column (train, test, out, unused)."""
    recent = model_table.filter(F.col("dt_year") >= first_year)
    return assign_splits(fill_numeric(recent) if fill else recent, PERIOD, keys)


def table_features(df: DataFrame, excluded: Sequence[str] | None = None) -> list[str]:
    """Every column except identifiers, target and the split."""
    return features_except(df, [*(V.non_features() if excluded is None else excluded), "split"])


def rank_features(
    table: DataFrame, features: Sequence[str] | None = None, target: str = TARGET, **options
) -> DataFrame:
    """Information value of the features on the training months (train and test rows together).

    Pass a table built with ``fill=False`` so that missing values keep a bin of their own.
    """
    rows = table.filter(F.col("split").isin("train", "test"))
    return iv_table(rows, table_features(table) if features is None else list(features), target, **options)


def capped_features(iv: DataFrame, table: DataFrame, cap: float = 0.54) -> list[str]:
    allowed = set(table_features(table))
    return [f for f in feature_names(iv, cap) if f in allowed]


def evaluate(scored: DataFrame, run: str, target: str = TARGET, period: str = PERIOD) -> DataFrame:
    """All metrics of a scored table as rows ``run, split, metric, period, value``.

    AUC and average precision are given for the probability and, as ``_label``, for the 0/1 prediction.
    ``scored`` is read several times: pass a materialized table.
    """
    s = ["split"]
    parts = [
        metric_rows(M.recall_precision(scored, target, "prediction", s), run, ["recall", "precision"], "split"),
        metric_rows(
            M.confusion(scored, target, "prediction", s), run, {c: f"cm_{c[1:]}" for c in M.CELLS}, "split"
        ),
        metric_rows(
            M.ks_by_date_ref(scored, period, target, "prob", s),
            run,
            {"ks": "ks_by_period"},
            "split",
            "period_ref",
        ),
    ]
    for column, suffix in (("prob", ""), ("prediction", "_label")):
        ranks = M.ranking_metrics(scored, target, column, s)
        names = {"auc": f"roc{suffix}", "average_precision": f"average_precision{suffix}"}
        parts.append(metric_rows(ranks, run, names if suffix else names | {"ks": "ks"}, "split"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def fit_and_evaluate(
    table: DataFrame,
    features: Sequence[str],
    run: str,
    target: str = TARGET,
    family: str = "boosted",
    tune: dict | None = None,
    keep: Sequence[str] = tuple(KEYS),
    **params,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Train on ``train``, score every split, evaluate. ``tune`` holds options of ``search``.

    Returns the model, the scored table (materialized, ids and scores only) and the metric rows, among them
    the family, the parameters and, after a search, every trial.
    """
    columns = list(dict.fromkeys([*keep, PERIOD, "dt_year", "split", target, *features]))
    ready = materialize(table.filter(F.col("split") != "unused").select(*columns))
    fit_rows = ready.filter(F.col("split") == "train")
    if tune is not None:
        held_out = ready.filter(F.col("split") == "test")
        model, family, params, log = search(fit_rows, held_out, features, target, **tune)
    else:
        model, log = train(fit_rows, features, target, family, **params), []
    ids = [c for c in columns if c not in set(features)]
    scored = materialize(score(model, ready).select(*ids, "prediction", "prob"))
    rows = evaluate(scored, run, target)
    ranks = importances(model, features)
    rows = rows.unionByName(
        metric_rows(
            ranks.withColumn("split", F.lit("train")), run, {"importance": "importance"}, "split", "name"
        )
    )
    settings = param_rows(table.sparkSession, run, {"family": family, **params})
    rows = rows.unionByName(settings)
    if log:
        rows = rows.unionByName(trial_rows(table.sparkSession, run, log))
    return model, scored, rows


def select_and_refit(
    table: DataFrame,
    features: Sequence[str],
    run: str,
    target: str = TARGET,
    rounds: int = 20,
    keys: Sequence[str] = tuple(KEYS),
    **options,
) -> tuple[DataFrame, PipelineModel, DataFrame, DataFrame]:
    """All-relevant selection on the train rows, then training and evaluation on what it keeps."""
    report = shadow_selection(table.filter(F.col("split") == "train"), features, target, keys, rounds)
    kept = supported(report)
    if not kept:
        raise ValueError("no feature beat its shadows")
    return report, *fit_and_evaluate(table, kept, run, target, keep=keys, **options)


def risk_groups(
    scored: DataFrame, target: str = TARGET, period: str = PERIOD, splits: Sequence[float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Cut scores at the train rows' optimal splits; returns the labelled rows and the event rate per
    split, period and group."""
    if splits is None:
        splits = fit_splits(scored.filter(F.col("split") == "train"), "prob", target)
    labelled = scored.withColumn("gh", risk_group("prob", splits))
    return labelled, event_rate(labelled, target, ["split", period, "gh"])
