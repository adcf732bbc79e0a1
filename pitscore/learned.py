"""Registered queries of the learners grown in this library: trees, search and feature selection.

Where a fit can be stated in SQL (one tree over given bins, a search over tables of rates, verdicts from hit
counts), the query returns the whole fit. Fits beyond that are held to a planted signal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore.catalog import MODEL_FEATURES, SERIES, _lines_with_leak, _split_scores, training_panel
from pitscore.operators import binning, metrics, modeling, sketches, tuning
from pitscore.operators.ensembles import fit_boosted, fit_forest
from pitscore.operators.profile import dataset_description
from pitscore.operators.ranking import score_counts
from pitscore.operators.selection import all_relevant, verdict_table
from pitscore.operators.splits import hash_split
from pitscore.sources import fixtures, io

TREE_FEATURES = ["l_quantity", "discount_gap", "l_tax", "l_linenumber", "status_leak"]
LINE_KEYS = ["l_orderkey", "l_linenumber"]
#: Penalties of the boosted tree, rows of a leaf, and leaves of the budgeted one.
ALPHA, LAM, LEAST_ROWS, LEAVES = 2.5, 10.0, 20, 3


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return _lines_with_leak(spark, sf_dir).select(*LINE_KEYS, "l_discount", *TREE_FEATURES[:-2], "status_leak", y.alias("cat_target"))


def _tree_rows(model, spark) -> DataFrame:
    return model.nodes(spark).select(
        "node", "feature", "threshold", F.round("gain", 6).alias("gain"),
        F.col("stats")[2].cast("bigint").alias("n"), F.round("value", 6).alias("value"),
    )


def boosted_nodes(spark, sf_dir):
    """First tree of a boosting with L1 and L2 penalties."""
    model = fit_boosted(_lines(spark, sf_dir), TREE_FEATURES, "cat_target", 1, 2, 1.0, ALPHA, LAM, LEAST_ROWS)
    return _tree_rows(model, spark)


def budgeted_nodes(spark, sf_dir):
    """One tree of a forest with a leaf budget, on all rows and features."""
    model = fit_forest(
        _lines(spark, sf_dir), TREE_FEATURES, "cat_target", LINE_KEYS, 1, 2, LEAVES, LEAST_ROWS, subset=None, bootstrap=False
    )
    return _tree_rows(model, spark)


RATE_CANDIDATES = [("rates", {"column": c, "prior_rows": m}) for c in TREE_FEATURES for m in (1, 100)]
RATE_FRACTIONS = (0.1, 0.3, 1.0)


def _rate_fit(family: str, params: dict, rows: DataFrame):
    """A score that is the rate of 1s per value of a column, drawn to the overall rate by some rows of it."""
    column, m = params["column"], params["prior_rows"]
    n, s = rows.agg(F.count(F.lit(1)), F.sum("cat_target")).first()
    prior = s / n
    value = F.coalesce(F.col(column).cast("double"), F.lit(-1.0))
    table = rows.groupBy(value.alias("_v")).agg(F.sum("cat_target").alias("_s"), F.count(F.lit(1)).alias("_n"))
    rate = (F.col("_s") + F.lit(m * prior)) / (F.col("_n") + m)
    table = io.materialize(table.select("_v", rate.alias("prob")))

    def score(df):
        out = df.withColumn("_v", value).join(table, "_v", "left")
        return out.withColumn("prob", F.coalesce("prob", F.lit(prior)))

    return table, score


def halving_log(spark, sf_dir):
    """All rungs of a search by successive halving: which trials were fitted on what, and which went on."""
    lines = io.materialize(_lines(spark, sf_dir).withColumn("split", hash_split(LINE_KEYS)))
    *_, log = tuning.successive_halving(
        lines.where("split = 'train'"), lines.where("split = 'test'"), "cat_target", LINE_KEYS, RATE_CANDIDATES,
        _rate_fit, RATE_FRACTIONS, 3, seed=11,
    )
    return log.select("rung", "trial", "fraction", F.round("value", 9).alias("value"), "promoted")


VERDICT_ROUNDS = 20


def selection_verdicts(spark, sf_dir):
    """Two-step verdicts on hit counts, one per supplier."""
    lines = _lines_with_leak(spark, sf_dir)
    hits = F.pmod(F.sum("l_quantity").cast("bigint") + F.count(F.lit(1)), F.lit(VERDICT_ROUNDS + 1)).cast("int")
    counts = lines.groupBy(F.col("l_suppkey").cast("string").alias("features")).agg(
        hits.alias("hits"), F.round(F.avg("l_quantity"), 6).alias("importance")
    )
    return verdict_table(counts, VERDICT_ROUNDS, 0.1)


def _planted_panel(spark, sf_dir):
    """The panel and a feature that tells the target in nine of ten rows."""
    told = F.pmod(F.xxhash64("date", *SERIES), F.lit(10)) < 9
    noise = F.pmod(F.xxhash64(*SERIES, "date"), F.lit(1000)) / 1000.0
    planted = F.when(told, F.col("cat_target") + 2 * noise).otherwise(noise * 3)
    return training_panel(spark, sf_dir).where("split <> 'unused' and cat_target is not null").withColumn("planted", planted)


FAMILIES = {
    "boosted": {"maxIter": 5, "maxDepth": 3},
    "budgeted": {"trees": 5, "depth": 4, "max_leaves": 10, "min_rows": 20, "keys": ["date", *SERIES]},
    "forest": {"numTrees": 10, "maxDepth": 4},
    "penalised": {"iterations": 5, "depth": 3, "alpha": 0.5, "lam": 1.0, "rate": 0.5, "drop": 0.1},
}


def planted_contract(spark, sf_dir):
    """Every family on all features and a planted one: what its scores on the later months are worth, and
    which feature it puts first."""
    panel = io.materialize(_planted_panel(spark, sf_dir))
    fit_rows, later = panel.where("split = 'train'"), panel.where("split = 'out'")
    features = [*MODEL_FEATURES, "planted"]
    out = []
    for family, params in FAMILIES.items():
        model = modeling.train(fit_rows, features, "cat_target", family, **params)
        auc = metrics.roc_auc(modeling.score(model, later), "cat_target", "prob").first()["auc"]
        ranked = modeling.importances(model, features).collect()
        falls = all(a["importance"] >= b["importance"] for a, b in zip(ranked, ranked[1:], strict=False))
        cents = all(round(r["importance"], 2) == r["importance"] for r in ranked)
        out.append((family, len(ranked), ranked[0]["name"], bool(auc > 0.7), falls, cents))
    return spark.createDataFrame(out, "family string, n_features int, first string, auc_above boolean, falls boolean, two_digits boolean")


def search_contract(spark, sf_dir):
    """Random search on all features: the trial it keeps is the best of its log, and the kept model's score on
    the held-out rows is the logged one."""
    panel = io.materialize(_planted_panel(spark, sf_dir))
    fit_rows, held_out = panel.where("split = 'train'"), panel.where("split = 'test'")
    features = [*MODEL_FEATURES, "planted"]
    space = {
        "boosted": {"maxDepth": (2, 3), "maxIter": (2, 4), "minInstancesPerNode": (50, 500)},
        "forest": {"maxDepth": (2, 4), "numTrees": (4, 8), "minInstancesPerNode": (10, 60)},
    }
    model, family, params, log = modeling.search(fit_rows, held_out, features, "cat_target", space, ("boosted", "forest"), trials=4)
    best = max(log, key=lambda r: (r[3], -r[0]))
    auc = metrics.roc_auc(modeling.score(model, held_out), "cat_target", "prob").first()["auc"]
    row = (len(log), (family, params) == (best[1], best[2]), abs(auc - best[3]) < 1e-9, min(r[3] for r in log) > 0.7)
    return spark.createDataFrame([row], "n_trials int, kept_best boolean, same_auc boolean, all_learned boolean")


def relevant_features(spark, sf_dir):
    """All-relevant selection by shadows with boosted trees, on all features and a planted one."""
    panel = io.materialize(_planted_panel(spark, sf_dir).where("split = 'train'"))
    report = all_relevant(
        panel, [*MODEL_FEATURES, "planted"], "cat_target", ["date", *SERIES], 10, 0.2, "penalised", iterations=3, depth=3
    )
    return report.agg(
        F.count(F.lit(1)).alias("n_features"), F.count_if((F.col("features") == "planted") & F.col("support")).alias("n_planted"),
        F.count_if(F.col("support") != (F.col("rank") == 1)).alias("n_odd"),
    )


def supervised_bins(spark, sf_dir):
    """Prebins of a score cut where the classes part best."""
    counts = score_counts(fixtures.scored(spark, sf_dir), "prob", "cat_target")
    pre = binning.supervised_prebins(counts)
    return pre.select("prebin", "lo", "hi", F.col("n1").cast("bigint").alias("n1"), F.col("n0").cast("bigint").alias("n0"))


CELLS = 20


def roc_curve(spark, sf_dir):
    """ROC curve of bounded size per split."""
    return metrics.roc_curve(_split_scores(spark, sf_dir), "cat_target", "prob", ["split"], CELLS)


def ks_curve(spark, sf_dir):
    """KS curve of bounded size."""
    return metrics.ks_curve(fixtures.scored(spark, sf_dir), "cat_target", "prob", cells=CELLS)


SKETCHED = ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "discount_gap", "l_shipdate"]


def sketched_description(spark, sf_dir):
    """Description from sketches kept by year, one of which was stored twice; distinct counts are held to the
    exact ones."""
    lines = _lines_with_leak(spark, sf_dir).withColumn("dt_year", F.year("l_shipdate"))
    path = io.scratch_path(spark, "sketches")
    sketches.store_sketches(lines, SKETCHED, "dt_year", path)
    sketches.store_sketches(lines.where("dt_year = 1996"), SKETCHED, "dt_year", path)
    exact = dataset_description(lines.select(*SKETCHED)).select("column", F.col("n_distinct").alias("exact"))
    found = sketches.description(sketches.read_sketches(spark, path)).join(exact, "column")
    close = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.05 * F.col("exact")
    return found.select("column", "n_missing", F.round("pct_missing", 9).alias("pct_missing"), close.alias("distinct_close"))


def iv_from_sketches(spark, sf_dir):
    """Bins of features cut at edges from stored quantile sketches: every row lies in one, and only the feature
    that knows too much has a large IV."""
    lines = _lines(spark, sf_dir).withColumn("half", F.pmod(F.col("l_orderkey"), F.lit(2)))
    path = io.scratch_path(spark, "sketches")
    sketches.store_sketches(lines, TREE_FEATURES, "half", path)
    edges = sketches.edges(sketches.read_sketches(spark, path), TREE_FEATURES)
    bins = binning.feature_bins(lines, TREE_FEATURES, "cat_target", edges=edges)
    per = bins.groupBy(F.col("variable").alias("name")).agg(F.sum(F.col("n1") + F.col("n0")).alias("n_rows"))
    iv = binning.iv_table(lines, TREE_FEATURES, "cat_target", edges=edges)
    leak = iv.select("name", (F.col("iv") > 0.1).alias("knows"))
    return per.join(leak, "name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "boosted_nodes": boosted_nodes,
    "budgeted_nodes": budgeted_nodes,
    "halving_log": halving_log,
    "selection_verdicts": selection_verdicts,
    "planted_contract": planted_contract,
    "search_contract": search_contract,
    "relevant_features": relevant_features,
    "supervised_bins": supervised_bins,
    "roc_curve": roc_curve,
    "ks_curve": ks_curve,
    "sketched_description": sketched_description,
    "iv_from_sketches": iv_from_sketches,
}
