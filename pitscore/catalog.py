"""The registered queries: every operator run over panels derived from the shared tables.

Dates leave a query as ISO text so that engines compare them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitscore.functions import vocabulary as V
from pitscore.operators import asof, binning, metrics, modeling, profile, rolling, rows, series, splits
from pitscore.operators.selection import hash_position, shadow_frame, shadow_selection
from pitscore.operators.statements import statement_lags, statement_rolling
from pitscore.plans import model_table as plan
from pitscore.plans import scoring
from pitscore.sources import fixtures, io

SERIES = plan.SERIES
IV_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "discount_gap", "status_leak"]
SINCE = "1995-03-31"  # the shared tables start in 1995; the library's own default start is later
IV_CAP = 0.1  # between the features that know nothing and the one that knows too much
CUTS = [0.01, 0.03, 0.05, 0.06, 0.08, 0.09]
STATEMENT_AMOUNTS_SHOWN = ["amt_sales_revenue", "amt_financial_results", "amt_net_profit"]


def _text_dates(df: DataFrame) -> DataFrame:
    dates = {c: F.col(c).cast("string") for c, t in df.dtypes if t == "date"}
    return df.withColumns(dates) if dates else df


def _panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fixtures.prices(spark, sf_dir), fixtures.statements(spark, sf_dir)


TARGET_COLUMNS = [
    "date", "id_cnpj", "ticker", "dt_year", "dt_month", "dt_safra_dre", "dt_refer", "txt_company_name",
    "amt_sales_revenue", "amt_net_profit", "adj_close", "var_target", "cat_target",
]


def asof_target(spark, sf_dir, drop_unmatched=False):
    prices, statements = _panel(spark, sf_dir)
    out = plan.build_model_table(
        prices, statements, TARGET_COLUMNS, SINCE, drop_unmatched=drop_unmatched
    )
    return _text_dates(out)


def asof_drop_unmatched(spark, sf_dir):
    return asof_target(spark, sf_dir, drop_unmatched=True)


def asof_by_period(spark, sf_dir):
    prices, statements = _panel(spark, sf_dir)
    joined = plan.join_statements(
        plan.prepare_prices(prices, SINCE),
        plan.prepare_statements(statements),
        by_period=True,
        keys_from=plan.with_calendar(plan.known_prices(prices, SINCE)),
    )
    return _text_dates(
        joined.select("date", *SERIES, "dt_safra_dre", "dt_refer", "amt_sales_revenue", "amt_net_profit")
    )


def asof_within_range(spark, sf_dir):
    prices, statements = _panel(spark, sf_dir)
    joined = plan.join_statements(
        plan.prepare_prices(prices, SINCE),
        plan.prepare_statements(statements),
        within_range=True,
        keys_from=plan.with_calendar(plan.known_prices(prices, SINCE)),
    )
    return _text_dates(
        joined.select("date", *SERIES, "dt_safra_dre", "dt_refer", "amt_sales_revenue", "amt_net_profit")
    )


def shifted_model_table(spark, sf_dir):
    prices, statements = _panel(spark, sf_dir)
    out = plan.build_shifted_model_table(prices, statements, SINCE)
    return _text_dates(
        out.select(
            "date", *SERIES, "dt_refer", "dt_refer_lag", "amt_sales_revenue", "var_target", "cat_target"
        )
    )


def dedup_latest(spark, sf_dir):
    lines = fixtures.table(spark, sf_dir, "lineitem").withColumn(
        "l_shipdate", F.to_date("l_shipdate")
    )
    return _text_dates(
        rows.keep_one(lines, ["l_orderkey", "l_linenumber"], [F.col("l_shipdate").desc()])
    )


def clean_prices(spark, sf_dir):
    return _text_dates(plan.prepare_prices(fixtures.prices(spark, sf_dir), SINCE))


def shifted_period_join(spark, sf_dir):
    one = fixtures.statements(spark, sf_dir).withColumn("dt_month", F.month("dt_refer"))
    out = asof.shifted_period_join(one, ["id_cnpj"], "dt_refer", "dt_year", "dt_month")
    return _text_dates(out.select("id_cnpj", "dt_refer", "dt_refer_lag", "amt_sales_revenue"))


def component_theta_join(spark, sf_dir):
    prices, statements = _panel(spark, sf_dir)
    records = statements.select(
        "id_cnpj",
        F.col("dt_year").alias("s_year"),
        F.month("dt_refer").alias("s_month"),
        "dt_refer",
        "amt_sales_revenue",
    )
    panel = prices.select(
        "date", *SERIES, F.year("date").alias("dt_year"), F.month("date").alias("dt_month")
    )
    return _text_dates(
        asof.component_theta_join(
            panel, records, ["id_cnpj"], "dt_year", "dt_month", "s_year", "s_month",
            ["dt_refer"], ["dt_refer", "amt_sales_revenue"],
        )
    )


def _pct_change(nlag):
    def query(spark, sf_dir):
        prices = fixtures.prices(spark, sf_dir).select("date", *SERIES, "adj_close")
        return _text_dates(
            series.get_percentage_change(prices, SERIES, "date", "adj_close", nlag, "change")
        )

    return query


def lagged_price(spark, sf_dir):
    prices = fixtures.prices(spark, sf_dir).select("date", *SERIES, "adj_close")
    return _text_dates(series.lag_column(prices, SERIES, "date", "adj_close", 1, "target_lag"))


def class_share_month(spark, sf_dir):
    return profile.class_share(fixtures.scored(spark, sf_dir), ["dt_year", "dt_month"], "cat_target")


def class_share_join_form(spark, sf_dir):
    out = profile.class_share_by_join(
        fixtures.scored(spark, sf_dir), ["dt_year", "dt_month"], "cat_target"
    )
    return out.select("dt_year", "dt_month", "cat_target", "qty", "total", "pct")


def class_share_year(spark, sf_dir):
    return class_share_month(spark, sf_dir).filter(F.col("dt_year") == 2000)


def table_freshness(spark, sf_dir):
    return _text_dates(profile.freshness(fixtures.prices(spark, sf_dir), "date"))


def _lines_with_gaps(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "lineitem").withColumn(
        "discount_gap", F.nullif("l_discount", F.lit(0.0))
    )


def _lines_with_leak(spark, sf_dir):
    """With a feature that knows too much of the target."""
    known = F.when(F.col("l_linestatus") == "F", 2).otherwise(0)
    return _lines_with_gaps(spark, sf_dir).withColumn("status_leak", F.col("l_linenumber") + known)


def describe_columns(spark, sf_dir):
    lines = _lines_with_gaps(spark, sf_dir).withColumn(
        "flag_gap", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag"))
    )
    return profile.dataset_description(lines)


def null_fill(spark, sf_dir):
    return rows.fill_numeric(
        _lines_with_gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "discount_gap")
    )


def feature_exclude(spark, sf_dir):
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus"]
    return rows.select_features(fixtures.table(spark, sf_dir, "lineitem"), ids, keep=["l_orderkey"])


def cast_project(spark, sf_dir):
    out = fixtures.scored(spark, sf_dir).filter(F.col("dt_year") >= 2000)
    return rows.project(
        out.withColumn("dt_year", F.col("dt_year").cast("string")),
        ["l_orderkey", "l_linenumber", "dt_year", "dt_month", "prob"],
    )


def month_split(spark, sf_dir):
    s = fixtures.scored(spark, sf_dir).withColumn("split", splits.month_split("dt_month"))
    return s.groupBy("split", "dt_month").agg(F.count(F.lit(1)).alias("n"))


def hash_split(spark, sf_dir):
    return fixtures.scored(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "prob",
        splits.hash_split(["l_orderkey", "l_linenumber"]).alias("split"),
    )


def _split_scores(spark, sf_dir, score="l_extendedprice"):
    return splits.assign_splits(
        fixtures.scored(spark, sf_dir, score), "dt_month", ["l_orderkey", "l_linenumber"]
    )


def assigned_splits(spark, sf_dir):
    return (
        _split_scores(spark, sf_dir)
        .groupBy("split")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("cat_target").alias("events"))
    )


def append_splits(spark, sf_dir):
    s = _split_scores(spark, sf_dir).select("l_orderkey", "dt_month", "cat_target", "prob", "split")
    frames = {name: s.filter(F.col("split") == name).drop("split") for name in ("train", "test", "out")}
    return rows.append_splits(frames)


def risk_group_cut(spark, sf_dir):
    s = fixtures.scored(spark, sf_dir, "l_discount")
    return s.select("l_orderkey", "l_linenumber", "prob", binning.risk_group("prob", CUTS).alias("gh"))


def risk_group_rate(spark, sf_dir):
    s = fixtures.scored(spark, sf_dir, "l_discount").withColumn("gh", binning.risk_group("prob", CUTS))
    return profile.event_rate(s, "cat_target", ["dt_month", "gh"])


def risk_group_fitted(spark, sf_dir):
    s = _split_scores(spark, sf_dir, "l_discount").filter(F.col("split") != "unused")
    return scoring.risk_groups(s)[1]


def optimal_bins(spark, sf_dir):
    return binning.optimal_bins(fixtures.scored(spark, sf_dir), "prob", "cat_target")


def binning_table(spark, sf_dir):
    bins = binning.optimal_bins(fixtures.scored(spark, sf_dir, "l_discount"), "prob", "cat_target")
    return binning.binning_table(bins).withColumns(
        {"woe": F.round("woe", 9), "iv": F.round("iv", 9)}
    )


def _iv(spark, sf_dir):
    lines = _lines_with_leak(spark, sf_dir).withColumn(
        "cat_target", F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    )
    return binning.iv_table(lines, IV_FEATURES, "cat_target")


def iv_ranking(spark, sf_dir):
    return _iv(spark, sf_dir).withColumn("iv", F.round("iv", 9))


def iv_sketched(spark, sf_dir):
    """Prebin edges from quantile sketches, so the values are close to ``iv_ranking``, not equal."""
    lines = _lines_with_leak(spark, sf_dir).withColumn(
        "cat_target", F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    )
    return binning.iv_table(lines, IV_FEATURES, "cat_target", accuracy=1000)


def iv_cap(spark, sf_dir):
    return binning.features_below_cap(_iv(spark, sf_dir), IV_CAP).select("name")


def iv_top(spark, sf_dir):
    return rows.top_n(_iv(spark, sf_dir).select("name", F.round("iv", 9).alias("iv")), "iv", "name", 3)


def confusion(spark, sf_dir):
    return metrics.confusion(_split_scores(spark, sf_dir), "cat_target", "prediction", ["split"])


def recall_precision(spark, sf_dir):
    return metrics.recall_precision(_split_scores(spark, sf_dir), "cat_target", "prediction", ["split"])


def class_report(spark, sf_dir):
    return metrics.classification_report(
        _split_scores(spark, sf_dir), "cat_target", "prediction", ["split"]
    )


def auc(spark, sf_dir):
    return metrics.roc_auc(_split_scores(spark, sf_dir), "cat_target", "prob", ["split"])


def auc_ties(spark, sf_dir):
    return metrics.roc_auc(_split_scores(spark, sf_dir, "l_discount"), "cat_target", "prob", ["split"])


def auc_label(spark, sf_dir):
    return metrics.roc_auc(_split_scores(spark, sf_dir), "cat_target", "prediction", ["split"])


def avg_precision(spark, sf_dir):
    out = metrics.average_precision(_split_scores(spark, sf_dir), "cat_target", "prob", ["split"])
    return out.withColumn("average_precision", F.round("average_precision", 9))


def ks_all(spark, sf_dir):
    return metrics.ks(fixtures.scored(spark, sf_dir), "cat_target", "prob")


def ks_by_period(spark, sf_dir):
    return metrics.ks_by_date_ref(fixtures.scored(spark, sf_dir), "dt_month", "cat_target", "prob")


def ks_by_language(spark, sf_dir):
    return metrics.ks_by_date_ref(fixtures.scored_docs(spark, sf_dir), "period", "cat_target", "prob")


def roc_points(spark, sf_dir):
    return metrics.roc_points(fixtures.scored(spark, sf_dir), "cat_target", "prob")


def ks_points(spark, sf_dir):
    return metrics.ks_points(fixtures.scored(spark, sf_dir), "cat_target", "prob")


def amplitude(spark, sf_dir):
    return _text_dates(
        fixtures.prices(spark, sf_dir).select(
            "date", *SERIES, series.amplitude().alias("amplitude_close_high_price")
        )
    )


def _thin(spark, sf_dir, *columns):
    return fixtures.prices(spark, sf_dir).select("date", *SERIES, *columns)


def rolling_stats(spark, sf_dir):
    out = rolling.rolling_stats(_thin(spark, sf_dir, "adj_close"), SERIES, ["date"], "adj_close")
    spreads = {c: F.round(c, 2) for c in out.columns if c.startswith("amt_std_")}
    return _text_dates(out.withColumns(spreads))


def rolling_changes(spark, sf_dir):
    panel = fixtures.prices(spark, sf_dir).withColumn("amplitude_close_high_price", series.amplitude())
    lags = {f"pct_tx_{c}_{n}d": (c, n) for c in V.CHANGE_COLUMNS for n in V.ROLLING_WINDOWS}
    out = series.percentage_changes(panel, SERIES, "date", lags)
    return _text_dates(out.select("date", *SERIES, *lags))


def rolling_slope(spark, sf_dir):
    return _text_dates(
        rolling.rolling_slope(_thin(spark, sf_dir, "adj_close"), SERIES, ["date"], "adj_close")
    )


def breakouts(spark, sf_dir):
    out = rolling.breakouts(
        _thin(spark, sf_dir, "adj_close", "high_price", "low_price"),
        SERIES,
        ["date"],
        ["adj_close", "high_price"],
        ["adj_close", "low_price"],
    )
    return _text_dates(out.drop("adj_close", "high_price", "low_price"))


def rsi(spark, sf_dir):
    return _text_dates(
        rolling.relative_strength(_thin(spark, sf_dir, "adj_close"), SERIES, ["date"], "adj_close")
    )


def price_features_full(spark, sf_dir):
    """Every price feature: how many values and their sum per ticker and year."""
    full = rolling.price_features(fixtures.prices(spark, sf_dir), SERIES, ["date"])
    full = full.withColumn("dt_year", F.year("date"))
    return profile.feature_totals(full, V.price_feature_columns(), ["ticker", "dt_year"])


def model_table_full(spark, sf_dir):
    """Every feature of the model table, from a panel with duplicates, an unknown company, late versions
    and missing dates: how many values and their sum per ticker and year."""
    full = plan.build_full_model_table(
        fixtures.messy_prices(spark, sf_dir), fixtures.messy_statements(spark, sf_dir), SINCE
    )
    features = [*V.price_feature_columns(), *V.statement_feature_columns(), "cat_target", "var_target"]
    return profile.feature_totals(full, features, ["ticker", "dt_year"])


def price_feature_table(spark, sf_dir):
    """The flags and two extremes of the price features, summarized per ticker and year."""
    full = rolling.price_features(fixtures.prices(spark, sf_dir), SERIES, ["date"])
    flags = [c for c in full.columns if c.startswith("cat_")]
    return full.groupBy("ticker", F.year("date").alias("dt_year")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("amt_max_adj_close_360").alias("sum_max_360"),
        F.sum("amt_min_adj_close_160").alias("sum_min_160"),
        *[F.sum(c).alias(c) for c in flags],
    )


def statement_lag_features(spark, sf_dir):
    panel = fixtures.statements(spark, sf_dir).select("id_cnpj", "dt_refer", *STATEMENT_AMOUNTS_SHOWN)
    return _text_dates(
        statement_lags(panel, ["id_cnpj"], "dt_refer", STATEMENT_AMOUNTS_SHOWN, {"1q": 3, "1y": 12})
    )


def statement_rolling_features(spark, sf_dir):
    panel = fixtures.statements(spark, sf_dir).select("id_cnpj", "dt_refer", *STATEMENT_AMOUNTS_SHOWN)
    out = statement_rolling(panel, ["id_cnpj"], "dt_refer", STATEMENT_AMOUNTS_SHOWN)
    spreads = {c: F.round(c, 2) for c in out.columns if c.startswith("amt_std_")}
    return _text_dates(out.withColumns(spreads))


def parquet_roundtrip(spark, sf_dir):
    path = io.scratch_path(spark, "scored-by-year")
    io.write_parquet(fixtures.scored(spark, sf_dir), path)
    back = io.read_parquet(spark, path).filter(F.col("dt_year") >= 2000)
    return back.groupBy("dt_year").agg(F.count(F.lit(1)).alias("n"), F.sum("cat_target").alias("events"))


def csv_roundtrip(spark, sf_dir):
    path = io.scratch_path(spark, "iv-table")
    # a wider file in another order: columns are found by name
    io.write_csv(_iv(spark, sf_dir).select("n_bins", F.lit("OPTIMAL").alias("status"), "name", "iv"), path)
    back = io.read_iv_csv(spark, path)
    return binning.features_below_cap(back, IV_CAP).select("name", F.round("iv", 9).alias("iv"))


def metrics_table(spark, sf_dir):
    s = _split_scores(spark, sf_dir)
    path = io.scratch_path(spark, "metrics")
    cells = metrics.confusion(s, "cat_target", "prediction", ["split"])
    per_month = metrics.ks_by_date_ref(s, "dt_month", "cat_target", "prob", ["split"])
    lines = io.metric_rows(
        cells, "001", {"n00": "cm_00", "n01": "cm_01", "n10": "cm_10", "n11": "cm_11"}, "split"
    ).unionByName(io.metric_rows(per_month, "001", ["ks"], "split", "period_ref"))
    io.write_metrics(lines, path)
    return io.read_metrics(spark, path)


MODEL_FEATURES = [
    "change_1", "change_5", "amt_IFR_adj_close_10", "amt_beta_adj_close_11",
    "amt_avg_adj_close_5", "volume", "amt_sales_revenue", "amt_net_profit",
]


def training_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model table with a handful of features, split by month and hash."""
    prices, statements = _panel(spark, sf_dir)

    def rich(joined):
        return (
            rolling.RollingFeatures(joined, SERIES, ["date"])
            .stats("adj_close", [5])
            .changes("adj_close", [1, 5])
            .strength("adj_close", [10])
            .slopes("adj_close", [11])
            .build()
            .withColumnsRenamed({"pct_tx_adj_close_1d": "change_1", "pct_tx_adj_close_5d": "change_5"})
        )

    ids = ["date", *SERIES, "dt_year", "dt_month"]
    columns = [*ids, "cat_target", *MODEL_FEATURES, "txt_company_name"]
    full = plan.build_model_table(prices, statements, columns, SINCE, features=rich)
    panel = scoring.training_table(full, first_year=1990)
    return panel.select(*ids, "split", "cat_target", *MODEL_FEATURES)


def _model_query(family, **params):
    def query(spark, sf_dir):
        panel = io.materialize(training_panel(spark, sf_dir).filter(F.col("split") != "unused"))
        model = modeling.train(
            panel.filter(F.col("split") == "train"), MODEL_FEATURES, "cat_target", family, **params
        )
        out = modeling.score(model, panel)
        return _text_dates(out.select("date", *SERIES, "split", "cat_target", "prediction", "prob"))

    return query


gbt_score = _model_query("boosted", maxIter=10, maxDepth=4, minInstancesPerNode=20)
rf_score = _model_query("forest", numTrees=20, maxDepth=5, minInstancesPerNode=10)


def feature_importances(spark, sf_dir):
    panel = io.materialize(training_panel(spark, sf_dir).filter(F.col("split") == "train"))
    model = modeling.train(panel, MODEL_FEATURES, "cat_target", "forest", numTrees=20, maxDepth=5)
    return modeling.importances(model, MODEL_FEATURES)


def param_search(spark, sf_dir):
    panel = io.materialize(training_panel(spark, sf_dir).filter(F.col("split").isin("train", "test")))
    space = {
        "boosted": {"maxDepth": (2, 5), "maxIter": (3, 8), "minInstancesPerNode": (50, 500)},
        "forest": {"maxDepth": (2, 5), "numTrees": (5, 15), "minInstancesPerNode": (10, 60)},
    }
    *_, log = modeling.search(
        panel.filter(F.col("split") == "train"),
        panel.filter(F.col("split") == "test"),
        MODEL_FEATURES,
        "cat_target",
        space,
        ("boosted", "forest"),
        trials=4,
    )
    lines = [(i, f, ", ".join(f"{k}={v}" for k, v in sorted(p.items())), float(m)) for i, f, p, m in log]
    return spark.createDataFrame(lines, "trial int, family string, params string, metric double")


def boruta_report(spark, sf_dir):
    panel = training_panel(spark, sf_dir).filter(F.col("split") == "train")
    return shadow_selection(
        panel, MODEL_FEATURES, "cat_target", ["date", *SERIES], rounds=8, alpha=0.2, numTrees=10
    )


def evaluated_run(spark, sf_dir):
    _, _, lines = scoring.fit_and_evaluate(
        training_panel(spark, sf_dir), MODEL_FEATURES, "demo", family="forest", numTrees=10, maxDepth=4
    )
    return lines


def model_roundtrip(spark, sf_dir):
    panel = io.materialize(training_panel(spark, sf_dir).filter(F.col("split") != "unused"))
    model = modeling.train(
        panel.filter(F.col("split") == "train"), MODEL_FEATURES, "cat_target", "forest", numTrees=5
    )
    path = io.scratch_path(spark, "model")
    io.save_model(model, path)
    out = modeling.score(io.load_model(path), panel)
    return out.groupBy("split", "prediction").agg(F.count(F.lit(1)).alias("n"))


def class_weights(spark, sf_dir):
    """Balanced weights of rows whose target is sometimes missing."""
    s = fixtures.scored(spark, sf_dir)
    known = s.withColumn("y", F.when(F.col("dt_month") != 2, F.col("cat_target")))
    out = modeling.with_balanced_weight(known, "y", "weight")
    return out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 9).alias("weight"))


def scored_contract(spark, sf_dir):
    """Scores of both families: rows per split, probabilities out of range, and labels that disagree."""
    panel = io.materialize(training_panel(spark, sf_dir))
    fit_rows = panel.filter(F.col("split") == "train")
    settings = {"boosted": {"maxIter": 5, "maxDepth": 3}, "forest": {"numTrees": 10, "maxDepth": 4}}
    parts = []
    for family, params in settings.items():
        model = modeling.train(fit_rows, MODEL_FEATURES, "cat_target", family, **params)
        s = modeling.score(model, panel)
        parts.append(
            s.groupBy(F.lit(family).alias("family"), "split").agg(
                F.count(F.lit(1)).alias("n"),
                F.count_if(~F.col("prob").between(0, 1)).alias("n_outside"),
                F.count_if((F.col("prob") > 0.5) != (F.col("prediction") == 1)).alias("n_disagree"),
            )
        )
    return parts[0].unionByName(parts[1])


def reload_contract(spark, sf_dir):
    """Scores of a model before and after it was stored: rows per split and how many differ."""
    panel = io.materialize(training_panel(spark, sf_dir))
    fit_rows = panel.filter(F.col("split") == "train")
    model = modeling.train(fit_rows, MODEL_FEATURES, "cat_target", "forest", numTrees=5)
    path = io.scratch_path(spark, "model")
    io.save_model(model, path)
    before = modeling.score(model, panel).withColumnRenamed("prob", "before").drop("prediction")
    both = modeling.score(io.load_model(path), before)
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("prob") != F.col("before")).alias("n_changed")
    )


def importance_contract(spark, sf_dir):
    panel = io.materialize(training_panel(spark, sf_dir).filter(F.col("split") == "train"))
    model = modeling.train(panel, MODEL_FEATURES, "cat_target", "forest", numTrees=10, maxDepth=4)
    return modeling.importances(model, MODEL_FEATURES, digits=None).agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(F.col("importance") < 0).alias("n_negative"),
        F.round(F.sum("importance"), 6).alias("total"),
    )


def shadow_contract(spark, sf_dir):
    """One round's shadows: a permutation of the rows that leaves none in its place."""
    s = fixtures.prices(spark, sf_dir).select("date", *SERIES, "adj_close")
    keys = ["date", *SERIES]
    positioned = io.materialize(hash_position(s, keys, 7).select("_pos", *keys, "adj_close"))
    n = positioned.count()
    pairs = shadow_frame(positioned.select("_pos", F.xxhash64(*keys).alias("id"), "adj_close"), ["id", "adj_close"], n, 11)
    return pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("_pos").alias("n_positions"),
        F.count_distinct("_shadow_0").alias("n_donors"),
        F.count_if(F.col("id") == F.col("_shadow_0")).alias("n_in_place"),
        F.sum("_shadow_1").alias("total"),
    )


def selection_refit(spark, sf_dir):
    """Selection on a panel with a planted feature, then the fit on what it keeps."""
    noise = F.pmod(F.xxhash64("date", *SERIES), F.lit(1000)) / 1000.0
    panel = training_panel(spark, sf_dir).withColumn("planted", F.col("cat_target") + noise)
    report, model, _, _ = scoring.select_and_refit(
        io.materialize(panel), [*MODEL_FEATURES, "planted"], "001", rounds=8, family="forest", numTrees=5
    )
    fitted = model.stages[0].getInputCols()
    kept = F.col("features").isin(*fitted)
    return report.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(kept != F.col("support")).alias("n_mismatch"),
        F.count_if((F.col("features") == "planted") & F.col("support")).alias("n_planted"),
    )


def capped_training(spark, sf_dir):
    """Ranking written as CSV, read back, capped, and a model fitted on the features below the cap."""
    lines = _lines_with_leak(spark, sf_dir).select(
        "l_orderkey", *IV_FEATURES, F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("cat_target"),
        F.year("l_shipdate").alias("dt_year"), F.month("l_shipdate").alias("dt_month"),
    )
    unfilled = scoring.training_table(lines, 1990, ["l_orderkey", "l_linenumber"], fill=False)
    path = io.scratch_path(spark, "iv-table")
    io.write_csv(scoring.rank_features(unfilled, IV_FEATURES), path)
    features = binning.feature_names(io.read_iv_csv(spark, path), IV_CAP)
    table = io.materialize(rows.fill_numeric(unfilled))
    model = modeling.train(table.filter(F.col("split") == "train"), features, "cat_target", "forest", numTrees=5)
    used = F.lit(", ".join(sorted(features)))
    return modeling.score(model, table).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.max(used).alias("features"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "asof_target": asof_target,
    "asof_drop_unmatched": asof_drop_unmatched,
    "asof_by_period": asof_by_period,
    "asof_within_range": asof_within_range,
    "shifted_model_table": shifted_model_table,
    "dedup_latest": dedup_latest,
    "clean_prices": clean_prices,
    "shifted_period_join": shifted_period_join,
    "component_theta_join": component_theta_join,
    "lagged_price": lagged_price,
    "pct_change_1": _pct_change(1),
    "pct_change_5": _pct_change(5),
    "class_share_month": class_share_month,
    "class_share_join_form": class_share_join_form,
    "class_share_year": class_share_year,
    "table_freshness": table_freshness,
    "describe_columns": describe_columns,
    "null_fill": null_fill,
    "feature_exclude": feature_exclude,
    "cast_project": cast_project,
    "month_split": month_split,
    "hash_split": hash_split,
    "assigned_splits": assigned_splits,
    "append_splits": append_splits,
    "risk_group_cut": risk_group_cut,
    "risk_group_rate": risk_group_rate,
    "risk_group_fitted": risk_group_fitted,
    "optimal_bins": optimal_bins,
    "binning_table": binning_table,
    "iv_ranking": iv_ranking,
    "iv_sketched": iv_sketched,
    "iv_cap": iv_cap,
    "iv_top": iv_top,
    "confusion": confusion,
    "recall_precision": recall_precision,
    "class_report": class_report,
    "auc": auc,
    "auc_ties": auc_ties,
    "auc_label": auc_label,
    "avg_precision": avg_precision,
    "ks_all": ks_all,
    "ks_by_period": ks_by_period,
    "ks_by_language": ks_by_language,
    "roc_points": roc_points,
    "ks_points": ks_points,
    "amplitude": amplitude,
    "rolling_stats": rolling_stats,
    "rolling_changes": rolling_changes,
    "rolling_slope": rolling_slope,
    "breakouts": breakouts,
    "rsi": rsi,
    "price_feature_table": price_feature_table,
    "statement_lag_features": statement_lag_features,
    "statement_rolling_features": statement_rolling_features,
    "parquet_roundtrip": parquet_roundtrip,
    "csv_roundtrip": csv_roundtrip,
    "metrics_table": metrics_table,
    "gbt_score": gbt_score,
    "rf_score": rf_score,
    "feature_importances": feature_importances,
    "param_search": param_search,
    "boruta_report": boruta_report,
    "evaluated_run": evaluated_run,
    "model_roundtrip": model_roundtrip,
    "price_features_full": price_features_full,
    "model_table_full": model_table_full,
    "class_weights": class_weights,
    "scored_contract": scored_contract,
    "reload_contract": reload_contract,
    "importance_contract": importance_contract,
    "shadow_contract": shadow_contract,
    "selection_refit": selection_refit,
    "capped_training": capped_training,
}
