"""Edge cases and properties of the panel operators."""

import datetime as dt
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitscore import catalog
from pitscore.functions import vocabulary as V
from pitscore.functions.columns import share_pct, sign_flag
from pitscore.operators import asof, rolling, rows, series, splits
from pitscore.operators.statements import statement_features
from pitscore.plans import model_table as plan
from pitscore.sources import fixtures

D = dt.date


def panel(spark, values, ticker="T"):
    data = [(D(2020, 1, 1) + dt.timedelta(days=i), "c1", ticker, v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, "date date, id_cnpj string, ticker string, adj_close double")


def test_percentage_change_edges(spark):
    df = panel(spark, [0.0, 5.0, -2.0, -1.0, -1.0, None, 3.0])
    out = series.get_percentage_change(df, ["id_cnpj", "ticker"], ["date"], "adj_close", 1, "c")
    got = [r["c"] for r in out.orderBy("date").collect()]
    assert got == [None, None, -1.4, 0.5, 0.0, None, None]


def test_sign_flag(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(sign_flag("v")).collect()] == [1, 0, 1, None]


def test_target_drops_first_two_rows_and_zero_base(spark):
    out = series.add_target(panel(spark, [10.0, 11.0, 0.0, 4.0, 5.0]), plan.SERIES, "date", "adj_close")
    got = [(r["date"].day, r["var_target"], r["cat_target"]) for r in out.orderBy("date").collect()]
    assert got == [(3, 0.1, 1), (4, -1.0, 0)]


def test_share_of_nothing_is_null(spark):
    df = spark.createDataFrame([(0, 0), (1, 3)], "a int, b int")
    assert [r[0] for r in df.select(share_pct("a", "b")).collect()] == [None, 33.33]


def test_keep_one_ignores_partitioning(spark):
    data = [(i % 50, random.Random(i).random(), f"v{i}") for i in range(2000)]
    df = spark.createDataFrame(data, "k int, x double, v string")
    want = None
    for n in (1, 7, 40):
        got = sorted(map(tuple, rows.keep_one(df.repartition(n), ["k"], [F.col("x").desc()]).collect()))
        want = want or got
        assert got == want and len(got) == 50


def test_keep_one_limits_groups_below_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = rows.keep_one(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_month_split_leaves_october_out(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    got = {r["m"]: r["s"] for r in df.select("m", splits.month_split("m").alias("s")).collect()}
    assert got[10] == "unused" and got[2] == "train" and got[11] == "out"
    assert sum(v == "train" for v in got.values()) == 5


def test_hash_split_is_stable_and_near_its_share(spark):
    df = spark.range(20000).select(F.col("id").alias("k"))
    out = df.select("k", splits.hash_split(["k"]).alias("s"))
    a = {r["k"]: r["s"] for r in out.collect()}
    b = {r["k"]: r["s"] for r in out.repartition(13).collect()}
    assert a == b
    assert abs(sum(v == "test" for v in a.values()) / len(a) - 0.3) < 0.02


def brute_asof(prices, statements):
    m = prices.merge(statements, on="id", how="left", suffixes=("", "_s"))
    m = m[m["p_s"] <= m["p"]]
    m = m.sort_values(["p_s", "ref"]).groupby(["id", "t", "d"], as_index=False).last()
    out = prices.merge(m[["id", "t", "d", "ref"]], on=["id", "t", "d"], how="left")
    return sorted((r.id, r.t, r.d, None if pd.isna(r.ref) else int(r.ref)) for r in out.itertuples())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_asof_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    # one company holds most rows; one has no statement; some periods hold several statements
    ids = ["hot"] * 6 + ["a", "b", "none"]
    prices = pd.DataFrame(
        {(rng.choice(ids), rng.choice("xyz"), d): rng.randint(1, 30) for d in range(300)}.items(),
        columns=["key", "p"],
    )
    prices[["id", "t", "d"]] = pd.DataFrame(prices["key"].tolist())
    prices = prices.drop(columns="key")
    statements = pd.DataFrame(
        [(i, rng.randint(1, 30), ref) for i in ("hot", "a", "b") for ref in range(1, 9)],
        columns=["id", "p", "ref"],
    )
    want = brute_asof(prices, statements)
    left = spark.createDataFrame(prices)
    right = spark.createDataFrame(statements).withColumnRenamed("p", "sp")
    for n in (1, 9):
        a = asof.asof_join(left.repartition(n), right, ["id"], ["id", "t"], "p", "sp", ["ref"], ["ref"])
        b = asof.asof_join_by_period(left, right.repartition(n), ["id"], "p", "sp", ["ref"], ["ref"])
        c = asof.asof_join(left.repartition(n), right, ["id"], ["id", "t"], "p", "sp", ["ref"], ["ref"], within_range=True)
        for out in (a, b, c):
            assert sorted(tuple(r) for r in out.select("id", "t", "d", "ref").collect()) == want or (
                sorted(((r.id, r.t, r.d, r.ref) for r in out.collect()), key=str) == sorted(want, key=str)
            )


def test_copies_follow_the_length_of_many_short_series(spark):
    """A key with 300 series of three rows each and 200 records: series times records would be 60000 copies."""
    rows = spark.range(900).select(
        F.lit("c").alias("id"), (F.col("id") % 300).alias("t"), ((F.col("id") % 300) * 2 + F.floor(F.col("id") / 300)).alias("p")
    )
    records = spark.range(200).select(F.lit("c").alias("id"), (F.col("id") * 3).alias("sp"), F.col("id").alias("ref"))
    records = records.union(records.where("ref % 2 = 0").selectExpr("id", "sp", "ref + 1000"))
    copies = asof.copies_within_range(rows, records, ["id"], ["id", "t"], "p", "sp", ["ref"])
    assert 300 <= copies.count() <= rows.count() + records.count()
    near, far = (
        sorted(map(tuple, asof.asof_join(rows, records, ["id"], ["id", "t"], "p", "sp", ["ref"], ["ref"], within_range=w).collect()))
        for w in (True, False)
    )
    assert near == far


def test_asof_rows_without_key_stay_unmatched_and_where_they_are(spark):
    rows = spark.createDataFrame(
        [(None, "x", 5), (None, "x", 6), ("a", None, 5), ("a", "x", 1)], "id string, t string, p int"
    )
    records = spark.createDataFrame([("a", 3, 7), (None, 3, 8)], "id string, sp int, ref int")
    a = asof.asof_join(rows, records, ["id"], ["id", "t"], "p", "sp", ["ref"], ["ref"])
    b = asof.asof_join_by_period(rows, records, ["id"], "p", "sp", ["ref"], ["ref"])
    assert {r["ref"] for r in b.filter("id IS NULL").collect()} == {None} and b.count() == 4
    got = {(r["id"], r["t"], r["p"]): r["ref"] for r in b.collect()}
    assert got["a", None, 5] == 7 and got["a", "x", 1] is None
    got = {(r["id"], r["t"], r["p"]): r["ref"] for r in a.collect()}
    assert len(got) == a.count() == 4 and got[None, "x", 5] is None and got["a", "x", 1] is None
    lost = asof._without_key(rows, records, ["id"], ["ref"])[1]
    assert "Exchange" not in lost._jdf.queryExecution().executedPlan().toString()


def test_component_join_rejects_december_in_january(spark):
    left = spark.createDataFrame([("c", 2021, 1), ("c", 2021, 12), ("c", 2019, 12)], "id string, y int, m int")
    right = spark.createDataFrame(
        [("c", 2020, 12, "dec20"), ("c", 2020, 1, "jan20"), ("c", 2021, 3, "mar21")],
        "id string, ry int, rm int, tag string",
    )
    out = asof.component_theta_join(left, right, ["id"], "y", "m", "ry", "rm", ["tag"], ["tag"])
    assert {(r.y, r.m): r.tag for r in out.collect()} == {
        (2021, 1): "jan20",
        (2021, 12): "mar21",
        (2019, 12): None,
    }


def test_model_table_edges(spark):
    days = [D(2020, m, 15) for m in range(1, 9)]
    prices = spark.createDataFrame(
        [(d, "c1", "T", 100.0 + i, "BR1") for i, d in enumerate(days)]
        + [(days[0], "c1", "T", 1.0, "BR1"), (days[0], plan.UNKNOWN_COMPANY, "T", 1.0, "BR0")],
        "date date, id_cnpj string, ticker string, adj_close double, id_isin string",
    )
    ts = dt.datetime
    statements = spark.createDataFrame(
        [
            ("c1", D(2019, 12, 31), 2019, "Co", ts(2020, 1, 1), 1.0),
            ("c1", D(2019, 12, 31), 2019, "Co", ts(2020, 2, 1), 2.0),  # processed later: survives
            ("c1", D(2020, 3, 31), 2020, "Co", ts(2020, 4, 1), 3.0),
            ("c1", None, 2020, "Co", ts(2020, 4, 1), 9.0),
        ],
        "id_cnpj string, dt_refer date, dt_year int, txt_company_name string, processed_at timestamp, amt double",
    )
    full = plan.build_model_table(prices, statements, drop_unmatched=False)
    got = {r["date"].month: (r["dt_refer"], r["amt"]) for r in full.collect()}
    # December's statement shows once the date less 90 days falls in December; March's from June's end
    assert got[3] == (D(2019, 12, 31), 2.0) and got[6] == (D(2020, 3, 31), 3.0)
    assert got[5][1] == 2.0
    assert set(got) == set(range(3, 9))
    assert plan.build_model_table(prices, statements).count() == 6
    early = plan.build_model_table(prices, statements.filter("dt_year = 2020"))
    assert {r["date"].month for r in early.collect()} == {7, 8, 6}


def test_asof_shuffles_prices_twice_and_never_fans_out(spark, small):
    prices, statements = fixtures.prices(spark, small), fixtures.statements(spark, small)
    out = plan.build_model_table(prices, statements, since="1990-01-01", drop_unmatched=False)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    # the panel's rows move for the dedup and for join, lags and target together; the third is the series list
    assert len(re.findall(r"Exchange hashpartitioning\(date#\d+, id_cnpj#", text)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(id_cnpj#\d+, ticker#", text)) == 2
    joined = plan.join_statements(
        plan.prepare_prices(prices, "1990-01-01"), plan.prepare_statements(statements)
    )
    assert joined.count() == prices.filter(f"id_cnpj <> '{plan.UNKNOWN_COMPANY}'").count()


def naive(df, windows):
    parts = []
    for n in windows:
        over = f"OVER (PARTITION BY id_cnpj, ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        before = f"OVER (PARTITION BY id_cnpj, ticker ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        parts += [
            f"avg(adj_close) {over} AS amt_avg_adj_close_{n}",
            f"stddev_samp(adj_close) {over} AS amt_std_adj_close_{n}",
            f"min(adj_close) {over} AS amt_min_adj_close_{n}",
            f"max(adj_close) {over} AS amt_max_adj_close_{n}",
            f"regr_slope(adj_close, t) {over} AS amt_beta_adj_close_{n}",
            f"CAST(adj_close > max(adj_close) {before} AS INT) AS cat_adj_close_broke_high_{n}",
            f"CAST(adj_close < min(adj_close) {before} AS INT) AS cat_adj_close_broke_low_{n}",
        ]
    t = "CAST(row_number() OVER (PARTITION BY id_cnpj, ticker ORDER BY date) AS DOUBLE) AS t"
    return df.selectExpr("*", t).selectExpr("date", "ticker", *parts)


@pytest.mark.parametrize("with_nulls", [False, True])
def test_tiled_windows_equal_full_frames(spark, with_nulls):
    rng = random.Random(5)
    values = [round(rng.uniform(-50, 50), 2) for _ in range(420)]
    if with_nulls:
        values = [None if rng.random() < 0.2 else v for v in values]
    windows = [1, 2, 5, 7, 30, 31, 60, 77, 160, 361]
    df = panel(spark, values).unionByName(panel(spark, values[:9], "U"))
    p = rolling.RollingFeatures(df, plan.SERIES, ["date"]).stats("adj_close", windows)
    p.slopes("adj_close", windows).breakouts("adj_close", windows, True).breakouts("adj_close", windows, False)
    ours = p.build().toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    want = naive(df, windows).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    for c in want.columns[2:]:
        a, b = ours[c].astype(float), want[c].astype(float)
        assert (a.isna() == b.isna()).all(), c
        assert (a - b).abs().fillna(0).max() < 1e-7, c


def test_constant_window_has_no_spread_and_full_strength(spark):
    df = panel(spark, [0.1] * 200)
    p = rolling.RollingFeatures(df, plan.SERIES, ["date"]).stats("adj_close", [5, 90, 160])
    out = p.strength("adj_close", [10]).build().filter("date > '2020-01-02'").toPandas()
    for n in (5, 90, 160):
        assert out[f"amt_std_adj_close_{n}"].max() < 1e-12
    assert (out["amt_IFR_adj_close_10"] == 100).all()


def test_price_and_statement_features_cover_the_vocabulary(spark, small):
    names = rolling.price_features(fixtures.prices(spark, small), plan.SERIES, ["date"]).columns
    assert set(V.price_feature_columns()) <= set(names)
    names = statement_features(fixtures.statements(spark, small), ["id_cnpj"], "dt_refer").columns
    assert set(V.statement_feature_columns()) <= set(names)
    assert len(V.model_columns()) == len(set(V.model_columns())) == 250
    assert len([c for c in V.model_columns() if c not in V.non_features()]) == 234


def test_features_share_one_shuffle(spark):
    out = rolling.price_features(
        panel(spark, [1.0]).selectExpr("*", "adj_close close", "adj_close high_price", "adj_close low_price"),
        plan.SERIES,
        ["date"],
    )
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1


def test_year_filter_reaches_the_scan(spark, small, tmp_path):
    from pitscore.plans.scoring import training_table
    from pitscore.sources import io

    prices, statements = fixtures.prices(spark, small), fixtures.statements(spark, small)
    io.write_parquet(
        plan.build_model_table(prices, statements, since="1990-01-01"), str(tmp_path / "model")
    )
    table = training_table(io.read_parquet(spark, str(tmp_path / "model")), 2000)
    text = table._jdf.queryExecution().executedPlan().toString()
    assert "dt_year" in text.split("PartitionFilters:")[1].split("]")[0]
    assert table.count() > 0


def test_full_model_table_shuffles_bare_prices(spark, small):
    full = plan.build_full_model_table(fixtures.messy_prices(spark, small), fixtures.messy_statements(spark, small), "1995-03-31")
    text = full._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("Union") :]  # what is joined, and shuffled by series after it
    assert "_n_adj_close_30" in text and "_n_adj_close_30" not in below


def test_training_panel_shuffles_no_features(spark, small):
    text = catalog.training_panel(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "_d_adj_close" in text and "_d_adj_close" not in text[text.index("Union") :]
    assert "amt_groos_revenue, amt_groos_revenue" not in text  # amounts nobody asked for are not carried


def test_features_joined_later_are_the_same(spark, small):
    prices, statements = fixtures.prices(spark, small), fixtures.statements(spark, small)

    def rich(df):
        return rolling.RollingFeatures(df, plan.SERIES, ["date"]).stats("adj_close", [5]).slopes("adj_close", [11]).build()

    for since in ("1995-03-31", "1999-01-15"):
        before = plan.build_model_table(rich(prices), statements, since=since)
        after = plan.build_model_table(prices, statements, since=since, features=rich).select(*before.columns)
        assert before.count() > 0 and before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()
