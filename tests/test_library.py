"""Fixes that a table of another size or shape must not undo."""

import pytest
from pyspark.sql import functions as F

from pitscore.operators.profile import dataset_description
from pitscore.operators import binning, metrics, modeling, ranking
from pitscore.sources import io


def test_balanced_weight_ignores_missing_targets(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (None,)], "y int")
    got = {r.y: r[modeling.WEIGHT] for r in modeling.with_balanced_weight(df, "y").collect()}
    assert got == {1: 1.5, 0: 0.75, None: None}
    one = {r.y: r[modeling.WEIGHT] for r in modeling.with_balanced_weight(df.filter("y = 0"), "y").collect()}
    assert one == {0: 1.0}


def test_run_names_stay_text(spark, tmp_path):
    path = str(tmp_path / "metrics")
    rows = io.param_rows(spark, "001", {"family": "forest", "maxDepth": 3})
    io.write_metrics(rows.unionByName(io.trial_rows(spark, "001", [(0, "forest", {"maxDepth": 2}, 0.7)])), path)
    back = io.read_metrics(spark, path)
    assert dict(back.dtypes)["run"] == "string" and {r.run for r in back.collect()} == {"001"}
    got = {(r.split, r.metric): (r.period, r.value) for r in back.collect()}
    assert got["params", "family"] == ("forest", None) and got["params", "maxDepth"] == ("3", 3.0)
    assert got["trial_0", "objective"][1] == 0.7


def test_iv_file_is_read_by_name(spark, tmp_path):
    path = str(tmp_path / "iv")
    io.write_csv(spark.createDataFrame([("a", "ok", 3, 0.5)], "name string, status string, n_bins int, iv double"), path)
    assert io.read_iv_csv(spark, path).first().asDict() == {"name": "a", "iv": 0.5, "n_bins": 3}
    with pytest.raises(ValueError, match="gain"):
        io.read_iv_csv(spark, path, "name string, gain double")


def test_work_tables_are_removed(spark):
    with io.work_tables(spark):
        df = io.materialize(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3
    with pytest.raises(FileNotFoundError):
        open(path)


def test_groups_on_different_scales_are_split_alike(spark):
    """Each of forty groups on its own scale is cut by its own scores."""
    df = spark.range(40_000).select(
        (F.col("id") % 40).alias("g"), (F.col("id") % 40 * 1e6 + F.col("id")).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y")
    )
    counts = ranking.score_counts(df, "p", "y", ["g"])
    cuts = {r.g: r._cuts for r in ranking._cut_points(counts, ["g"], 256).collect()}
    assert len(cuts) == 40 and all(3 <= len(c) <= 16 for c in cuts.values())
    assert all(g * 1e6 <= x < (g + 1) * 1e6 for g, c in cuts.items() for x in c)
    got = ranking.running_counts(counts, ["g"], 256).groupBy("g").agg(F.max("c1"), F.max("c0"), F.max("t1"), F.max("t0"))
    assert all((r[1], r[2]) == (r[3], r[4]) for r in got.collect())


def test_one_reading_gives_all_ranking_metrics(spark):
    df = spark.range(500).select((F.col("id") % 7).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).alias("s"))
    for r in metrics.ranking_metrics(df, "y", "p", ["s"]).collect():
        own = df.filter(F.col("s") == r.s)
        assert r.ks == metrics.ks(own, "y", "p").first().ks
        assert abs(r.auc - metrics.roc_auc(own, "y", "p").first().auc) < 1e-12
        assert abs(r.average_precision - metrics.average_precision(own, "y", "p").first().average_precision) < 1e-12


def test_too_many_prebins_are_refused(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("p"), (F.col("id") % 2).cast("int").alias("y"))
    with pytest.raises(ValueError, match="prebins"):
        binning.optimal_bins(df, "p", "y", max_prebins=20)


def test_settings_do_not_depend_on_the_table():
    space = modeling.SEARCH_SPACES["all_variables"]["boosted"]
    assert {p["minInstancesPerNode"] for p in modeling.draw_params(space, 3, seed=1)} != {300}


def test_description_scans_a_table_of_many_types_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(12).selectExpr(
        "id AS `a.b`", "CASE WHEN id < 3 THEN NULL WHEN id < 5 THEN double('NaN') ELSE id % 2 - 0.0D END AS x",
        "CAST(id % 4 AS STRING) AS `column`", "date_add(DATE'2020-01-01', CAST(id % 3 AS INT)) AS n",
        "CAST(NULL AS STRING) AS nothing", "array(id % 2) AS list", "CAST(id % 5 AS DECIMAL(9, 2)) AS d",
    ).write.parquet(path)
    out = dataset_description(spark.read.parquet(path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    got = {r.column: (r.n_missing, r.n_distinct) for r in out.collect()}
    assert got == {"a.b": (0, 12), "x": (5, 2), "column": (0, 4), "n": (0, 3), "nothing": (12, 0), "list": (0, 2), "d": (0, 5)}
    assert dataset_description(spark.read.parquet(path).limit(0)).count() == 0
    assert dataset_description(spark.read.parquet(path).select()).count() == 0
