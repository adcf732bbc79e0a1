"""Stored sketches and bounded curves."""

import pytest
from pyspark.sql import functions as F

from pitscore.operators import binning, metrics, sketches
from pitscore.operators.profile import dataset_description


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(6000).select(
        (2000 + F.col("id") % 3).cast("int").alias("year"), F.col("id"),
        F.when(F.col("id") % 7 > 0, (F.col("id") * 37 % 1000) / 10.0).alias("value"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), F.col("id") % 11)).alias("name"),
        F.lit(None).cast("double").alias("none"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(1.0).alias("nan"),
        ((F.col("id") * 37 % 1000 > 600) != (F.col("id") % 4 == 0)).cast("int").alias("y"),
    )
    return rows.repartition(4)


COLUMNS = ["id", "value", "name", "none", "nan"]


def test_united_parts_describe_the_table(spark, table, tmp_path):
    path = str(tmp_path / "s")
    for year in (2000, 2001):  # one after the other, the second one twice
        sketches.store_sketches(table.where(F.col("year") == year), COLUMNS, "year", path)
    sketches.store_sketches(table.where("year >= 2001"), COLUMNS, "year", path)
    stored = sketches.read_sketches(spark, path)
    assert stored.count() == 3 * len(COLUMNS)
    got = {r.column: r for r in sketches.description(stored).collect()}
    for r in dataset_description(table.select(*COLUMNS)).collect():
        own = got[r.column]
        assert (own.type, own.n_missing) == (r.type, r.n_missing) and abs(own.pct_missing - r.pct_missing) < 1e-9
        assert abs(own.n_distinct - r.n_distinct) <= 0.05 * r.n_distinct
    one = {r.column: r.n_missing for r in sketches.description(stored.where("year = 2001")).collect()}
    assert one["none"] == 2000


def test_adding_a_part_reads_that_part(spark, table, tmp_path):
    """The files of other parts are neither read nor touched."""
    data, path = str(tmp_path / "data"), str(tmp_path / "s")
    table.write.partitionBy("year").parquet(data)
    sketches.store_sketches(spark.read.parquet(data), COLUMNS, "year", path)
    kept = {f for f in spark.read.parquet(path).inputFiles() if "year=2002" not in f}
    fresh = sketches.column_sketches(spark.read.parquet(data).where("year = 2002"), COLUMNS, "year")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    sketches.store_sketches(spark.read.parquet(data).where("year = 2002"), COLUMNS, "year", path)
    assert kept <= set(spark.read.parquet(path).inputFiles())


def test_edges_have_their_rank(spark, table):
    found = sketches.edges(sketches.column_sketches(table, COLUMNS, "year"), ["value", "none", "absent"], 10)
    assert found["none"] == found["absent"] == [] and len(found["value"]) == 9
    values = sorted(r[0] for r in table.select("value").where("value is not null").collect())
    for k, edge in enumerate(found["value"], 1):
        assert abs(sum(v <= edge for v in values) / len(values) - k / 10) < 0.04
    iv = {r.name: r.iv for r in binning.iv_table(table, ["value", "none"], "y", edges=found).collect()}
    exact = {r.name: r.iv for r in binning.iv_table(table, ["value", "none"], "y").collect()}
    assert exact["value"] > 0.5 and abs(iv["value"] - exact["value"]) < 0.5 * exact["value"]


def test_sketches_of_an_empty_table(table):
    none = sketches.column_sketches(table.limit(0), COLUMNS, "year")
    assert none.count() == 0 and sketches.edges(none, ["value"]) == {"value": []}


@pytest.mark.parametrize("cells", [1, 5, 40])
def test_curves_are_bounded_and_keep_ks(table, cells):
    scored = table.withColumn("prob", F.coalesce(F.col("id") * 101 % 5003 / 5003.0 + F.col("y") * 0.3, F.lit(0.0)))
    full = metrics.ks_points(scored, "y", "prob").toPandas()
    few = metrics.ks_curve(scored, "y", "prob", cells=cells).toPandas()
    assert len(few) <= 3 * (cells + 1) < len(full)
    assert abs(few.distance.max() - full.distance.max()) < 1e-12
    points = metrics.roc_curve(scored, "y", "prob", cells=cells).toPandas().sort_values(["fpr", "tpr"])
    x, y = [0.0, *points.fpr], [0.0, *points.tpr]
    area = sum((b - a) * (c + d) / 2 for a, b, c, d in zip(x, x[1:], y, y[1:], strict=False))
    exact = metrics.roc_auc(scored, "y", "prob").first()["auc"]
    n1 = scored.where("y = 1").count()
    assert abs(area - exact) <= 6000 * 6000 / (8 * cells * n1 * (6000 - n1)) + 1e-9
    same = metrics.roc_curve(scored.withColumn("prob", F.lit(0.5)), "y", "prob", cells=cells).collect()
    assert [(r.fpr, r.tpr) for r in same] == [(1.0, 1.0)]
