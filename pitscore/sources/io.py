"""Reading and writing tables, metrics and fitted models."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IV_SCHEMA = "name string, iv double, n_bins bigint"
METRIC_COLUMNS = ["run", "split", "metric", "period", "value"]
METRIC_SCHEMA = "split string, metric string, period string, value double, run string"


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ("dt_year",)) -> None:
    """Overwrite a table. Partitioning by year lets later year filters skip files."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_iv_csv(spark: SparkSession, path: str, schema: str = IV_SCHEMA) -> DataFrame:
    """The columns of ``schema`` from a CSV file with a header, by name; other columns may stand anywhere.
    A missing column is an error."""
    raw = spark.read.option("header", True).csv(path)
    wanted = [part.split() for part in schema.split(",")]
    missing = [name for name, _ in wanted if name not in raw.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return raw.select(*[F.col(name).cast(kind).alias(name) for name, kind in wanted])


def metric_rows(
    df: DataFrame, run: str, metrics: Mapping[str, str] | Sequence[str], split: str, period: str | None = None
) -> DataFrame:
    """Turn metric columns into rows ``run, split, metric, period, value``.

    ``metrics`` lists columns, or maps a column to the name it is stored under. ``period`` names a
    column holding the key of a dictionary-like metric.
    """
    names = dict(metrics) if isinstance(metrics, Mapping) else {m: m for m in metrics}
    lines = F.array(
        *[
            F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
            for c, name in names.items()
        ]
    )
    key = F.col(period).cast("string") if period else F.lit(None).cast("string")
    return df.select(
        F.lit(run).alias("run"), F.col(split).alias("split"), key.alias("period"), F.inline(lines)
    ).select(*METRIC_COLUMNS)


def param_rows(spark: SparkSession, run: str, params: Mapping[str, object], split: str = "params") -> DataFrame:
    """Parameters of a run as metric rows: the value as text in ``period``, and as number where it is one."""
    rows = [
        (run, split, k, str(v), float(v) if isinstance(v, (int, float)) else None)
        for k, v in sorted(params.items())
    ]
    return spark.createDataFrame(
        rows, "run string, split string, metric string, period string, value double"
    )


def trial_rows(spark: SparkSession, run: str, log: Sequence[tuple]) -> DataFrame:
    """The trials of a search as metric rows, one split ``trial_<number>`` each."""
    rows = []
    for trial, family, params, value in log:
        found = {"family": family, "objective": value, **params}
        rows += [
            (run, f"trial_{trial}", k, str(v), float(v) if isinstance(v, (int, float)) else None)
            for k, v in sorted(found.items())
        ]
    return spark.createDataFrame(
        rows, "run string, split string, metric string, period string, value double"
    )


def write_metrics(rows: DataFrame, path: str) -> None:
    """Add a run to the metrics table. Writing a run again replaces that run only, so a repeated job
    leaves no duplicates."""
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run")
        .parquet(path)
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The schema is given, so a run named ``001`` stays text."""
    return spark.read.schema(METRIC_SCHEMA).parquet(path).select(*METRIC_COLUMNS)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="pitscore-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


_shared: set[str] = set()


def share_package(spark: SparkSession) -> None:
    """Sends this package to the workers once per application, so that tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shared:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{root.name}-core.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(target)
    _shared.add(context.applicationId)


_kept: list[list[str]] = []


@contextmanager
def work_tables(spark: SparkSession):
    """Tables that ``materialize`` writes inside the block are deleted at its end; use what was read from
    them before that."""
    _kept.append([])
    try:
        yield
    finally:
        for path in _kept.pop():
            delete_path(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors and
    still allows column pruning and filter pushdown."""
    path = scratch_path(df.sparkSession, "table")
    if _kept:
        _kept[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
