"""Every registered query against its SQL equivalent on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as driver
from pitscore.oracle import ORACLES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df[c] = df[c].where(df[c].notna(), None).map(lambda v: None if v is None else str(v))
        else:
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, small, name):
    ours = driver.queries()[name](spark, small).toPandas()
    theirs = duck.sql(driver.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    a, b = canonical(ours), canonical(theirs)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), f"{c}: {a[c][~same].iloc[0]!r} vs {b[c][~same].iloc[0]!r}"


def test_entry_has_rows(spark):
    df = driver.entry(spark)
    assert df.count() > 0 and "var_target" in df.columns


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
