"""Queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

from pitscore.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    table = queries.QUERIES[name](spark, small).toArrow()  # read by the same engine, so that nulls leave integers as they are
    ours, theirs = con.from_arrow(table).df(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].astype(object).where(x[columns].notna(), None).astype(str) for x in (ours, theirs))
    a, b = (x.sort_values(columns).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)
