"""Queries of the subpackage with SQL, against DuckDB."""

import os

import duckdb
import pytest

from channelflow.llm import queries as llm

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    ours, theirs = llm.queries()[name](spark, DATA).toPandas(), con.execute(llm.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].convert_dtypes().astype(str).sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert a.equals(b)
