"""The corpus queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

from cairn.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    done = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in done.description]
    assert sorted(names) == columns
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in done.fetchall()), key=str)
