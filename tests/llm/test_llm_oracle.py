"""Queries of the subpackage that have SQL, against it."""

from __future__ import annotations

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_sql(spark):
    from threadloom.llm import queries

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.sql(sql)
        got = queries.queries()[name](spark, DATA)
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
