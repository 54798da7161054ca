"""Queries that SQL can express give DuckDB's rows."""

import os

import pytest

from lumenmill.llm import registry
from tests.llm.conftest import SF

duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = db.sql(registry.SQL[name])
    cols = sorted(want.columns)
    got = registry.QUERIES[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(db.sql(f"select {', '.join(cols)} from ({registry.SQL[name]}) q").fetchall())
