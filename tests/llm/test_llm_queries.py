"""The corpus queries that SQL can state give the rows that DuckDB gives."""

import duckdb
import pytest

from cueframe.llm.entry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows(spark, tables, name):
    got = QUERIES[name](spark, SF)
    cursor = tables.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted(cursor.fetchall(), key=repr)
    assert want and sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == want
