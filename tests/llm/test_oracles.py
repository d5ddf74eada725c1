"""Queries with SQL give the rows that DuckDB gives for it."""

import pytest

from paperloom.llm import queries

TABLES = ("documents", "labels", "benchmark", "conversations")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, found = queries.queries()[name](spark, sf), c.sql(queries.oracle_sql()[name])
    order = [found.columns.index(x) for x in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
