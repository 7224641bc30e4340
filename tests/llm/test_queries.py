"""Queries of this subpackage against their SQL, at the smallest scale."""

import duckdb
import pytest

from lectern.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for x in ("documents", "labels", "pages", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {x} AS SELECT * FROM read_parquet('{SF}/{x}.parquet')")
    own = queries.QUERIES[name](spark, SF)
    other = con.sql(queries.ORACLES[name])
    assert sorted(own.columns) == sorted(other.columns)
    order = sorted(own.columns)
    pick = lambda columns, rows: sorted((tuple(r[columns.index(c)] for c in order) for r in rows), key=repr)
    assert pick(own.columns, own.collect()) == pick(other.columns, other.fetchall())
