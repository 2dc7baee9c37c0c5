"""The operators' queries against their SQL."""

import os

import duckdb
import pytest

from clausewright.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{table}')")
    wanted = con.execute(ORACLES[name])
    columns = [d[0] for d in wanted.description]
    found = QUERIES[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    key = lambda row: tuple(map(str, row))
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=key) == sorted(wanted.fetchall(), key=key)
