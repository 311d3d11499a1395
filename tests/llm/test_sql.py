"""Numbered queries against their SQL over whole tables."""

import duckdb
import pytest
from gridlake.llm.queries import REGISTRY
from gridlake.llm.sql import ORACLES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = REGISTRY[name](spark, SF)
    want = db.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())
