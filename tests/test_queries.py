"""Every registered query against its SQL on the smallest tables."""

import datetime as dt
import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from gridlake.suite.queries import REGISTRY
from gridlake.suite.sql import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, dt.datetime) and value.time() == dt.time():
        return str(value.date())
    if isinstance(value, (dt.date, dt.datetime)):
        return str(value)
    if value is None or isinstance(value, (str, bool)):
        return value
    return None if math.isnan(value) else round(float(value), 6)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, db, name):
    sql = entry_module.oracle_sql()[name]
    df = entry_module.queries()[name](spark, SF)
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert table_of(df.columns, df.collect()) == table_of(want.columns, want.fetchall())


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLES)
    assert set(REGISTRY) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() == 1473
