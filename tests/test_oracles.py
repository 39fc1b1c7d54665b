"""Every query with SQL gives the same rows as DuckDB; every other one runs and gives a stable schema."""

import math
import os

import duckdb
import pytest
from conftest import DATA

from stereoloom import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(values):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 else v
    return sorted((tuple(clean(v) for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows(df.select(*columns).collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_twice_alike(spark, name):
    """Two runs, with other partitionings, give the same rows."""
    first = rows(QUERIES[name](spark, DATA).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(QUERIES[name](spark, DATA).collect()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_flagship(spark):
    out = catalog.flagship(spark, DATA).collect()
    assert out and sum(r["samples"] for r in out) > 0
