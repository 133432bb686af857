"""Every query with SQL against DuckDB on the same tables; every other one gives rows of a stable schema."""

import datetime
import glob
import os

import duckdb
import pytest

from palimpsest.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 5)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_matches_sql(spark, sf, duck, name):
    f, sql = REGISTRY[name]
    df = f(spark, sf)
    got = df.collect()
    rel = duck.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, got) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if not sql])
def test_runs(spark, sf, name):
    df = REGISTRY[name][0](spark, sf)
    assert df.collect() is not None and len(set(df.columns)) == len(df.columns)
