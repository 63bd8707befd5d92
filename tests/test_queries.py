"""Every registered query against DuckDB on the small shared tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    if isinstance(x, (bool, str, bytes, float)) or x is None:
        return x
    return [plain(y) for y in x] if isinstance(x, list) else int(x)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    order = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in order]).collect()), key=repr)
    have = duck.execute(SQL[name])
    columns = [c[0] for c in have.description]
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in have.fetchall()), key=repr)
    assert sorted(columns) == order and got == want


def test_rows_only_queries(spark):
    for name in sorted(set(QUERIES) - set(SQL)):
        assert QUERIES[name](spark, FOLDER).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
