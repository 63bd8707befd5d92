"""The operators' queries against DuckDB on the small shared tables, and all eleven run there."""

import glob
import os

import duckdb
import pytest

from tidemark.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = queries.QUERIES[name](spark, FOLDER)
    have = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in have.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, have.fetchall()))


def test_url_filter_equals_sql_where_urls_calibrate(spark):
    """At sf0.01 both verdicts are among the urls that judge() holds out by itself."""
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    have = con.execute(queries.ORACLE_SQL["op6_url_filter"])
    columns = [c[0] for c in have.description]
    got = queries.op6_url_filter(spark, "/root/testdata/sf0.01").select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, have.fetchall()))
