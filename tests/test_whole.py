"""Queries ask for all rows."""

import random

import pytest

import __spark_entry__  # noqa: F401
from tidemark.operators import greedy, index
from tidemark.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.01"


def test_all_customers_ask(spark):
    got = {r["g"]: r["bound"] for r in QUERIES["idx_lower_bounds_asof_all"](spark, FOLDER).collect()}
    events: dict = {}
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", "event_id").collect():
        events.setdefault(r[0], []).append(r[1])
    asks = [r[0] for r in spark.read.parquet(f"{FOLDER}/customer.parquet").select("c_custkey").collect()]
    assert got == {c: min((e for e in events.get(c, []) if e >= 7 * c), default=None) for c in asks} and len(asks) > 150


@pytest.mark.parametrize("name", ["blk_firstfit", "blk_fixed_alloc_all"])
def test_all_documents_ask(spark, name):
    docs = {r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    assert {r["seq"] for r in QUERIES[name](spark, FOLDER).collect()} == docs


def test_first_fit_equals_a_scan(spark):
    rnd = random.Random(3)
    asks = [(c, s, rnd.randint(1, 9)) for c in (0, 1, 2) for s in range(60)]
    free = [(c, 20 * i, rnd.randint(1, 8)) for c in (0, 1) for i in range(45)]
    space = {c: [[b, n] for d, b, n in free if d == c] for c in (0, 1, 2)}
    want = []
    for c, s, need in asks:
        whole = [x for x in space[c] if x[1] >= need][:1]
        some, left, taken = whole or [x for x in space[c] if x[1]][:6], need, []
        for x in some:
            taken.append((x, min(left, x[1])))
            left -= taken[-1][1]
        taken = [] if left else [(x, n) for x, n in taken if n]
        want += [(c, s, need, k, x[0], n) for k, (x, n) in enumerate(taken)] or [(c, s, need, None, None, None)]
        for x, n in taken:
            x[0], x[1] = x[0] + n, x[1] - n
    got = greedy.first_fit(spark.createDataFrame(asks, "chunk int, seq long, nblks long"), spark.createDataFrame(free, "chunk int, blk_num long, free_blks long"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.fixture()
def many_parts(spark):
    """Range partitions of which none is merged, and bounds from a part of the rows, as in larger tables."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "10"}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k in own:
        spark.conf.unset(k)


def test_page_numbers_of_many_parts(spark, many_parts):
    orders = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/orders.parquet").select("o_orderkey").orderBy("o_orderkey").collect()]
    got = {r["k"]: r["page"] for r in QUERIES["idx_page_numbers"](spark, "/root/testdata/sf0.1").collect()}
    assert got == {k: i // 90 for i, k in enumerate(orders)}


def test_lower_bounds_of_many_parts(spark, many_parts):
    have, asks = spark.range(0, 60000, 3).toDF("k"), spark.range(0, 60000, 7).toDF("k")
    got = {r["k"]: r["bound"] for r in index.lower_bounds(have, "k", asks).collect()}
    assert got == {k: b if (b := -(-k // 3) * 3) < 60000 else None for k in range(0, 60000, 7)}


def test_snapshot_objects_of_many_parts(spark, many_parts):
    keys = sorted(r[0] for r in spark.read.parquet("/root/testdata/sf0.1/orders.parquet").where("o_orderkey % 2 = 0").select("o_orderkey").collect())
    got = {r["k"]: r["page"] for r in QUERIES["repl_snapshot_objects"](spark, "/root/testdata/sf0.1").collect()}
    assert got == {k: i // 10 for i, k in enumerate(keys)}


def test_snapshot_objects_of_tied_keys(spark, tmp_path):
    """Pages of ten cut through the six rows of a key: these go by their values, however they lie in the files."""
    rows = [(k, v, "O", 1.0) for v in (5, 3, 4, 0, 2, 1) for k in range(200)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["repl_snapshot_objects"](spark, str(tmp_path)).collect()
    even = sorted((k, v) for k, v, *_ in rows if k % 2 == 0)
    assert sorted(map(tuple, got)) == [(k, v, i // 10) for i, (k, v) in enumerate(even)]


def test_ranks_beside_columns_without_order(spark):
    """A map can't be sorted by; a tie goes by what can, under any name."""
    rows = spark.createDataFrame([(k, v, {"a": v}) for v in (2, 0, 1) for k in range(9)], "k long, `v.1` long, m map<string,long>")
    got = sorted((r["k"], r["v.1"], r["m"]["a"], r["nth"]) for r in index.ranked(rows, "k").collect())
    assert got == [(k, v, v, 3 * k + v + 1) for k in range(9) for v in range(3)]


def test_approx_bounds_keep_no_sketch_for_each_part(spark, tmp_path):
    """Nulls and empty groups are near; no aggregation by part carries a sketch or a list."""
    rows = [(f, p, q) for f in ("A", None) for p in range(400) for q in (1.0, 50.0)] + [("N", None, None)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = QUERIES["ext_approx_within_bounds"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("A", True, True), (None, True, True), ("N", True, True)], key=repr)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    by_part = [line for line in plan.splitlines() if "Aggregate(keys=[" in line and "l_partkey" in line.split("functions=")[0]]
    assert by_part and not [line for line in by_part if "approx" in line or "percentile" in line]
