"""Known answers and model-based tests of the ordered store's operators."""

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import blocks, greedy, index, journal, logs, meta, mutate, topology
from tidemark.sources.catalog import Catalog
from tidemark.sources.snapshots import Mismatch, Snapshots
from tidemark.streaming import tail

KV = "k long, v long"
FEW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def kv(spark, rows):
    return spark.createDataFrame(rows, KV)


def dicted(df):
    return {r["k"]: r["v"] for r in df.collect()}


# -- index


def test_range_remove_counts(spark):
    state, counts = kv(spark, [(k, k + 1) for k in range(20)]), []
    for low, high in [(5, 10), (0, 2), (18, 19), (17, 17), (1, 5), (1, 20)]:
        state = mutate.range_remove(state, low, high)[0]
        counts.append(state.count())
    assert counts == [14, 11, 9, 8, 6, 0]


def test_tombstone_statuses_and_gc(spark):
    islands = kv(spark, [(k, 7) for k in [*range(1000, 2000), *range(3000, 4000)]])
    dead = mutate.tombstone(islands, 1100, 4099)
    assert dead.where("changed").count() == 1900 and mutate.tombstone(dead.drop("changed"), 1100, 4099).where("changed").count() == 0
    survivors, gone = mutate.tombstone_gc(mutate.tombstone(islands, 1100, 1899).drop("changed"), 1000, 3999)
    assert (survivors.count(), gone.count()) == (1200, 800) and mutate.tombstone_gc(survivors, 1000, 3999)[1].count() == 0
    one = mutate.tombstone(kv(spark, [(k, 1) for k in range(20)]), 10, 10)
    asks = kv(spark, [(3, 0), (10, 0), (40, 0)])
    assert {r["k"]: r["status"] for r in mutate.tombstone_status(one, asks).collect()} == {3: "success", 10: "filtered_out", 40: "not_found"}


@pytest.mark.parametrize("size", [75, 90])
def test_pages_join_to_all_keys(spark, size):
    df, seen, after = kv(spark, [(k * 3, k) for k in range(300)]), [], None
    while True:
        rows = index.page(df, "k", size, after).collect()
        seen += [r["k"] for r in rows]
        assert not rows or all(r["has_more"] == (len(seen) < 300) for r in rows)
        if not rows:
            break
        after = rows[-1]["k"]
    assert seen == [k * 3 for k in range(300)]


def test_any_neighbours_and_bounds(spark):
    df = kv(spark, [(k, k) for k in range(0, 40, 2)])
    pick = lambda which: [r["k"] for r in index.get_any(df, "k", which, 5, 20).collect()]
    assert (pick("left"), pick("right"), pick("mid"), pick("any")) == ([6], [20], [12], [6])
    assert sorted(r["slot"] for r in index.neighbours(df, "k", 1, 6).collect()) == [0, 1, 2, 3, 4, 5]
    assert index.range_query(df, "k", batch=0).collect() == [] and index.nth_entry(df, "k", 99).collect() == []
    assert index.normalised([(5, 9), (1, 2), (3, 4), (20, 10)]) == [(1, 9)]
    bounds = index.lower_bounds(df, "k", kv(spark, [(-1, 0), (3, 0), (38, 0), (39, 0)])).collect()
    assert {r["k"]: r["bound"] for r in bounds} == {-1: 0, 3: 4, 38: 38, 39: None}


KEYS = st.integers(0, 15)
STATES = st.dictionaries(KEYS, st.integers(0, 9), max_size=10)


@FEW
@given(STATES, STATES, st.sampled_from(["insert", "update", "upsert"]))
def test_put_equals_a_dict(spark, have, asked, kind):
    result = mutate.put(kv(spark, list(have.items())), kv(spark, list(asked.items())), kind=kind)
    want = dict(have)
    status = {}
    for k, v in asked.items():
        if kind == "insert" and k in have:
            status[k] = "already_exists"
        elif kind == "update" and k not in have:
            status[k] = "not_found"
        else:
            want[k], status[k] = v, "success"
    assert dicted(mutate.state_of(result)) == want
    assert {r["k"]: (r["status"], r["existing_v"]) for r in mutate.results_of(result).collect()} == {k: (s, have.get(k)) for k, s in status.items()}


@FEW
@given(STATES, KEYS, KEYS)
def test_ranges_equal_a_dict(spark, have, a, b):
    state = kv(spark, list(have.items()))
    assert dicted(mutate.range_remove(state, a, b)[0]) == {k: v for k, v in have.items() if not a <= k <= b}
    assert dicted(mutate.range_update(state, F.lit(77).cast("long"), a, b)) == {k: 77 if a <= k <= b else v for k, v in have.items()}
    if a <= b:
        put = {k: 5 + k - a for k in range(a, b + 1)}
        assert dicted(mutate.state_of(mutate.interval_put(state, a, b, 5))) == have | put
        assert dicted(mutate.state_of(mutate.interval_put(state, a, b, 5, kind="insert"))) == put | have


# -- logs


def log(spark, rows):
    return spark.createDataFrame([(0, s, n, i, f"d{i}") for i, (s, n) in enumerate(rows)], "logdev int, store long, lsn long, idx long, data string")


def test_log_prefix_gaps_and_reads(spark):
    rows = log(spark, [(1, 0), (1, 1), (1, 3), (2, 2), (1, 2), (1, 6)])
    assert {r["store"]: r["upto"] for r in logs.contiguous_upto(rows).collect()} == {1: 3, 2: -1}
    filled = {(r["store"], r["lsn"]): r["filled"] for r in logs.fill_gaps(rows).collect()}
    assert [k for k, f in filled.items() if f].__len__() == 4 and filled[1, 4] and not filled[1, 6]
    assert logs.read(rows, 1, 3).first()["data"] == "d2"
    for store, lsn, start in ((1, 4, 0), (1, 0, 1), (3, 0, 0)):
        with pytest.raises(Exception, match="out_of_range"):
            logs.read(rows, store, lsn, start).collect()
    jump = logs.truncate(rows, spark.createDataFrame([(0, 1, 9)], "logdev int, store long, upto long"))
    assert jump[0].where("store = 1").count() == 0 and {r["store"]: (r["start_lsn"], r["tail_lsn"]) for r in jump[1].collect()} == {1: (10, 9), 2: (0, 2)}


def test_greedy_folds(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate([5, 6, 1, 20, 3, 3])], "g int, o int, size long")
    fold = lambda reset: [(r["bucket"], r["offset"]) for r in greedy.folded(rows, ["g"], "o", "size", 10, reset).orderBy("o").collect()]
    assert fold(False) == [(0, 0), (1, 0), (1, 6), (2, 0), (3, 0), (3, 3)]
    assert fold(True) == [(0, 0), (0, 5), (1, 0), (1, 1), (2, 0), (2, 3)]


# -- blocks


def test_first_fit_never_overlaps(spark):
    asks = spark.createDataFrame([(c, s, s % 5 + 1) for c in (0, 1) for s in range(12)], "chunk int, seq long, nblks long")
    free = spark.createDataFrame([(c, 10 * i, 1 + (i + c) % 4) for c in (0, 1) for i in range(9)], "chunk int, blk_num long, free_blks long")
    got = greedy.first_fit(asks, free).toPandas()
    room = {(c, 10 * i + k) for c in (0, 1) for i in range(9) for k in range(1 + (i + c) % 4)}
    used = [(r.chunk, int(r.blk_num) + k) for r in got.itertuples() if not pd.isna(r.blk_num) for k in range(int(r.count))]
    assert len(used) == len(set(used)) and set(used) <= room
    placed = got.dropna().groupby(["chunk", "seq"])["count"].sum()
    assert all(placed[c, s] == s % 5 + 1 for c, s in placed.index) and got.blk_num.isna().any()


def test_extents(spark):
    used = spark.createDataFrame([(0, 4, 2), (0, 6, 1), (0, 10, 5), (0, 11, 1), (1, 0, 3)], "chunk int, blk_num long, nblks long")
    assert sorted(map(tuple, blocks.merged(used).collect())) == [(0, 4, 3), (0, 10, 5), (1, 0, 3)]
    assert sorted(map(tuple, blocks.free_gaps(used, 16).collect())) == [(0, 0, 4), (0, 7, 3), (0, 15, 1), (1, 3, 13)]
    most = spark.createDataFrame([(65535, 2**31 - 1, 65535)], "chunk int, blk_num long, nblks long")
    back = most.select(blocks.unpack(blocks.pack(F.col("chunk"), F.col("blk_num"), F.col("nblks"))).alias("e")).first()["e"]
    assert tuple(back) == (65535 if back[0] > 0 else -1, 2**31 - 1, 65535)


# -- metadata, journals, topology


def test_recovery_order_finds_cycles(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    types = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "type string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a")], "type string, dep string")
    assert {r["type"]: r["level"] for r in meta.recovery_order(types, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    with pytest.raises(ValueError, match="cycle"):
        meta.recovery_order(types, edges.union(spark.createDataFrame([("a", "c")], edges.schema)))


def test_wide_gaps_are_filled_in_pieces(spark):
    log = spark.createDataFrame([(0, 1, 0, 5, "a"), (0, 1, 3 * logs.PIECE + 9, 6, "b"), (0, 2, 2, 7, "c")], "logdev int, store long, lsn long, idx long, data string")
    got = logs.fill_gaps(log).groupBy("store", "filled").agg(F.count("*").alias("n"), F.min("lsn").alias("a"), F.max("lsn").alias("b")).collect()
    assert {tuple(r) for r in got} == {(1, False, 2, 0, 3 * logs.PIECE + 9), (1, True, 3 * logs.PIECE + 8, 1, 3 * logs.PIECE + 8), (2, False, 1, 2, 2), (2, True, 2, 0, 1)}


@pytest.mark.parametrize("reset_at", [False, True])
def test_folds_equal_a_walk(spark, reset_at):
    import random

    rnd = random.Random(4)
    rows = [(g, i, rnd.choice([0, 1, 2, 3, 9, 25])) for g in range(5) for i in range(rnd.randint(0, 80))]
    want, last, bucket, total = [], None, 0, 0
    for g, i, n in rows:
        if g != last:
            last, bucket, total = g, 0, 0
        if not reset_at and total and total + n > 20:
            bucket, total = bucket + 1, 0
        want.append((g, i, n, bucket, total))
        total += n
        if reset_at and total >= 20:
            bucket, total = bucket + 1, 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = greedy.folded(spark.createDataFrame(rows, "g long, i long, n long"), ["g"], "i", "n", 20, reset_at).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == want


def test_lower_bounds_without_a_bound(spark):
    have, asks = [3 * i for i in range(200)], [*range(0, 620, 7)]
    got = index.lower_bounds(spark.createDataFrame([(k,) for k in have], "k long").repartition(5), "k", spark.createDataFrame([(k,) for k in asks], "k long"))
    assert {r["k"]: r["bound"] for r in got.collect()} == {a: min((k for k in have if k >= a), default=None) for a in asks}


def test_writes_at_an_lsn(spark):
    log = spark.createDataFrame([(0, 1, n, n, f"d{n}") for n in (0, 1, 4)], "logdev int, store long, lsn long, idx long, data string")
    new = spark.createDataFrame([(0, 1, 3, 9, "x"), (0, 1, 4, 8, "y"), (0, 2, 0, 7, "z")], log.schema)
    state, status = logs.write(log, new)
    assert {tuple(r)[1:] for r in state.collect()} == {(1, 0, 0, "d0"), (1, 1, 1, "d1"), (1, 4, 4, "d4"), (1, 3, 9, "x"), (2, 0, 7, "z")}
    assert {tuple(r)[1:] for r in status.collect()} == {(1, 3, "success"), (1, 4, "already_exists"), (2, 0, "success")}
    back = logs.write_at(log, spark.createDataFrame([(0, 1, 1, 5, "n")], log.schema))
    assert {tuple(r)[2:] for r in back.collect()} == {(0, 0, "d0"), (1, 5, "n")}


def test_priorities_and_sizes(spark):
    df = spark.range(8).select(journal.follower_priority(F.col("id")).alias("p"), topology.percent_size(F.lit(10_000), F.col("id"), 512).alias("s"))
    assert [r["p"] for r in df.collect()] == [100, *(1 + math.ceil(100.0 * 0.8 ** min(n, 5)) for n in range(1, 8))]
    assert [r["s"] for r in df.collect()][:4] == [0, 512, 512, 512]


# -- snapshots and catalog


def test_snapshots_survive_a_crash(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/db")
    assert store.version() == 0
    assert store.commit({"t": kv(spark, [(1, 1), (2, 2)]), "seal": kv(spark, [(0, 9)])}, cp_lsn=5, sealer="seal") == 1
    kv(spark, [(7, 7)]).write.parquet(f"file://{tmp_path}/db/v2/t")  # written, never published
    again = Snapshots(spark, f"file://{tmp_path}/db")
    assert again.version() == 1 and dicted(again.read("t")) == {1: 1, 2: 2}
    journal_rows = spark.createDataFrame([(4, 1, 50), (6, 2, None), (7, 3, 30), (8, 3, 31)], "lsn long, k long, v long")
    assert dicted(again.recovered("t", journal_rows)) == {1: 1, 3: 31}
    assert again.commit({"t": again.recovered("t", journal_rows)}, cp_lsn=8, base=1) == 2
    with pytest.raises(Mismatch):
        store.commit({"t": kv(spark, [])}, cp_lsn=9, base=1)
    assert dicted(store.read("t", 1)) == {1: 1, 2: 2} and dicted(store.read("t")) == {1: 1, 3: 31}
    with pytest.raises(ValueError, match="schema"):
        Snapshots(spark, f"file://{tmp_path}/db", 2).read("t")


def test_catalog(spark):
    catalog = Catalog(spark)
    assert catalog.add("one", kv(spark, [(1, 1)])) == 0 and catalog.add("two", kv(spark, [])) == 1
    assert catalog.by_ordinal(0).count() == 1 and catalog.names() == ["one", "two"]
    with pytest.raises(ValueError):
        catalog.add("one", kv(spark, []))
    catalog.remove("one")
    with pytest.raises(KeyError):
        catalog.get("one")


# -- streams


def test_stream_of_out_of_order_records(spark, tmp_path):
    folder, schema = f"{tmp_path}/log", "logdev int, store long, lsn long, idx long"
    for n, lsns in enumerate([[0, 2, 5], [1], [4, 3]]):
        spark.createDataFrame([(0, 1, x, x) for x in lsns], schema).coalesce(1).write.mode("append").parquet(folder)
        seen = []
        tail.run_available(tail.contiguous(tail.read_stream(spark, folder, schema)), f"{tmp_path}/cp", lambda df, _: seen.extend(r["upto"] for r in df.collect()), "update")
        assert seen[-1] == [0, 2, 5][n]
