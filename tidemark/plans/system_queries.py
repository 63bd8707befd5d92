"""Checkpoints, replication, topology, metrics, streams, and extensions beyond the ordered store."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics
from ..operators import blocks, index, journal, topology
from ..sources.snapshots import Mismatch, Snapshots
from ..sources.tables import event_log, extents, orders_index, peers, shared_folder, table
from ..streaming import tail
from .log_queries import LOG
from .registry import query

# -- checkpoints: months of orders are epochs

M = "select k, v, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) as cp from (select o_orderkey as k, o_custkey as v, o_orderdate from orders)"


def _epochs(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), ((F.year(d) - 1992) * 12 + F.month(d)).cast("long").alias("cp"))


@query(f"select cp, count(*) as n, min(k) as first_key, max(k) as last_key, count(*) - coalesce(lag(count(*)) over (order by cp), 0) as grown from ({M}) group by cp")
def cp_epoch_diff(spark, sf):
    per = _epochs(spark, sf).groupBy("cp").agg(F.count("*").alias("n"), F.min("k").alias("first_key"), F.max("k").alias("last_key"))
    before = F.lag("n").over(Window.orderBy("cp"))  # a row for each epoch
    return per.withColumn("grown", F.col("n") - F.coalesce(before, F.lit(0)))


CPS = f"select v % 5 as grp, cp as cp_id, max(k) as cp_lsn from ({M}) group by all"


@query(f"select *, lag(cp_lsn, 2) over (partition by grp order by cp_id) as truncate_lsn from ({CPS})")
def cp_lag2_truncate(spark, sf):
    cps = _epochs(spark, sf).groupBy((F.col("v") % 5).alias("grp"), F.col("cp").alias("cp_id")).agg(F.max("k").alias("cp_lsn"))
    return journal.lagged_truncation(cps)


# -- published versions: even keys are the first, a crash leaves a second one without manifest

KV = "select o_orderkey as k, o_custkey as v from orders"


def _published(spark, sf) -> tuple[Snapshots, object]:
    state = orders_index(spark, sf).select("k", "v")
    store = Snapshots(spark, _shared(spark))
    store.commit({"index": state.where("k % 2 = 0"), "audit": state.where("k % 2 = 0").groupBy().count()}, cp_lsn=100, base=0, sealer="audit")
    return store, state


@query(f"select k, case when k % 5 = 0 and k > 100 then v + 1 else v end as v from ({KV}) where (k % 2 = 0 or (k % 5 = 0 and k > 100)) and not (k % 10 = 0 and k > 100)")
def cp_crash_recovery(spark, sf):
    """The folder of the version that never was published isn't read; the journal after the checkpoint is replayed."""
    store, state = _published(spark, sf)
    state.select("k", (-F.col("v")).alias("v")).write.parquet(f"{store.folder}/v2/index")
    journal = state.where("k % 5 = 0").select(F.col("k").alias("lsn"), "k", F.when(F.col("k") % 10 != 0, F.col("v") + 1).alias("v"))
    return store.recovered("index", journal)


@query(f"select * from (values (1, 'cp_mismatch', 1), (2, 'success', 2)) t(attempt, status, version), (select count(*) as n from ({KV}) where k % 3 = 0)")
def cp_mismatch_retry(spark, sf):
    """A writer that has read version 0 is refused once 1 is out; it reads again and publishes 2."""
    store, state = _published(spark, sf)
    seen, base, table_ = [], 0, {"index": state.where("k % 3 = 0")}
    while not seen or seen[-1][1] != "success":
        try:
            seen.append((len(seen) + 1, "success", store.commit(table_, 200, base)))
        except Mismatch:
            base = store.version()
            seen.append((len(seen) + 1, "cp_mismatch", base))
    return spark.createDataFrame(seen, "attempt int, status string, version int").join(store.read("index").agg(F.count("*").alias("n")))


@query(f"select version, n_tables, cp_lsn, n from (values (1, 2, 100), (2, 1, 200)) t(version, n_tables, cp_lsn), (select count(*) as n from ({KV}) where k % 2 = 0)")
def cp_switch_over(spark, sf):
    """Manifests in order; the second version takes the index of the first along unchanged."""
    store, _ = _published(spark, sf)
    store.commit({"index": store.read("index")}, 200, 1)
    n = store.read("index", 2).agg(F.count("*").alias("n"))
    return store._manifests().select(F.col("version").cast("int"), F.size("tables").alias("n_tables"), F.col("cp_lsn").cast("int")).join(n)


@query(f"select k, v, (row_number() over (order by k) - 1) // 10 as page from ({KV}) where k % 2 = 0")
def repl_snapshot_objects(spark, sf):
    """A snapshot read in batches of ten keys."""
    return index.page_numbers(_published(spark, sf)[0].read("index"), "k", 10)


@query(f"select count(*) as n_entries, true as has_nodes, true as is_gone from ({KV}) where k % 2 = 0")
def index_destroy(spark, sf):
    store, _ = _published(spark, sf)
    freed = store.destroy("index")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store.folder}/v1/index")
    gone = not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.createDataFrame([(freed["n_entries"], freed["n_nodes"] > 0, gone)], "n_entries long, has_nodes boolean, is_gone boolean")


# -- replication

JE = "select store as grp, lsn // 2 as lsn, case when code = 'error' then 'rollback' when code in ('view', 'click') then 'precommit' else 'commit' end as event, idx as seq from ({LOG})".format(LOG=LOG)


def _journal(spark, sf):
    event = F.when(F.col("code") == "error", "rollback").when(F.col("code").isin("view", "click"), "precommit").otherwise("commit")
    return event_log(spark, sf).select(F.col("store").alias("grp"), F.expr("lsn div 2").alias("lsn"), event.alias("event"), F.col("idx").alias("seq"))


@query(f"select grp, lsn, arg_max(event, seq) as state, count(*) as n_events from ({JE}) group by all")
def repl_commit_fold(spark, sf):
    return journal.folded(_journal(spark, sf))


@query(f"select grp, lsn, before_lsn from (select *, lag(lsn) over (partition by grp order by seq) as before_lsn from ({JE}) where event = 'commit') where before_lsn >= lsn")
def repl_commit_order(spark, sf):
    return journal.commit_order(_journal(spark, sf))


@query(f"select store as server_id, lsn // 10 as term, lsn % 3 as dsn, min(lsn) as lsn, arg_min(code, lsn) as code, count(*) as n_copies from ({LOG}) group by 1, 2, 3")
def repl_dedup(spark, sf):
    rows = event_log(spark, sf).select(F.col("store").alias("server_id"), F.expr("lsn div 10").alias("term"), (F.col("lsn") % 3).alias("dsn"), "lsn", "code")
    return journal.deduplicated(rows)


@query(f"select store, lsn, case when lsn <= greatest(store % 20, store % 7) then 'skip' when lsn <= store % 20 + 10 then 'commit' else 'precommit' end as class from ({LOG})")
def repl_replay_class(spark, sf):
    s = F.col("store")
    return event_log(spark, sf).select("store", "lsn", journal.replay_class(F.col("lsn"), s % 20, s % 7, s % 20 + 10).alias("class"))


@query(f"select grp, code, count(*) as n, min(lsn) as first_lsn from (select store % 8 as grp, code, lsn from ({LOG})) group by all")
def repl_commit_dispatch(spark, sf):
    rows = event_log(spark, sf).select((F.col("store") % 8).alias("grp"), "code", "lsn")
    return rows.groupBy("grp", "code").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"))


ROUNDS = f"select store as grp, lsn as round, idx as commit, idx - cents % 900 as min_idx, idx - cents % 333 as cp from ({LOG})"


@query(f"select *, max(least(greatest(commit - 500, min_idx), cp)) over (partition by grp order by round) as boundary from ({ROUNDS})")
def repl_truncate_boundary(spark, sf):
    i, c = F.col("idx"), F.col("cents")
    rounds = event_log(spark, sf).select(F.col("store").alias("grp"), F.col("lsn").alias("round"), i.alias("commit"), (i - c % 900).alias("min_idx"), (i - c % 333).alias("cp"))
    return journal.truncate_boundary(rounds, 500)


PEERS = "select s_nationkey as grp, s_suppkey as peer, s_suppkey * 37 % 5000 as idx, cast(s_suppkey * 13 % 101 as int) as priority, s_suppkey % 5 != 0 as can_vote from supplier"


@query(f"select grp, peer, idx from (select *, max(idx) over (partition by grp) t from ({PEERS})) where t - idx <= 2000")
def repl_active_peers(spark, sf):
    return journal.active(peers(spark, sf)).select("grp", "peer", "idx")


@query(f"select grp, q as quorum, idx as quorum_idx from (select *, count(*) over (partition by grp) // 2 + 1 as q, row_number() over (partition by grp order by idx desc, peer) n from ({PEERS}) where can_vote) where n = q")
def repl_quorum(spark, sf):
    return journal.quorum(peers(spark, sf))


@query(f"select grp, arg_max(peer, priority * 1000000 - peer) as leader from ({PEERS}) group by grp")
def repl_expected_leader(spark, sf):
    return journal.expected_leader(peers(spark, sf))


@query("select n_nationkey, case when n_nationkey = 0 then 100 else 1 + cast(ceil(100.0 * pow(0.8, least(n_nationkey, 5))) as bigint) end as follower_priority from nation")
def repl_leader_priority(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", journal.follower_priority(n).alias("follower_priority"))


@query(f"select store, lsn, store + 150 - lsn > 100 as is_resync from ({LOG})")
def repl_resync_mode(spark, sf):
    return event_log(spark, sf).select("store", "lsn", journal.resync(F.col("store") + 150, F.col("lsn")).alias("is_resync"))


REQS = f"select idx, lsn as dsn, 40 as next_dsn, cents % 700 as age_s, case when code = 'purchase' then 'LOG_FLUSHED' else 'LOG_RECEIVED' end as state, store % 6 = 0 as is_leader from ({LOG})"


@query(f"select idx, dsn from ({REQS}) where not is_leader and dsn < next_dsn - 1 and age_s > 300 and state != 'LOG_FLUSHED'")
def repl_gc(spark, sf):
    state = F.when(F.col("code") == "purchase", "LOG_FLUSHED").otherwise("LOG_RECEIVED")
    reqs = event_log(spark, sf).select("idx", F.col("lsn").alias("dsn"), F.lit(40).alias("next_dsn"), (F.col("cents") % 700).alias("age_s"), state.alias("state"), (F.col("store") % 6 == 0).alias("is_leader"))
    return journal.expired(reqs).select("idx", "dsn")


SWAP = f"select grp, min(peer) as out, max(peer) as into from ({PEERS}) group by grp"


def _swap(spark, sf):
    return peers(spark, sf).groupBy("grp").agg(F.min("peer").alias("out"), F.max("peer").alias("into"))


@query(
    f"with p as ({PEERS}), a as (select s.*, case when s.grp % 2 = 0 then -1 else s.out end as o, s.grp % 7 != 0 as is_leader, case when s.grp % 3 = 0 then null when s.grp % 3 = 1 then 't' else 'u' end as stored from ({SWAP}) s)"
    " select grp, 't' as task, case when not is_leader then 'NOT_LEADER' when stored is null then case when not exists (select 1 from p where p.grp = a.grp and p.peer = a.o) and exists (select 1 from p where p.grp = a.grp and p.peer = a.into)"
    " then case when grp % 5 = 0 and (select count(*) from p where p.grp = a.grp) > 1 then 'UNKNOWN' else 'COMPLETED' end else 'TASK_NOT_FOUND' end when stored != 't' then 'TASK_ID_MISMATCH' else 'IN_PROGRESS' end as status from a"
)
def repl_replace_status(spark, sf):
    g = F.col("grp")
    now = peers(spark, sf).groupBy("grp").agg(F.collect_set("peer").alias("all"))
    asks = _swap(spark, sf).join(now, "grp").select(
        "grp", F.lit("t").alias("task"), (g % 7 != 0).alias("is_leader"), F.when(g % 3 == 0, F.lit(None)).when(g % 3 == 1, "t").otherwise("u").alias("stored_task"),
        F.when(g % 2 == 0, F.lit(-1).cast("long")).otherwise(F.col("out")).alias("out"), "into", F.when(g % 5 == 0, F.array("into")).otherwise(F.col("all")).alias("members"),
    )
    return journal.replace_status(asks, peers(spark, sf))


@query(
    f"with p as ({PEERS}), s as ({SWAP}) select s.grp, coalesce(l.n, 0) as n_left, q.need, coalesce(l.n, 0) >= q.need as is_safe from s"
    " join (select grp, count(*) filter (can_vote) // 2 + 1 as need from p group by grp) q on q.grp = s.grp"
    " left join (select a.grp, count(*) n from (select *, max(idx) over (partition by grp) t from p) a join s on s.grp = a.grp where t - idx <= 2000 and a.peer != s.out and a.peer != s.into group by 1) l on l.grp = s.grp"
)
def repl_quorum_safety(spark, sf):
    return journal.quorum_safe(peers(spark, sf), _swap(spark, sf))


@query(f"with p as ({PEERS}) select s.grp, s.out, s.into, i.idx + 2000 >= o.idx as is_caught_up from ({SWAP}) s join p o on o.peer = s.out join p i on i.peer = s.into")
def repl_catch_up(spark, sf):
    return journal.caught_up(peers(spark, sf), _swap(spark, sf))


@query(f"select grp, peer, case when change = 'learner' then 'learner' else 'voter' end as role from (select store % 20 as grp, lsn % 9 as peer, arg_max(case code when 'error' then 'remove' when 'view' then 'learner' when 'click' then 'voter' else 'add' end, idx) as change from ({LOG}) group by 1, 2) where change != 'remove'")
def repl_members(spark, sf):
    change = F.when(F.col("code") == "error", "remove").when(F.col("code") == "view", "learner").when(F.col("code") == "click", "voter").otherwise("add")
    return journal.members(event_log(spark, sf).select((F.col("store") % 20).alias("grp"), (F.col("lsn") % 9).alias("peer"), change.alias("change"), F.col("idx").alias("seq")))


# -- devices and resources

CH = "select n_regionkey as pdev, n_nationkey as vdev, s_suppkey as chunk, s_suppkey % 40 + 10 as capacity, s_suppkey % 10 as used from supplier join nation on s_nationkey = n_nationkey"


def _chunks(spark, sf):
    s = F.col("s_suppkey")
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("n_regionkey").alias("pdev"), F.col("n_nationkey").alias("vdev"), s.alias("chunk"), (s % 40 + 10).alias("capacity"), (s % 10).alias("used"))


@query(f"select pdev, vdev, cast(sum(capacity) as bigint) as capacity, cast(sum(used) as bigint) as used, count(*) as n_chunks from ({CH}) group by rollup (pdev, vdev)")
def dev_capacity_rollup(spark, sf):
    return topology.capacity(_chunks(spark, sf), "pdev", "vdev")


PLACES = "select s_nationkey as device, s_suppkey * 100 as lo, s_suppkey * 100 + 40 + s_suppkey % 60 as hi from supplier"


@query(f"select device, min(a) as lo from (select device, hi as a, lead(lo) over (partition by device order by lo) as b from ({PLACES}) union all select device, 0, min(lo) from ({PLACES}) group by device) where b is null or b - a >= 2000 group by device")
def dev_first_gap(spark, sf):
    s = F.col("s_suppkey")
    return topology.first_gap(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("device"), (s * 100).alias("lo"), (s * 100 + 40 + s % 60).alias("hi")), 2000)


@query(
    "with v as (select p_partkey as vdev, p_partkey * 97 + 5000 as size, p_partkey % 13 + 1 as n_chunks, p_partkey % 4 + 1 as streams from part),"
    " c as (select *, least(greatest(cast(ceil(n_chunks / streams) * streams as bigint), cast(ceil(size / 4000) as bigint)), greatest(greatest(size // 500, 1), cast(ceil(size / 4000) as bigint))) as chunks from v)"
    " select vdev, chunks, (size // chunks) // 16 * 16 as chunk_size, (size // chunks) // 16 * 16 * chunks as vdev_size from c"
)
def dev_vdev_compose(spark, sf):
    p = F.col("p_partkey")
    vdevs = table(spark, sf, "part").select(p.alias("vdev"), (p * 97 + 5000).alias("size"), (p % 13 + 1).alias("n_chunks"), (p % 4 + 1).alias("streams"))
    return topology.composed(vdevs, 500, 4000, 16).select("vdev", "chunks", "chunk_size", "vdev_size")


@query("select p_partkey, cast(least(floor(p_partkey * 10 * p_size / 50.0), 90) as bigint) as share, cast(ceil(ceil(p_partkey * 1000 * p_size / 100.0) / 4096.0) as bigint) * 4096 as bytes from part")
def dev_shares(spark, sf):
    p, n = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf, "part").select("p_partkey", topology.shares(p * 10, n, F.lit(50), F.lit(90)).alias("share"), topology.percent_size(p * 1000, n, 4096).alias("bytes"))


@query("select s_suppkey, s_suppkey * 7 % 101 as used_pct, case when s_suppkey * 7 % 101 >= 90 then 'critical' when s_suppkey * 7 % 101 >= 50 then 'high' else 'ok' end as level from supplier")
def res_thresholds(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") * 7 % 101).alias("used"), F.lit(100).alias("limit"))
    return topology.pressure(rows, "used", "limit").select("s_suppkey", "used_pct", "level")


# -- metrics

@query(f"select code, logdev, count(*) as n, cast(sum(cents) as bigint) as total from ({LOG}) group by all")
def metric_sum_count(spark, sf):
    return metrics.counters(event_log(spark, sf), ["code", "logdev"], "cents")


HIST = f"select code, case when cents < 1 then -1 else cast(floor(log2(cents)) as bigint) end as bucket, count(*) as n from ({LOG}) group by all"


@query(HIST)
def metric_histogram(spark, sf):
    return metrics.histogram(event_log(spark, sf), ["code"], "cents")


@query(f"select code, cast(sum(n) as bigint) as n, count(*) as n_buckets from ({HIST}) group by code")
def metric_reduced(spark, sf):
    return metrics.reduced(metrics.histogram(event_log(spark, sf), ["code"], "cents"), ["code"])


@query("select p_brand as component, cast(sum(p_size * 12) as bigint) as before, cast(sum(case when p_partkey % 2 = 0 then 2 * p_size else p_size * 12 end) as bigint) as after from part group by 1")
def metric_cardinality(spark, sf):
    series = table(spark, sf, "part").select(F.col("p_brand").alias("component"), "p_name", F.col("p_size").alias("entities"), F.lit(10).alias("buckets"), (F.col("p_partkey") % 2 == 0).alias("is_reduced"))
    return metrics.cardinality(series)


@query("select r_name, '{\"r_regionkey\":' || r_regionkey || ',\"n\":' || n || '}' as status from (select r_name, r_regionkey, count(*) n from region join nation on n_regionkey = r_regionkey group by all) where r_name in ('ASIA', 'EUROPE')")
def status_json(spark, sf):
    joined = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = joined.groupBy("r_name", "r_regionkey").agg(F.count("*").alias("n"))
    return metrics.status_json(per, "r_name", ["r_regionkey", "n"], ["ASIA", "EUROPE", "NOWHERE"])


X = "select doc_id as seq, cast(doc_id % 8 as int) as chunk, greatest(cast(ceil(coalesce(n_chars, 0) / 4096.0) as bigint), 1) as nblks from documents"
ENTRY = f"select seq, 1 as version, case when seq % 3 = 0 then 0 else 1 end as code, seq % 7 as server_id, seq * 1000003 as dsn, 'h' || chunk as header, 'key-' || seq as key, case when seq % 3 != 0 then [(chunk::bigint << 47) | (nblks << 31), (chunk::bigint << 47) | (1::bigint << 31) | nblks] else [] end as blkids, case when seq % 3 = 0 then 'data of ' || seq end as data from ({X})"


def _entries(spark, sf):
    seq, chunk, n = F.col("seq"), F.col("chunk"), F.col("nblks")
    ids = F.array(blocks.pack(chunk, F.lit(0), n), blocks.pack(chunk, n, F.lit(1)))
    return extents(spark, sf).select(
        "seq", F.lit(1).cast("long").alias("version"), F.when(seq % 3 == 0, 0).otherwise(1).cast("long").alias("code"), (seq % 7).alias("server_id"), (seq * 1000003).alias("dsn"),
        F.concat(F.lit("h"), chunk.cast("string")).alias("header"), F.concat(F.lit("key-"), seq.cast("string")).alias("key"),
        F.when(seq % 3 != 0, ids).otherwise(F.array().cast("array<long>")).alias("blkids"), F.when(seq % 3 == 0, F.concat(F.lit("data of "), seq.cast("string"))).alias("data"),
    )


@query(f"select seq, len(blkids) > 0 as is_linked, printf('%08X%08X%08X%016X%08X%08X%08X', version, code, server_id, dsn, strlen(header), strlen(key), case when len(blkids) > 0 then 8 * len(blkids) else strlen(data) end) || hex(header) || hex(key) || case when len(blkids) > 0 then array_to_string(list_transform(blkids, lambda b: printf('%016X', b)), '') else hex(data) end as entry from ({ENTRY})")
def repl_journal_entry(spark, sf):
    return journal.encoded(_entries(spark, sf)).select("seq", "is_linked", F.hex("entry").alias("entry"))


@query(ENTRY)
def repl_journal_entry_read(spark, sf):
    names = ["version", "code", "server_id", "dsn", "header", "key", "blkids", "data"]
    return journal.decoded(journal.encoded(_entries(spark, sf)).select("seq", "is_linked", "entry")).select("seq", *names)


@query("select s_nationkey as grp, count(*) as n_peers, cast(sum(1000000 + s_suppkey) as bigint) as total, cast(sum(s_suppkey * 37 % 5000) as bigint) as used, min(1000000 + s_suppkey - s_suppkey * 37 % 5000) as room from supplier group by 1")
def repl_group_capacity(spark, sf):
    return journal.group_capacity(peers(spark, sf).select("grp", "peer", (F.col("peer") + 1_000_000).alias("total"), F.col("idx").alias("used")))


@query("select grp, leader, leader = 7 as is_leader, n_peers, quorum, commit_lsn, append_lsn, case when grp % 6 = 5 then 'DESTROYED' when append_lsn < 0 then 'INIT' else 'ACTIVE' end as stage, grp % 6 != 5 and commit_lsn >= append_lsn as is_ready from (select s_nationkey as grp, arg_max(s_suppkey, (s_suppkey * 13 % 101) * 1000000 - s_suppkey) as leader, count(*) as n_peers, count(*) filter (s_suppkey % 5 != 0) // 2 + 1 as quorum, min(s_suppkey * 37 % 5000) as commit_lsn, case when s_nationkey % 4 = 0 then min(s_suppkey * 37 % 5000) when s_nationkey % 4 = 1 then -1 else max(s_suppkey * 37 % 5000) end as append_lsn from supplier group by 1)")
def repl_group_status(spark, sf):
    rows, g = peers(spark, sf), F.col("grp")
    progress = rows.groupBy("grp").agg(F.min("idx").alias("commit_lsn"), F.max("idx").alias("top"))
    append = F.when(g % 4 == 0, F.col("commit_lsn")).when(g % 4 == 1, -1).otherwise(F.col("top"))
    return journal.group_status(rows, progress.select("grp", "commit_lsn", append.alias("append_lsn"), (g % 6 == 5).alias("destroyed")), 7)


@query("select p_partkey, cast(ceil(ceil(p_size * 1000003 * (p_partkey % 100) / 100.0) / 4096.0) as bigint) * 4096 as size from part")
def dev_percent_size(spark, sf):
    return table(spark, sf, "part").select("p_partkey", topology.percent_size(F.col("p_size").cast("long") * 1000003, F.col("p_partkey") % 100, 4096).alias("size"))


# -- streams: what a stream leaves behind equals the batch

@query(f"select logdev, store, max(lsn) as tail_lsn, count(*) as n_records, arg_max(idx, lsn) as tail_idx from ({LOG}) group by all")
def stream_tail_equals_batch(spark, sf):
    """Events are streamed and aggregated in the device's order; the sink keeps the last state of each store."""
    folder = _shared(spark)
    event_log(spark, sf).select("logdev", "store", "lsn", "idx").write.parquet(f"{folder}/log")
    stream = tail.read_stream(spark, f"{folder}/log", "logdev int, store long, lsn long, idx long")
    tail.run_available(tail.store_tails(stream), f"{folder}/offsets", lambda df, n: df.withColumn("batch", F.lit(n)).write.parquet(f"{folder}/out/{n}"), mode="update")
    out = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    return out.groupBy("logdev", "store").agg(*[F.max_by(c, "batch").alias(c) for c in ("tail_lsn", "n_records", "tail_idx")])


def _shared(spark) -> str:
    """A new folder among those that the cluster shares."""
    return f"{shared_folder(spark)}/new-{uuid.uuid4().hex}"


# -- extensions: not in the ordered store, natural in Spark

@query("select c_mktsegment, o_orderstatus, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from orders join customer on o_custkey = c_custkey group by all")
def ext_join_aggregate(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def ext_anti_join(spark, sf):
    pending = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return table(spark, sf, "customer").join(pending, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def ext_cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("select user_id, event_id, count(*) over (partition by user_id order by event_id rows between 4 preceding and current row) as recent, event_id - lag(event_id) over (partition by user_id order by event_id) as gap from events")
def ext_window_frames(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.count("*").over(w.rowsBetween(-4, 0)).alias("recent"), (F.col("event_id") - F.lag("event_id").over(w)).alias("gap"))


@query("select o_custkey as key from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O' except select o_custkey from orders where o_orderstatus = 'P'")
def ext_set_operations(spark, sf):
    of = lambda s: table(spark, sf, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("key"))
    return of("F").intersect(of("O")).subtract(of("P"))


@query("select event_type, epoch(time_bucket(interval '1 hour', ts))::bigint as at, count(*) as n from events group by all")
def ext_tumbling(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n")).select("event_type", F.unix_timestamp("window.start").alias("at"), "n")


@query("select user_id, session, count(*) as n from (select user_id, cast(sum(new) over (partition by user_id order by ts, event_id) as bigint) as session from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as new from events)) group by all")
def ext_sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") < F.lag("ts").over(w) + F.expr("interval 6 hours"), 0).otherwise(1)
    rows = table(spark, sf, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query(None)
def ext_approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@query("select l_returnflag, true as parts_near, true as median_near from lineitem group by 1")
def ext_approx_within_bounds(spark, sf):
    """Approximate counts are within 15 % of the exact ones (three standard errors), the median within one rank in a hundred.

    Exact counts and ranks are taken from distinct values and their numbers: beside a distinct count, Spark would keep sketches for each part.
    """
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_partkey", "l_quantity")
    about = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("about"), F.percentile_approx("l_quantity", 0.5).alias("m"))
    parts = rows.select(F.col("l_returnflag").alias("flag"), "l_partkey").distinct().groupBy("flag").agg(F.count("l_partkey").alias("parts"))
    sizes = rows.groupBy(F.col("l_returnflag").alias("of"), "l_quantity").agg(F.count("*").alias("n")).groupBy("of")
    sizes = sizes.agg(F.percentile("l_quantity", F.array(F.lit(0.49), F.lit(0.51)), F.col("n")).alias("q"))
    met = about.join(parts, F.col("l_returnflag").eqNullSafe(F.col("flag"))).join(sizes, F.col("l_returnflag").eqNullSafe(F.col("of")))
    median = F.col("m").between(F.floor(F.get("q", F.lit(0))), F.ceil(F.get("q", F.lit(1))))
    return met.select("l_returnflag", F.col("about").between(0.85 * F.col("parts"), 1.15 * F.col("parts")).alias("parts_near"), F.coalesce(median, F.col("m").isNull()).alias("median_near"))


@query("select k, v, status from (select o_orderkey as k, o_custkey as v, o_orderstatus as status, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) n from orders) where n <= 2")
def ext_top_per_group(spark, sf):
    w = Window.partitionBy("v").orderBy(F.col("price").desc(), "k")
    return orders_index(spark, sf).withColumn("n", F.row_number().over(w)).where("n <= 2").select("k", "v", "status")
