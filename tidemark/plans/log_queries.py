"""Logs, block extents and metadata."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audit, blocks, greedy, logs, meta
from ..sources.tables import event_log, extents, shared_folder, table
from .registry import query

ALL = (
    "select cast(user_id % 4 as int) as logdev, user_id as store, row_number() over (partition by user_id order by event_id) - 1 as lsn, event_id as idx,"
    " length(props) as size, event_type as code, props as data, cast(round(value * 100) as bigint) as cents from events"
)
LOG = f"select * from ({ALL}) where idx % 17 != 0"
REC = "logdev, store, lsn, idx"


@query(f"select a.logdev, a.store, a.idx, coalesce(t.tail, -1) + row_number() over (partition by a.store order by a.idx) as lsn from (select * from ({ALL}) where idx % 17 = 0) a left join (select store, max(lsn) tail from ({LOG}) group by 1) t on t.store = a.store")
def log_append_lsn(spark, sf):
    new = event_log(spark, sf, holes=False).where("idx % 17 = 0").drop("lsn")
    return logs.append(event_log(spark, sf), new, "idx").select("logdev", "store", "idx", "lsn")


@query(f"select store, lsn, idx, data from ({LOG}) where store = 8 and lsn = 3")
def log_read(spark, sf):
    return logs.read(event_log(spark, sf), 8, 3).select(F.col("store").cast("long"), F.col("lsn").cast("long"), "idx", "data")


@query(f"select {REC} from (select *, coalesce(max(case when code = 'purchase' then 1 else 0 end) over (partition by store order by lsn rows between unbounded preceding and 1 preceding), 0) as s from ({LOG}) where lsn >= 2) where s = 0")
def log_foreach_until(spark, sf):
    return logs.foreach_until(event_log(spark, sf), 2, F.col("code") == "purchase").select("logdev", "store", "lsn", "idx")


@query(f"select s.logdev, s.store, coalesce(u.upto, 1) as upto from (select distinct logdev, store from ({LOG})) s left join (select store, max(case when lsn - 2 = n - 1 then lsn end) as upto from (select store, lsn, row_number() over (partition by store order by lsn) n from ({LOG}) where lsn >= 2) group by store) u on u.store = s.store")
def log_contiguous_upto(spark, sf):
    return logs.contiguous_upto(event_log(spark, sf), 2).select("logdev", "store", F.col("upto").cast("long"))


@query(f"select logdev, store, lsn, case when idx % 17 = 0 then null else idx end as idx, case when idx % 17 = 0 then null else data end as data, idx % 17 = 0 as filled from (select *, max(case when idx % 17 != 0 then lsn end) over (partition by store) m from ({ALL})) where lsn <= m")
def log_fill_gap(spark, sf):
    return logs.fill_gaps(event_log(spark, sf))


UPTO = f"select logdev, store, max(lsn) - 5 as upto from ({LOG}) where store % 3 = 0 group by all"


def _upto(spark, sf):
    return event_log(spark, sf).where("store % 3 = 0").groupBy("logdev", "store").agg((F.max("lsn") - 5).alias("upto"))


@query(f"select {', '.join('l.' + c for c in REC.split(', '))} from ({LOG}) l left join ({UPTO}) u on u.store = l.store where u.upto is null or l.lsn > u.upto")
def log_truncate(spark, sf):
    return logs.truncate(event_log(spark, sf), _upto(spark, sf))[0].select("logdev", "store", "lsn", "idx")


@query(f"select l.logdev, l.store, coalesce(max(u.upto), -1) + 1 as start_lsn, greatest(max(l.lsn), max(u.upto)) as tail_lsn from ({LOG}) l left join ({UPTO}) u on u.store = l.store group by all")
def log_truncate_bounds(spark, sf):
    return logs.truncate(event_log(spark, sf), _upto(spark, sf))[1]


@query(f"select logdev, coalesce(min(case when start_lsn - 1 != tail then trunc end), max(flushed)) as safe_idx from (select logdev, store, case when store % 5 = 0 then max(lsn) + 1 else 3 end as start_lsn, max(lsn) as tail, arg_max(idx, lsn) - 100 as trunc, max(idx) as flushed from ({LOG}) group by logdev, store) group by logdev")
def logdev_safe_truncate(spark, sf):
    stores = event_log(spark, sf).groupBy("logdev", "store").agg(
        F.when(F.col("store") % 5 == 0, F.max("lsn") + 1).otherwise(F.lit(3)).alias("start_lsn"), F.max("lsn").alias("tail_lsn"), (F.max_by("idx", "lsn") - 100).alias("trunc_idx"), F.max("idx").alias("flushed_idx")
    )
    return logs.safe_truncation(stores)


LATE = f"select logdev, store, lsn, case when lsn % 5 = 1 then 2 * idx + 801 else 2 * idx end as idx from ({LOG})"


@query(f"select *, arg_max(idx, lsn) over (partition by store order by idx rows between unbounded preceding and current row) as trunc_idx from ({LATE})")
def log_ooo_trunc_key(spark, sf):
    late = event_log(spark, sf).select("logdev", "store", "lsn", F.when(F.col("lsn") % 5 == 1, 2 * F.col("idx") + 801).otherwise(2 * F.col("idx")).alias("idx"))
    return logs.truncation_key(late)


TO = f"select logdev, store, max(lsn) - 4 as to_lsn from ({LOG}) where store % 2 = 0 group by all"
ROLLED = f"select l.logdev, l.store, min(idx) as lo, max(idx) as hi from ({LOG}) l join ({TO}) t on t.store = l.store where l.lsn > t.to_lsn group by all"


def _to(spark, sf):
    return event_log(spark, sf).where("store % 2 = 0").groupBy("logdev", "store").agg((F.max("lsn") - 4).alias("to_lsn"))


@query(f"select l.logdev, l.store, l.lsn, l.idx from ({LOG}) l left join ({TO}) t on t.store = l.store where t.to_lsn is null or l.lsn <= t.to_lsn")
def log_rollback(spark, sf):
    return logs.rollback(event_log(spark, sf), _to(spark, sf))[0].select("logdev", "store", "lsn", "idx")


@query(f"select r.* from ({ROLLED}) r join (select logdev, max(idx) - 60 as upto_idx from ({LOG}) group by 1) t on t.logdev = r.logdev where hi > upto_idx")
def log_rollback_prune(spark, sf):
    log = event_log(spark, sf)
    return logs.prune_rollbacks(logs.rollback(log, _to(spark, sf))[1], log.groupBy("logdev").agg((F.max("idx") - 60).alias("upto_idx")))


@query(f"select logdev, store, lsn, idx from ({LOG}) l where idx >= 500 and store % 7 != 0 and not exists (select 1 from ({ROLLED}) r where r.store = l.store and l.idx between r.lo and r.hi)")
def log_replay(spark, sf):
    log = event_log(spark, sf)
    return logs.replay(log, logs.rollback(log, _to(spark, sf))[1], log.where("store % 7 != 0"), 500).select("logdev", "store", "lsn", "idx")


GRP = f"select logdev, grp, min(idx) as start_idx, count(*) as n, cast(sum(size) as bigint) as group_size, md5(string_agg(data, ',' order by idx)) as cur_crc from (select *, (idx - min(idx) over (partition by logdev)) // 32 as grp from ({LOG})) group by logdev, grp"
CHAIN = f"select *, coalesce(lag(cur_crc) over (partition by logdev order by grp), '') as prev_crc from ({GRP})"


@query(CHAIN)
def log_group_commit(spark, sf):
    return logs.groups(event_log(spark, sf), 32)


def _torn(spark, sf):
    made = logs.groups(event_log(spark, sf), 32)
    return made.withColumn("prev_crc", F.when(F.col("grp") % 11 == 7, "torn").otherwise(F.col("prev_crc")))


TORN = f"select logdev, grp, start_idx, n, group_size, cur_crc, case when grp % 11 = 7 then 'torn' else prev_crc end as prev_crc from ({CHAIN})"


@query(f"select logdev, grp, start_idx from (select *, max(case when p != prev_crc then 1 else 0 end) over (partition by logdev order by grp) as b from (select *, coalesce(lag(cur_crc) over (partition by logdev order by grp), '') as p from ({TORN}))) where b = 0")
def log_readable_groups(spark, sf):
    return logs.readable(_torn(spark, sf)).select("logdev", "grp", "start_idx")


@query(f"select logdev, grp, prev_crc from ({TORN}) where grp % 11 = 7")
def log_chain_audit(spark, sf):
    return audit.chain(_torn(spark, sf), "logdev", "grp", "cur_crc", "prev_crc").select("logdev", "grp", "prev_crc")


@query(f"""select logdev, store, lsn, '{{"size":' || size || ',"idx":' || idx || ',"is_inlined":true,"lsn":' || lsn || ',"store":' || store || '}}' as line from ({LOG}) where lsn between 1 and 9""")
def log_dump_json(spark, sf):
    return logs.dump(event_log(spark, sf), 1, 9)


@query(f"select logdev, store, min(lsn) as start_lsn, max(lsn) + 1 as next_lsn, max(lsn) as tail_lsn, count(*) as n_records, max(lsn) - min(lsn) + 1 - count(*) as n_holes from ({LOG}) group by all")
def log_status(spark, sf):
    return logs.status(event_log(spark, sf))


@query(f"""select logdev, store, lsn, '{{"size":' || size || ',"idx":' || idx || ',"is_inlined":true,"lsn":' || lsn || ',"store":' || store || ',"content":"' || base64(encode(data)) || '"}}' as line from ({LOG}) where lsn <= 4""")
def log_dump_content(spark, sf):
    return logs.dump(event_log(spark, sf), 0, 4, content=True)


@query(f"select logdev, store, lsn, size, size < 512 or size % 512 != 0 as is_inlined from (select logdev, store, lsn, size * 16 as size from ({LOG}))")
def log_inlined(spark, sf):
    return logs.inlined(event_log(spark, sf).select("logdev", "store", "lsn", (F.col("size") * 16).alias("size")))


@query(f"select {REC} from ({ALL})")
def log_write_lsn(spark, sf):
    """Late records are written into the holes; every fifth is asked for twice over and refused."""
    log = event_log(spark, sf).select("logdev", "store", "lsn", "idx")
    return logs.write(log, event_log(spark, sf, holes=False).where("idx % 17 = 0 or idx % 5 = 0").select("logdev", "store", "lsn", "idx"))[0]


@query(f"select logdev, store, lsn, case when idx % 17 = 0 then 'success' else 'already_exists' end as status from ({ALL}) where idx % 17 = 0 or idx % 5 = 0")
def log_write_status(spark, sf):
    log = event_log(spark, sf).select("logdev", "store", "lsn", "idx")
    return logs.write(log, event_log(spark, sf, holes=False).where("idx % 17 = 0 or idx % 5 = 0").select("logdev", "store", "lsn", "idx"))[1]


@query(f"select l.logdev, l.store, l.lsn, l.idx from ({LOG}) l left join ({TO}) t on t.store = l.store where t.to_lsn is null or l.lsn < t.to_lsn union all select logdev, store, to_lsn, 1000000 + store from ({TO})")
def log_write_at(spark, sf):
    new = _to(spark, sf).select("logdev", "store", F.col("to_lsn").alias("lsn"), (F.col("store") + 1_000_000).alias("idx"))
    return logs.write_at(event_log(spark, sf).select("logdev", "store", "lsn", "idx"), new)


@query(f"select logdev, store, index, idx from (select *, lsn + 1 as index, sum(cents) over (partition by store order by lsn) s, row_number() over (partition by store order by lsn) n from ({LOG}) where lsn + 1 between 3 and 11) where s <= 30000 or n = 1")
def log_entries(spark, sf):
    return logs.entries(event_log(spark, sf).withColumn("size", F.col("cents")), 3, 12, 30000).select("logdev", "store", "index", "idx")


@query(f"select logdev, store, min(lsn) + 1 as start_index, max(lsn) + 1 as last_index, max(lsn) + 2 as next_slot, arg_max(idx // 500, lsn) as last_term from ({LOG}) group by all")
def log_slots(spark, sf):
    return logs.slots(event_log(spark, sf), F.expr("idx div 500"))


@query(f"select l.logdev, l.store, max(l.idx) as last_idx from ({LOG}) l join (select logdev, max(idx) - 300 as upto from ({LOG}) group by 1) t on t.logdev = l.logdev where store % 3 = 1 group by l.logdev, l.store having max(l.idx) > max(t.upto)")
def log_garbage_stores(spark, sf):
    log = event_log(spark, sf)
    truncated = log.groupBy("logdev").agg((F.max("idx") - 300).alias("upto_idx"))
    return logs.garbage(log, log.where("store % 3 = 1").select("logdev", "store").distinct(), truncated)


# -- greedy folds: the SQL walks each sequence row by row

STEP = "with recursive r as (select {by}, idx, {size} as size, row_number() over (partition by {by} order by idx) n from ({LOG})), w as (select *, 0::bigint as bucket, 0::bigint as \"offset\" from r where n = 1 union all select r.{by}, r.idx, r.size, r.n, {next} from w join r on r.{by} = w.{by} and r.n = w.n + 1) select {by}, idx, size, bucket, \"offset\" from w"


@query(STEP.format(by="logdev", size="cents", LOG=LOG, next='case when w."offset" + w.size > 0 and w."offset" + w.size + r.size > 65536 then w.bucket + 1 else w.bucket end, case when w."offset" + w.size > 0 and w."offset" + w.size + r.size > 65536 then 0 else w."offset" + w.size end'))
def log_journal_chunks(spark, sf):
    return logs.journal_chunks(event_log(spark, sf).withColumn("size", F.col("cents")), 65536)


@query(STEP.format(by="store", size="cents", LOG=LOG, next='case when w."offset" + w.size >= 20000 then w.bucket + 1 else w.bucket end, case when w."offset" + w.size >= 20000 then 0 else w."offset" + w.size end'))
def repl_fetch_batches(spark, sf):
    return logs.batches(event_log(spark, sf).withColumn("size", F.col("cents")), ["store"], "idx", "size", 20000)


# -- blocks

X = "select doc_id as seq, cast(doc_id % 8 as int) as chunk, greatest(cast(ceil(coalesce(n_chars, 0) / 4096.0) as bigint), 1) as nblks from documents"
A = f"select *, cast(sum(nblks) over (partition by chunk order by seq) - nblks as bigint) as blk_num from ({X})"
USED = f"select * from ({A}) where seq % 3 != 0"


def _used(spark, sf):
    return blocks.append_alloc(extents(spark, sf)).where("seq % 3 != 0")


@query(A)
def blk_append_alloc(spark, sf):
    return blocks.append_alloc(extents(spark, sf))


@query("select source, doc_id, cast((row_number() over (partition by source order by doc_id) - 1) % 5 as int) as chunk from documents")
def blk_round_robin(spark, sf):
    return blocks.round_robin(table(spark, sf, "documents").select("source", "doc_id"), 5, "source", "doc_id")


@query(f"select seq, (chunk::bigint << 47) | (nblks << 31) | blk_num as packed, cast(chunk as bigint) as chunk, blk_num, nblks from ({A})")
def blk_pack_unpack(spark, sf):
    rows = blocks.append_alloc(extents(spark, sf)).select("seq", blocks.pack(F.col("chunk"), F.col("blk_num"), F.col("nblks")).alias("packed"))
    return rows.withColumn("e", blocks.unpack(F.col("packed"))).select("seq", "packed", "e.*")


@query(f"select seq, cast(i as int) as piece_no, blk_num + i * 2 as blk_num, least(2, nblks - i * 2) as nblks from (select *, unnest(range((nblks + 1) // 2)) as i from ({A}))")
def blk_pieces(spark, sf):
    piece = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(nblks + 1) div 2 - 1")), lambda i: F.struct((F.col("blk_num") + i * 2).alias("blk_num"), F.least(F.lit(2), F.col("nblks") - i * 2).alias("nblks")))
    rows = blocks.append_alloc(extents(spark, sf)).select("seq", piece.alias("pieces"))
    return blocks.pieces(rows, "pieces").select("seq", "piece_no", "piece.*")


CAP = 1 << 20
ISLANDS = f"select chunk, min(blk_num) as blk_num, max(blk_num + nblks) - min(blk_num) as nblks from (select *, sum(new) over (partition by chunk order by blk_num) g from (select *, case when blk_num <= max(blk_num + nblks) over (partition by chunk order by blk_num rows between unbounded preceding and 1 preceding) then 0 else 1 end as new from ({USED}))) group by chunk, g"
GAPS = f"select chunk, a as blk_num, b - a as free_blks from (select chunk, blk_num + nblks as a, coalesce(lead(blk_num) over (partition by chunk order by blk_num), {CAP}) as b from ({ISLANDS}) union all select chunk, 0, min(blk_num) from ({ISLANDS}) group by chunk) where a < b"


@query(ISLANDS)
def blk_merged(spark, sf):
    return blocks.merged(_used(spark, sf))


@query(GAPS)
def blk_free_gaps(spark, sf):
    return blocks.free_gaps(_used(spark, sf), CAP)


@query(f"select r.chunk, r.seq as read_seq, f.seq as free_seq from (select seq, chunk, blk_num + 1 as blk_num, nblks + 1 as nblks from ({A}) where seq % 2 = 0) r join (select * from ({A}) where seq % 5 = 0) f on f.chunk = r.chunk and f.blk_num < r.blk_num + r.nblks and r.blk_num < f.blk_num + f.nblks")
def blk_overlap_wait(spark, sf):
    rows = blocks.append_alloc(extents(spark, sf))
    reads = rows.where("seq % 2 = 0").withColumns({"blk_num": F.col("blk_num") + 1, "nblks": F.col("nblks") + 1})
    return blocks.overlaps(reads, rows.where("seq % 5 = 0"))


@query(f"select w.chunk, w.seq, w.blk_num, w.nblks, exists (select 1 from ({ISLANDS}) i where i.chunk = w.chunk and i.blk_num <= w.blk_num and w.blk_num + w.nblks <= i.blk_num + i.nblks) as is_alloced from ({A}) w")
def blk_is_alloced(spark, sf):
    return blocks.allocated(blocks.append_alloc(extents(spark, sf)), _used(spark, sf))


@query(f"select chunk, cast(sum(nblks) as bigint) as used_blks, count(*) as n_extents, cast({CAP} - sum(nblks) as bigint) as available_blks, cast(sum(nblks) * 100 // {CAP} as bigint) as used_pct from ({USED}) group by chunk")
def blk_usage(spark, sf):
    return blocks.usage(_used(spark, sf), CAP)


@query(f"select u.* from ({USED}) u where not (u.seq % 4 = 0 and u.seq % 3 <= 1)")
def blk_deferred_free(spark, sf):
    used = _used(spark, sf)
    frees = used.where("seq % 4 = 0").select("seq", (F.col("seq") % 3).alias("cp_id"))
    return blocks.deferred_free(used, frees, 1).select("seq", "chunk", "nblks", "blk_num")


@query(f"select cast(floor(log2(nblks)) as bigint) as slab, count(*) as n, cast(sum(nblks) as bigint) as blks from ({A}) group by 1")
def blk_slabs(spark, sf):
    return blocks.slabs(extents(spark, sf))


@query(f"select r.chunk, r.seq, f.blk_num from (select chunk, seq, row_number() over (partition by chunk order by seq) n from ({X}) where seq % 4 = 1) r left join (select chunk, blk_num, row_number() over (partition by chunk order by blk_num) n from ({GAPS})) f on f.chunk = r.chunk and f.n = r.n")
def blk_fixed_alloc(spark, sf):
    free = blocks.free_gaps(_used(spark, sf), CAP).select("chunk", F.col("blk_num").alias("queue"), "blk_num")
    return blocks.fixed_alloc(extents(spark, sf).where("seq % 4 = 1").select("chunk", "seq"), free)


@query(f"select r.chunk, r.seq, f.blk_num from (select chunk, seq, row_number() over (partition by chunk order by seq) n from ({X})) r left join (select chunk, blk_num, row_number() over (partition by chunk order by blk_num) n from ({GAPS})) f on f.chunk = r.chunk and f.n = r.n")
def blk_fixed_alloc_all(spark, sf):
    """blk_fixed_alloc, asked by all documents."""
    free = blocks.free_gaps(_used(spark, sf), CAP).select("chunk", F.col("blk_num").alias("queue"), "blk_num")
    return blocks.fixed_alloc(extents(spark, sf).select("chunk", "seq"), free)


@query("select n_nationkey % 5 as vdev, arg_max(n_nationkey, n_nationkey * 7 % 11 * 1000 - n_nationkey) as chunk, max(n_nationkey * 7 % 11) as available from nation group by 1")
def blk_most_available(spark, sf):
    n = F.col("n_nationkey")
    return blocks.most_available(table(spark, sf, "nation").select((n % 5).alias("vdev"), n.alias("chunk"), (n * 7 % 11).alias("available")), "vdev")


@query(None)
def blk_firstfit(spark, sf):
    asks = extents(spark, sf)
    return greedy.first_fit(asks.select("chunk", "seq", (F.col("nblks") * 2).alias("nblks")), blocks.free_gaps(_used(spark, sf), CAP))


@query("select doc_id as id, text as data from documents where length(text) > 0")
def blk_write_read(spark, sf):
    n = F.ceil(F.char_length("text") / 512).cast("long")
    piece = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(n + 2) div 3 - 1")), lambda i: F.struct((i * 10).alias("blk_num"), F.lit(3).cast("long").alias("nblks")))
    rows = table(spark, sf, "documents").where("char_length(text) > 0").select(F.col("doc_id").alias("id"), F.col("text").alias("data"), n.alias("n")).withColumn("pieces", piece)
    return blocks.joined_payload(blocks.split_payload(rows.drop("n"), 512))


@query(f"select seq, cast(nblks as bigint) as blocks, nblks >= 3 as is_split, true as is_equal from ({A})")
def blk_compare(spark, sf):
    """Extents cut into pieces of two and of three blocks, the latter from the back, are equal as sets of blocks."""
    cut = lambda n: F.transform(F.sequence(F.lit(0).cast("long"), F.expr(f"(nblks + {n} - 1) div {n} - 1")), lambda i: F.struct((F.col("blk_num") + i * n).alias("blk_num"), F.least(F.lit(n).cast("long"), F.col("nblks") - i * n).alias("nblks")))
    rows = blocks.append_alloc(extents(spark, sf)).withColumn("a", blocks.normalised(cut(2))).withColumn("b", blocks.normalised(F.reverse(cut(3))))
    total = F.aggregate("a", F.lit(0).cast("long"), lambda acc, p: acc + p["nblks"])
    return rows.select("seq", total.alias("blocks"), (F.size(cut(2)) > 1).alias("is_split"), (F.col("a") == F.col("b")).alias("is_equal"))


@query(f"select chunk, count(*) as n_free, cast(sum(free_blks) as bigint) as free_blks, max(free_blks) as largest, cast((sum(free_blks) - max(free_blks)) * 100 // sum(free_blks) as bigint) as scattered_pct from ({GAPS}) group by chunk")
def blk_fragmentation(spark, sf):
    return blocks.fragmentation(blocks.free_gaps(_used(spark, sf), CAP))


# -- metadata

RECORDS = "select case when c_custkey % 2 = 0 then 'a' else 'b' end as type, c_custkey % 400 as id, c_custkey // 400 as gen_cnt, case when c_custkey % 9 = 0 then null else c_name end as payload from customer"


@query(f"select type, id, max(gen_cnt) as gen_cnt, arg_max_null(payload, gen_cnt) as payload from ({RECORDS}) group by type, id having arg_max_null(payload, gen_cnt) is not null")
def meta_latest(spark, sf):
    c = F.col("c_custkey")
    return meta.latest(
        table(spark, sf, "customer").select(
            F.when(c % 2 == 0, "a").otherwise("b").alias("type"), (c % 400).alias("id"), F.expr("c_custkey div 400").alias("gen_cnt"), F.when(c % 9 == 0, None).otherwise(F.col("c_name")).alias("payload")
        )
    )


@query("with recursive e as (select 'n' || n_nationkey as type, 'n' || (n_nationkey // 2 - 1) as dep from nation where n_nationkey >= 2), w as (select 'n' || n_nationkey as type, 0 as level from nation union all select e.type, w.level + 1 from w join e on e.dep = w.type) select type, max(level) as level from w group by type")
def meta_topo_order(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("n"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    spark.sparkContext.getCheckpointDir() or spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return meta.recovery_order(n.select(name(F.col("n")).alias("type")), n.where("n >= 2").select(name(F.col("n")).alias("type"), name(F.expr("n div 2 - 1")).alias("dep")))


BLOCKS = "select 't' || s_nationkey as type, s_suppkey as pos, s_suppkey * 10 as bid, case when s_suppkey % 13 = 5 then -1 else (lag(s_suppkey) over (partition by s_nationkey order by s_suppkey)) * 10 end as prev_bid from supplier"


@query(f"select type, bid, prev_bid, expected from (select *, lag(bid) over (partition by type order by pos) as expected from ({BLOCKS})) where prev_bid is distinct from expected")
def meta_chain_audit(spark, sf):
    s = F.col("s_suppkey")
    before = F.lag(s).over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")) * 10
    rows = table(spark, sf, "supplier").select(F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("type"), s.alias("pos"), (s * 10).alias("bid"), F.when(s % 13 == 5, -1).otherwise(before).alias("prev_bid"))
    return meta.broken_chain(rows)


@query("select doc_id, case when n_chars <= 3584 then 0 else cast(ceil((n_chars - 3584) / 3584.0) as bigint) end as ovf, n_chars >= 2000 and 1500 * 100 <= n_chars * 75 as is_compressed from documents")
def meta_overflow_size(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", meta.overflow_blocks(n).alias("ovf"), meta.compressed(n, F.lit(1500), least=2000).alias("is_compressed"))


def _records(spark, sf):
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.when(c % 2 == 0, "a").otherwise("b").alias("type"), (c % 400).alias("id"), F.expr("c_custkey div 400").alias("gen_cnt"), F.when(c % 9 == 0, None).otherwise(F.col("c_name")).alias("payload")
    )


@query(f"select type, id, max(gen_cnt) as gen_cnt, arg_max_null(payload, gen_cnt) as payload from ({RECORDS}) where type = 'b' group by type, id having arg_max_null(payload, gen_cnt) is not null")
def meta_by_type(spark, sf):
    return meta.by_type(_records(spark, sf), "b")


@query("select type, id, gen_cnt, problem from (select *, case when type = 'c' then 'unknown_type' when gen_cnt < 0 then 'negative_gen' when max(gen_cnt) over (partition by type, id) > gen_cnt then 'stale_copy' when digest != md5(payload) then 'torn' end as problem from (select case c_custkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end as type, c_custkey // 6 as id, c_custkey % 7 - 1 as gen_cnt, c_name as payload, md5(case when c_custkey % 11 = 0 then 'torn' else c_name end) as digest from customer)) where problem is not null")
def meta_verify(spark, sf):
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        F.when(c % 3 == 0, "a").when(c % 3 == 1, "b").otherwise("c").alias("type"), F.expr("c_custkey div 6").alias("id"), (c % 7 - 1).alias("gen_cnt"),
        F.col("c_name").alias("payload"), F.md5(F.when(c % 11 == 0, "torn").otherwise(F.col("c_name"))).alias("digest"),
    )
    return meta.violations(rows, spark.createDataFrame([("a",), ("b",)], "type string"))


@query("select 't' || s_nationkey as type, '[' || string_agg('{\"id\":' || s_suppkey || ',\"gen_cnt\":' || s_suppkey % 5 || ',\"size\":' || strlen(s_name) || '}', ',' order by s_suppkey) || ']' as records from supplier group by 1")
def meta_dump_json(spark, sf):
    s = F.col("s_suppkey")
    return meta.dump(table(spark, sf, "supplier").select(F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("type"), s.alias("id"), (s % 5).alias("gen_cnt"), F.col("s_name").alias("payload")))
