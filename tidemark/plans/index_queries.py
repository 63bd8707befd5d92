"""Reads and writes of indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, index, mutate
from ..sources.tables import events_index, orders_index, parts_index, table
from .registry import query

O = "select o_orderkey as k, o_custkey as v, o_orderstatus as status, o_totalprice as price from orders"  # noqa: E741
P = "select printf('%08X', p_partkey) || '-' || p_name as k, cast(p_size as bigint) as v from part"
E = "select user_id as chunk, event_type as shard, event_id as blob, cast(round(value * 100) as bigint) as v from events"
KV = f"select k, v from ({O})"


@query(f"select * from ({O}) where k = 7")
def idx_point_get(spark, sf):
    return index.point_get(orders_index(spark, sf), "k", 7)


@query(f"select w.k, o.v, case when o.k is null then 'not_found' else 'success' end as status from (select o_orderkey * 3 as k from orders) w left join ({O}) o on o.k = w.k")
def idx_multi_get(spark, sf):
    o = orders_index(spark, sf).select("k", "v")
    return index.multi_get(o, "k", o.select((F.col("k") * 3).alias("k")))


@query(f"select * from ({O}) where k between 101 and 350 order by k limit 1")
def idx_get_any_left(spark, sf):
    return index.get_any(orders_index(spark, sf), "k", "left", 101, 350)


@query(f"select * from ({O}) where k between 101 and 350 order by k desc limit 1")
def idx_get_any_right(spark, sf):
    return index.get_any(orders_index(spark, sf), "k", "right", 101, 350)


@query(f"select k, v, status, price from (select *, row_number() over (order by k) n, count(*) over () c from ({O}) where k between 101 and 350) where n = (c + 1) // 2")
def idx_get_any_mid(spark, sf):
    return index.get_any(orders_index(spark, sf), "k", "mid", 101, 350)


@query(f"select * from ({O}) where k >= 50 and k <= 900")
def idx_range_incl(spark, sf):
    return index.range_query(orders_index(spark, sf), "k", 50, 900)


@query(f"select * from ({O}) where k > 50 and k < 900")
def idx_range_excl(spark, sf):
    return index.range_query(orders_index(spark, sf), "k", 50, 900, False, False)


@query(f"select * from ({O}) where k >= 50 and k < 1400 and status = 'F' order by k limit 25")
def idx_range_filter(spark, sf):
    return index.range_query(orders_index(spark, sf), "k", 50, 1400, high_in=False, where=F.col("status") == "F", batch=25)


@query(f"select * from ({O}) where k between 10 and 20 or k between 15 and 40 or k between 700 and 720")
def idx_multi_range(spark, sf):
    o = orders_index(spark, sf)
    return o.where(index.in_ranges(F.col("k"), [(700, 720), (15, 40), (10, 20)]))


@query(f"select * from ({P}) where k >= '00000010' and k < '00000040'")
def idx_var_key_range(spark, sf):
    return index.range_query(parts_index(spark, sf), "k", "00000010", "00000040", high_in=False)


@query(f"select * from ({E}) where (chunk > 3 or chunk = 3 and (shard > 'error' or shard = 'error' and blob >= 0)) and (chunk < 9 or chunk = 9 and (shard < 'click' or shard = 'click' and blob <= 5000))")
def idx_composite_range(spark, sf):
    rows = events_index(spark, sf).withColumn("key", F.struct("chunk", "shard", "blob"))
    at = lambda c, s, b: F.struct(F.lit(c).cast("long").alias("chunk"), F.lit(s).alias("shard"), F.lit(b).cast("long").alias("blob"))
    return rows.where((F.col("key") >= at(3, "error", 0)) & (F.col("key") <= at(9, "click", 5000))).drop("key")


@query(f"select k, v, status, price, c > 75 as has_more from (select *, count(*) over () c, row_number() over (order by k) n from (select * from ({O}) where k > 300 order by k limit 76)) where n <= 75")
def idx_page_keyset(spark, sf):
    return index.page(orders_index(spark, sf), "k", 75, after=300)


@query(f"select k, v, (row_number() over (order by k) - 1) // 90 as page from ({O})")
def idx_page_numbers(spark, sf):
    return index.page_numbers(orders_index(spark, sf).select("k", "v"), "k", 90)


@query(f"select * from ({O}) where k >= 333 order by k limit 1")
def idx_lower_bound(spark, sf):
    return index.lower_bound(orders_index(spark, sf), "k", 333)


@query("select w.g, w.k, (select min(e.event_id) from events e where e.user_id = w.g and e.event_id >= w.k) as bound from (select c_custkey as g, c_custkey * 7 as k from customer where c_custkey < 150) w")
def idx_lower_bounds_asof(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("k"))
    asks = table(spark, sf, "customer").where("c_custkey < 150").select(F.col("c_custkey").alias("g"), (F.col("c_custkey") * 7).alias("k"))
    return index.lower_bounds(events, "k", asks, within="g")


ASKS = "select c_custkey as g, c_custkey * 7 as k from customer"


@query(f"select g, k, bound from (select g, k, found, min(found) over (partition by g order by k rows between current row and unbounded following) as b1, min(found) over (partition by g, k) as b2, least(b1, b2) as bound from (select g, k, null::bigint as found from ({ASKS}) union all select user_id, event_id, event_id from events)) where found is null")
def idx_lower_bounds_asof_all(spark, sf):
    """idx_lower_bounds_asof, asked by all customers."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("g"), F.col("event_id").alias("k"))
    asks = table(spark, sf, "customer").select(F.col("c_custkey").alias("g"), (F.col("c_custkey") * 7).alias("k"))
    return index.lower_bounds(events, "k", asks, within="g")


@query(f"select min(k) as first_key, max(k) as last_key from ({P})")
def idx_first_last(spark, sf):
    return index.first_last(parts_index(spark, sf), "k")


@query(f"select count(*) as n from ({E})")
def idx_count(spark, sf):
    return events_index(spark, sf).agg(F.count("*").alias("n"))


@query(O)
def idx_full_scan(spark, sf):
    return orders_index(spark, sf)


@query(f"select k, v, n - 1 as slot from (select *, row_number() over (order by k) n from ({KV})) where n - 1 between 97 and 103")
def idx_neighbors(spark, sf):
    return index.neighbours(orders_index(spark, sf).select("k", "v"), "k", 100, 7)


@query(f"select k, v from (select *, row_number() over (order by k) n from ({P})) where n = 43")
def idx_nth_entry(spark, sf):
    return index.nth_entry(parts_index(spark, sf), "k", 42)


@query(f"select min(k) as run_start, max(k) as run_end, count(*) as n from (select k, k - row_number() over (order by k) g from ({O}) where v % 5 != 0) group by g")
def idx_key_runs(spark, sf):
    return index.key_runs(orders_index(spark, sf).where("v % 5 != 0"), "k")


VERSIONS = f"select k, v + r as v, r from ({KV}), (values (0), (1), (2)) t(r) where k % (r + 1) = 0"


@query(f"select k, v, r from (select *, row_number() over (partition by k order by r desc) n from ({VERSIONS}) where r <= 1) where n = 1 and k between 10 and 500")
def idx_snapshot_read(spark, sf):
    o = orders_index(spark, sf).select("k", "v")
    rows = o.select("k", "v", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("r")).where("k % (r + 1) = 0").withColumn("v", F.col("v") + F.col("r"))
    return index.snapshot_query(rows, "k", "r", 1, low=10, high=500).select("k", "v", "r")


# -- writes: the state holds even keys; requests are the multiples of 3 with new values

S, R = f"select k, v from ({KV}) where k % 2 = 0", f"select k, v + 1000000 as v from ({KV}) where k % 3 = 0"
JOINED = f"select coalesce(s.k, r.k) as k, s.v as old, r.v as new, s.k is not null as has, r.k is not null as asked from ({S}) s full join ({R}) r on s.k = r.k"


def _state(spark, sf):
    o = orders_index(spark, sf).select("k", "v")
    return o.where("k % 2 = 0"), o.where("k % 3 = 0").withColumn("v", F.col("v") + 1000000)


@query(f"select k, case when has then old else new end as v from ({JOINED})")
def put_insert(spark, sf):
    return mutate.state_of(mutate.put(*_state(spark, sf), kind="insert"))


@query(f"select k, old as existing_v, case when has then 'already_exists' else 'success' end as status from ({JOINED}) where asked")
def put_insert_status(spark, sf):
    return mutate.results_of(mutate.put(*_state(spark, sf), kind="insert"))


@query(f"select k, case when asked then new else old end as v from ({JOINED}) where has")
def put_update(spark, sf):
    return mutate.state_of(mutate.put(*_state(spark, sf), kind="update"))


@query(f"select k, coalesce(new, old) as v from ({JOINED})")
def put_upsert(spark, sf):
    return mutate.state_of(mutate.put(*_state(spark, sf)))


@query(f"select k, old as existing_v, 'success' as status from ({JOINED}) where asked")
def put_existing_value(spark, sf):
    return mutate.results_of(mutate.put(*_state(spark, sf)))


@query(f"select k, case when has and old % 7 = 0 then old else coalesce(new, old) end as v, case when not asked then null when has and old % 7 = 0 then 'filtered_out' else 'success' end as status from ({JOINED})")
def put_filter_decision(spark, sf):
    decide = F.when(F.col("existing_v") % 7 == 0, "keep").otherwise("replace")
    return mutate.put(*_state(spark, sf), decide=decide).select("k", "v", "status")


@query(f"select k, case when k between 100 and 200 then 5 else v end as v, k between 100 and 200 as changed from ({S})")
def range_update(spark, sf):
    return mutate.range_update(_state(spark, sf)[0], F.lit(5).cast("long"), 100, 200)


@query(f"select k, case when k between 100 and 300 and v % 3 = 0 then 9 else v end as v from ({S}) where not (k between 100 and 300 and v % 3 = 1)")
def range_put_decision(spark, sf):
    decide = F.when(F.col("v") % 3 == 0, "replace").when(F.col("v") % 3 == 1, "remove").otherwise("keep")
    return mutate.range_update(_state(spark, sf)[0], F.lit(9).cast("long"), 100, 300, decide=decide).select("k", "v")


SEQ = "select unnest(range(150, 451)) as k"


@query(f"select k, v from ({S}) union all select k, 7 + k - 150 as v from ({SEQ}) where k not in (select k from ({S}))")
def interval_put_insert(spark, sf):
    return mutate.state_of(mutate.interval_put(_state(spark, sf)[0], 150, 450, 7, kind="insert"))


@query(f"select k, case when k between 150 and 450 then 7 + k - 150 else v end as v from ({S})")
def interval_put_update(spark, sf):
    return mutate.state_of(mutate.interval_put(_state(spark, sf)[0], 150, 450, 7, kind="update"))


@query(f"select k, v from ({S}) where k not between 150 and 450 union all select k, 7 + k - 150 as v from ({SEQ})")
def interval_put_upsert(spark, sf):
    return mutate.state_of(mutate.interval_put(_state(spark, sf)[0], 150, 450, 7))


@query(f"select k, case when k between 60 and 260 then 0 else v end as v, k between 60 and 260 and v != 0 as changed from ({S})")
def tombstone(spark, sf):
    return mutate.tombstone(_state(spark, sf)[0], 60, 260)


@query(f"select r.k, case when s.k is null then 'not_found' when s.k between 60 and 260 or s.v = 0 then 'filtered_out' else 'success' end as status from ({R}) r left join ({S}) s on s.k = r.k")
def tombstone_status(spark, sf):
    state, asks = _state(spark, sf)
    return mutate.tombstone_status(mutate.tombstone(state, 60, 260), asks)


@query(f"select k, v from (select k, case when k between 60 and 260 then 0 else v end as v from ({S})) where not (k between 0 and 400 and v = 0)")
def tombstone_gc(spark, sf):
    return mutate.tombstone_gc(mutate.tombstone(_state(spark, sf)[0], 60, 260), 0, 400)[0].select("k", "v")


@query(f"select k, v from ({S}) where k % 3 != 0")
def remove_one(spark, sf):
    return mutate.remove(*_state(spark, sf))[0]


@query(f"select k, v from ({S}) where k % 3 = 0")
def remove_one_values(spark, sf):
    return mutate.remove(*_state(spark, sf))[1]


@query(f"select k, v from ({S}) where not (k between 40 and 340)")
def range_remove(spark, sf):
    return mutate.range_remove(_state(spark, sf)[0], 40, 340)[0]


@query(f"select k, v from ({S}) where not (k between 40 and 340 and v % 4 = 0)")
def range_remove_filter(spark, sf):
    return mutate.range_remove(_state(spark, sf)[0], 40, 340, where=F.col("v") % 4 == 0)[0]


@query(f"select k, v from ({S}) where k != (select min(k) from ({S}) where k between 33 and 99)")
def remove_any(spark, sf):
    return mutate.remove_any(_state(spark, sf)[0], "any", 33, 99)[0]


@query(f"select * from ({E}) where chunk != 5")
def prefix_purge(spark, sf):
    return mutate.range_remove(events_index(spark, sf), 5, 5, "chunk")[0]


@query(f"select k, case when not asked then 'left' when not has then 'right' else 'both' end as side, old as left_v, new as right_v from ({JOINED}) where not has or not asked or old is distinct from new")
def state_diff(spark, sf):
    return mutate.state_diff(*_state(spark, sf))


# -- audits

NODES = f"select k // 64 as node, k % 64 as slot, k, v from ({KV})"


@query(f"select node, slot, k, lag(k) over (partition by node order by slot) as before_key from ({NODES}) qualify before_key >= k")
def audit_key_order(spark, sf):
    nodes = orders_index(spark, sf).select(F.expr("k div 64").alias("node"), F.expr("k % 64").alias("slot"), "k")
    return audit.key_order(nodes, "node", "slot", "k")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def audit_duplicate_keys(spark, sf):
    return audit.duplicate_keys(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query(f"select node as child, node * 64 + 60 as bound, max(k) as top from ({NODES}) group by node having max(k) > node * 64 + 60")
def audit_child_bounds(spark, sf):
    children = orders_index(spark, sf).select(F.expr("k div 64").alias("node"), F.lit(0).alias("level"), F.col("k").alias("key"))
    links = children.select("node").distinct().select(F.lit(1).alias("parent_level"), F.col("node").alias("child"), (F.col("node") * 64 + 60).alias("bound"))
    return audit.child_bounds(links, children)


def _tree(spark, sf):
    leaves = orders_index(spark, sf).groupBy(F.expr("k div 64").alias("node")).agg(F.count("*").alias("entries"), F.min("k").alias("first_key")).withColumn("level", F.lit(0).cast("long"))
    inner = leaves.groupBy(F.expr("node div 64").alias("node")).agg(F.count("*").alias("entries"), F.min("first_key").alias("first_key")).withColumn("level", F.lit(1).cast("long"))
    return leaves.unionByName(inner)


TREE = f"select k // 64 as node, count(*) as entries, min(k) as first_key, 0 as level from ({KV}) group by 1 union all select k // 4096, count(distinct k // 64), min(k), 1 from ({KV}) group by 1"


@query(f"select cast(level as bigint) as level, count(*) as n_nodes, cast(sum(entries) as bigint) as n_entries from ({TREE}) group by level")
def audit_node_counts(spark, sf):
    return audit.node_counts(_tree(spark, sf))


@query(f"select node, entries, first_key, cast(level as bigint) as level, entries * 100 // 64 as occupancy_pct from ({TREE})")
def audit_occupancy(spark, sf):
    return audit.occupancy(_tree(spark, sf), 64)


@query(f"select cast(level as bigint) as level, node, first_key, next_node, following from (select *, node + 1 as next_node, lead(node) over (partition by level order by first_key) as following from ({TREE})) where following is distinct from next_node")
def audit_sibling_links(spark, sf):
    return audit.sibling_links(_tree(spark, sf).select("level", "node", "first_key", (F.col("node") + 1).alias("next_node")))


