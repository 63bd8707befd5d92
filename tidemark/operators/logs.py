"""Sequenced logs: rows of (logdev, store, lsn, idx, data), where a missing lsn is a hole.

Windows are over one store or one device, the units that the log itself orders; nothing orders all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STORE = ["logdev", "store"]
#: Holes that are filled from one row.
PIECE = 1 << 16


def append(log: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New rows with the lsn that follow the tail of their store."""
    tails = log.groupBy(*STORE).agg(F.max("lsn").alias("_tail"))
    nth = F.row_number().over(Window.partitionBy(*STORE).orderBy(order))
    return new.withColumn("_nth", nth).join(tails, STORE, "left").withColumn("lsn", F.coalesce("_tail", F.lit(-1)) + F.col("_nth")).drop("_nth", "_tail")


def read(log: DataFrame, store: int, lsn: int, start_lsn: int = 0) -> DataFrame:
    """The record, or an error when the query runs: truncated, a hole, or a filled gap is out of range."""
    row = log.where((F.col("store") == store) & (F.col("lsn") == lsn) & (F.lit(lsn) >= start_lsn))
    n = row.agg(F.count("*").alias("n"), F.max("idx").alias("idx"), F.max("data").alias("data"))
    missing = F.raise_error(F.lit(f"out_of_range: {store}/{lsn}")).cast("string")
    return n.select(F.lit(store).alias("store"), F.lit(lsn).alias("lsn"), "idx", F.when((F.col("n") == 1) & F.col("data").isNotNull(), F.col("data")).otherwise(missing).alias("data"))


def foreach_until(log: DataFrame, start: int, stop: Column) -> DataFrame:
    """Records from ``start`` on, up to and with the first of each store that ``stop`` holds for."""
    order = Window.partitionBy(*STORE).orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(F.coalesce(stop, F.lit(False)).cast("int")).over(order), F.lit(0))
    return log.where(F.col("lsn") >= start).withColumn("_stopped", before).where("_stopped = 0").drop("_stopped")


def contiguous_upto(log: DataFrame, start: int = 0) -> DataFrame:
    """Per store, the last lsn of the gap-free run from ``start``; ``start - 1`` if that is missing."""
    nth = F.row_number().over(Window.partitionBy(*STORE).orderBy("lsn"))
    rows = log.withColumn("_run", F.when(F.col("lsn") >= start, F.lit(1)))
    kept = rows.where("_run = 1").withColumn("_nth", nth)
    upto = F.max(F.when(F.col("lsn") - start == F.col("_nth") - 1, F.col("lsn")))
    reached = kept.groupBy(*STORE).agg(upto.alias("upto"))
    return log.select(*STORE).distinct().join(reached, STORE, "left").withColumn("upto", F.coalesce("upto", F.lit(start - 1)))


def fill_gaps(log: DataFrame) -> DataFrame:
    """Each store's holes below its tail as rows with null data and ``filled``, besides its own rows."""
    order = Window.partitionBy(*STORE).orderBy("lsn")
    gaps = log.withColumn("_from", F.coalesce(F.lag("lsn").over(order), F.lit(-1)) + 1).where("_from < lsn")
    # A wide gap is cut into pieces first, so that no row holds a long array.
    gaps = gaps.select(*STORE, (F.col("lsn") - 1).alias("_to"), F.explode(F.sequence("_from", F.col("lsn") - 1, F.lit(PIECE))).alias("_from"))
    gaps = gaps.select(*STORE, F.explode(F.sequence("_from", F.least("_to", F.col("_from") + PIECE - 1))).alias("lsn"), F.lit(None).cast("long").alias("idx"), F.lit(None).cast("string").alias("data"), F.lit(True).alias("filled"))
    return log.select(*STORE, "lsn", "idx", "data", F.lit(False).alias("filled")).unionByName(gaps)


def truncate(log: DataFrame, upto: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows above each store's ``upto``, and the stores' new start and tail; the tail may jump beyond the log."""
    joined = log.join(upto, STORE, "left")
    kept = joined.where("upto is null or lsn > upto").drop("upto")
    bounds = joined.groupBy(*STORE).agg((F.coalesce(F.max("upto"), F.lit(-1)) + 1).alias("start_lsn"), F.greatest(F.max("lsn"), F.max("upto")).alias("tail_lsn"))
    return kept, bounds


def truncation_key(log: DataFrame) -> DataFrame:
    """Adds ``trunc_idx``: the device index that must be kept for a record. A lower lsn that is written later inherits the tail's."""
    order = Window.partitionBy(*STORE).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("trunc_idx", F.max_by("idx", "lsn").over(order))


def safe_truncation(stores: DataFrame) -> DataFrame:
    """Per device the least key of its stores; empty ones (start_lsn - 1 = tail_lsn) don't count; all empty: the last flushed.

    stores: logdev, store, start_lsn, tail_lsn, trunc_idx, flushed_idx.
    """
    held = F.min(F.when(F.col("start_lsn") - 1 != F.col("tail_lsn"), F.col("trunc_idx")))
    return stores.groupBy("logdev").agg(F.coalesce(held, F.max("flushed_idx")).alias("safe_idx"))


def rollback(log: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows up to each store's ``to_lsn``, and the rolled-back index ranges: logdev, store, lo, hi."""
    joined = log.join(to, STORE, "left")
    kept = joined.where("to_lsn is null or lsn <= to_lsn").drop("to_lsn")
    ranges = joined.where("lsn > to_lsn").groupBy(*STORE).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return kept, ranges


def replay(log: DataFrame, rolled: DataFrame, opened: DataFrame, from_idx: int = 0) -> DataFrame:
    """Records from ``from_idx`` of opened stores that no rolled-back range of their store covers."""
    rows = log.where(F.col("idx") >= from_idx).join(opened.select(*STORE).distinct(), STORE, "left_semi")
    # In order of idx, a record is covered if a range that began at or before it ends at or after it: one pass over a store.
    marks = rolled.select(*STORE, F.col("lo").alias("_at"), F.lit(0).alias("_ask"), F.col("hi").alias("_hi"), F.lit(None).cast(rows.select(F.struct("*")).schema[0].dataType).alias("_row"))
    asks = rows.select(*STORE, F.col("idx").alias("_at"), F.lit(1).alias("_ask"), F.lit(None).cast("long").alias("_hi"), F.struct("*").alias("_row"))
    before = Window.partitionBy(*STORE).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asks).withColumn("_top", F.max("_hi").over(before))
    return both.where("_ask = 1 and (_top is null or _top < _at)").select("_row.*")


def prune_rollbacks(rolled: DataFrame, truncated: DataFrame) -> DataFrame:
    """Rollback ranges that end above their device's truncated index."""
    return rolled.join(truncated, "logdev").where("hi > upto_idx").drop("upto_idx")


def groups(log: DataFrame, most: int) -> DataFrame:
    """Group commits of a device: at most ``most`` consecutive indexes, with a checksum chained to the group before."""
    first = log.groupBy("logdev").agg(F.min("idx").alias("_first"))
    rows = log.join(first, "logdev").withColumn("grp", F.expr(f"(idx - _first) div {most}"))
    body = F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("idx", "data"))), lambda r: r["data"]))
    made = rows.groupBy("logdev", "grp").agg(F.min("idx").alias("start_idx"), F.count("*").alias("n"), F.sum("size").alias("group_size"), F.md5(body).alias("cur_crc"))
    return made.withColumn("prev_crc", F.coalesce(F.lag("cur_crc").over(Window.partitionBy("logdev").orderBy("grp")), F.lit("")))


def readable(made: DataFrame) -> DataFrame:
    """Groups of each device up to where the chain of checksums breaks."""
    order = Window.partitionBy("logdev").orderBy("grp")
    broken = (F.coalesce(F.lag("cur_crc").over(order), F.lit("")) != F.col("prev_crc")).cast("int")
    return made.withColumn("_b", broken).withColumn("_b", F.max("_b").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_b = 0").drop("_b")


def inlined(log: DataFrame, limit: int = 512) -> DataFrame:
    return log.withColumn("is_inlined", (F.col("size") < limit) | (F.col("size") % limit != 0))


def dump(log: DataFrame, start: int = 0, end: int | None = None, content: bool = False) -> DataFrame:
    """A JSON line for each record's header, with ``content`` followed by the record as base64."""
    rows = inlined(log.where((F.col("lsn") >= start) & (F.lit(True) if end is None else F.col("lsn") <= end)))
    fields = ["size", "idx", "is_inlined", "lsn", "store", *([F.base64(F.col("data").cast("binary")).alias("content")] if content else [])]
    return rows.select(*STORE, "lsn", F.to_json(F.struct(*fields)).alias("line"))


def write(log: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows at lsn of their own choice, in any order: the log with them, and logdev, store, lsn, status for each.

    A record that is there is never overwritten: already_exists.
    """
    there = log.select(*STORE, "lsn", F.lit(True).alias("_there"))
    asked = new.join(there, [*STORE, "lsn"], "left")
    status = asked.select(*STORE, "lsn", F.when(F.col("_there"), "already_exists").otherwise("success").alias("status"))
    return log.unionByName(asked.where("_there is null").select(*log.columns)), status


def write_at(log: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each store, at an lsn: everything from there on is rolled back, then the row is appended."""
    to = new.select(*STORE, (F.col("lsn") - 1).alias("to_lsn"))
    return rollback(log, to)[0].select(*log.columns).unionByName(new.select(*log.columns))


def entries(log: DataFrame, start: int, end: int, limit: int) -> DataFrame:
    """Entries of each store with ``start`` <= index < ``end``, where an index is an lsn and 1, as long as their sizes add up
    to ``limit`` at most; the first is always given."""
    rows = log.withColumn("index", F.col("lsn") + 1).where((F.col("index") >= start) & (F.col("index") < end))
    order = Window.partitionBy(*STORE).orderBy("lsn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("size").over(order)).withColumn("_nth", F.count("*").over(order))
    return rows.where((F.col("_sum") <= limit) | (F.col("_nth") == 1)).drop("_sum", "_nth")


def slots(log: DataFrame, term: Column) -> DataFrame:
    """The facade of a replicated log, per store: start_index, last_index, next_slot, and the term of the last entry."""
    return log.groupBy(*STORE).agg((F.min("lsn") + 1).alias("start_index"), (F.max("lsn") + 1).alias("last_index"), (F.max("lsn") + 2).alias("next_slot"), F.max_by(term, "lsn").alias("last_term"))


def garbage(log: DataFrame, removed: DataFrame, truncated: DataFrame) -> DataFrame:
    """Removed stores whose ids can't be given out again: the device isn't truncated beyond their last record (logdev, upto_idx)."""
    last = log.groupBy(*STORE).agg(F.max("idx").alias("last_idx"))
    return removed.select(*STORE).join(last, STORE).join(truncated, "logdev").where("last_idx > upto_idx").select(*STORE, "last_idx")


def status(log: DataFrame) -> DataFrame:
    return log.groupBy(*STORE).agg(F.min("lsn").alias("start_lsn"), (F.max("lsn") + 1).alias("next_lsn"), F.max("lsn").alias("tail_lsn"), F.count("*").alias("n_records"), (F.max("lsn") - F.min("lsn") + 1 - F.count("*")).alias("n_holes"))


def journal_chunks(log: DataFrame, capacity: int) -> DataFrame:
    """Records of each device laid into chunks of ``capacity``: one that doesn't fit starts the next chunk and leaves a hole.

    The reset depends on all before, so a device's sizes are folded in order in one ordered array of small numbers.
    """
    return _folded(log, ["logdev"], "idx", "size", capacity, reset_at=False)


def batches(rows: DataFrame, by: list[str], order: str, size: str, limit: int) -> DataFrame:
    """Greedy batches: a batch is closed as soon as its sum reaches ``limit``."""
    return _folded(rows, by, order, size, limit, reset_at=True)


def _folded(rows: DataFrame, by: list[str], order: str, size: str, limit: int, reset_at: bool) -> DataFrame:
    """Adds chunk (or batch) and offset by a running sum that starts anew; streamed in order, so no group is held in memory."""
    from .greedy import folded

    return folded(rows.select(*by, order, size), by, order, size, limit, reset_at)
