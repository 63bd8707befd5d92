"""Metadata records: generations, recovery order, chains and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(records: DataFrame) -> DataFrame:
    """The record of the highest generation of each (type, id); a null payload removes it."""
    last = records.groupBy("type", "id").agg(F.max("gen_cnt").alias("gen_cnt"), F.max_by("payload", "gen_cnt").alias("payload"))
    return last.where("payload is not null")


def recovery_order(types: DataFrame, edges: DataFrame) -> DataFrame:
    """type, level: one more than the highest level of what the type depends on. Raises on a cycle.

    Types are a handful, a catalog and not data; each round raises the levels that still change. A chain of all types
    takes as many rounds as there are types, so levels that still change after that go round in a cycle.
    """
    level = types.select("type", F.lit(0).alias("level"))
    for _ in range(types.count() + 1):
        above = edges.join(level.select(F.col("type").alias("dep"), F.col("level").alias("_l")), "dep").groupBy("type").agg((F.max("_l") + 1).alias("_n"))
        new = level.join(above, "type", "left").select("type", F.greatest("level", F.coalesce("_n", F.lit(0))).alias("level")).checkpoint()
        if not new.join(level, ["type", "level"], "left_anti").head(1):
            return new
        level = new
    raise ValueError("cycle among metadata types")


def broken_chain(blocks: DataFrame) -> DataFrame:
    """Blocks of a type's chain whose prev_bid isn't the block before: type, bid, prev_bid, expected."""
    order = Window.partitionBy("type").orderBy("pos")
    return blocks.withColumn("expected", F.lag("bid").over(order)).where(~F.col("prev_bid").eqNullSafe(F.col("expected"))).select("type", "bid", "prev_bid", "expected")


def overflow_blocks(size: Column, block: int = 4096, header: int = 512) -> Column:
    """Overflow blocks beyond the first; each block has room for ``block - header`` bytes."""
    room = block - header
    return F.when(size <= room, 0).otherwise(F.ceil((size - room) / room)).cast("long")


def compressed(size: Column, packed: Column, least: int = 1 << 20, most: int = 512 << 20, ratio: int = 75) -> Column:
    """Whether a payload is kept compressed: large enough, within the buffer, and small enough after."""
    return (size >= least) & (size <= most) & (packed * 100 <= size * ratio)


def by_type(records: DataFrame, kind: str) -> DataFrame:
    """All records of one type, as they stand."""
    return latest(records.where(F.col("type") == kind))


def violations(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records that a sound store doesn't have: type, id, gen_cnt, problem (unknown_type, negative_gen, stale_copy, torn).

    ``records``: type, id, gen_cnt, payload, digest (of the payload, as written); ``known``: the registered types.
    """
    rows = records.join(known.select("type", F.lit(True).alias("_known")), "type", "left")
    last = F.max("gen_cnt").over(Window.partitionBy("type", "id"))
    problem = F.when(F.col("_known").isNull(), "unknown_type").when(F.col("gen_cnt") < 0, "negative_gen").when(F.col("_last") > F.col("gen_cnt"), "stale_copy")
    problem = problem.when(F.md5("payload") != F.col("digest"), "torn")
    return rows.withColumn("_last", last).withColumn("problem", problem).where("problem is not null").select("type", "id", "gen_cnt", "problem")


def dump(records: DataFrame) -> DataFrame:
    """A JSON line for each type: its records in order of id, with generation and size of the payload."""
    row = F.struct("id", "gen_cnt", F.coalesce(F.octet_length("payload"), F.lit(0)).alias("size"))
    return records.groupBy("type").agg(F.to_json(F.sort_array(F.collect_list(row))).alias("records"))
