"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Slot ``k`` of the mix gets the point ``frac((k + 1) * golden ratio)``; the cumulative weights of the
sources map the point to a source. The slots of a source are ranked, and slot ``r`` takes block
``r mod n`` of the ``n`` equal-token blocks into which the shuffled documents of the source are cut.
Because the points have low discrepancy, every stretch of the mix follows the weights.

Defined cases: a null text has size 0; a very long text is laid over as many blocks as it takes; a null source is a source of its own, the last one; documents
of size 0 take part with ``taken`` 0; rows with the same ``doc_id`` are separate documents; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, written

#: Words in a block. Smaller blocks follow the targets more closely, larger ones make fewer slots.
BLOCK = 256
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Points are multiples of 2**-31; the odd number next to 2**31 / golden ratio steps through them.
RANGE, STEP = 1 << 31, 1327217885
#: Slots in a chunk of the schedule, cells of the unit interval, parts of a source: the least; they grow with the input.
CHUNK, CELLS, PARTS = 4096, 4096, 1024


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Per source: source, source_size, weight, target.

    The water level ``l`` with ``sum(min(most * size, weight * l)) = share * sum(size)`` gives the targets.
    It lies where, in the order of ``most * size / weight``, the next source isn't filled by it.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source"))) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    filled = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - filled("most")) / (F.sum("weight").over(whole) - filled("weight"))
    per = per.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "level"))).over(whole)
    per = per.withColumn("level", F.coalesce(fits["level"], F.lit(float("inf"))))
    return per.select("source", "source_size", "weight", F.least("most", F.col("weight") * F.col("level")).alias("target"))


def schedule(goals: DataFrame, slots: int, block: int = BLOCK) -> DataFrame:
    """The slots of the mix: slot, source, rank, piece (which block of the source) and take (words from its start).

    ``goals``: source, source_size, target. A source gets slots until its target, rounded to words, is
    reached; the few that the sequence leaves out, at most its discrepancy, follow at the end.
    """
    spark = goals.sparkSession
    # As many slots in a chunk as chunks, and a few sources a cell: no window and no key of a join grows in proportion.
    chunk, cells = max(CHUNK, math.isqrt(slots)), max(CELLS, 4 * goals.count())
    goal = (
        goals.where("source_size > 0")
        .withColumn("words", F.least(F.round("target").cast("long"), 2 * F.col("source_size")))
        .withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
        .withColumn("rounds", F.expr("words div source_size"))
        .withColumn("rest", F.expr("words % source_size"))
        .withColumn("needed", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
    )
    order = Window.orderBy(F.col("source"))
    total = F.sum("target").over(Window.partitionBy())
    high = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0)) / total
    goal = goal.withColumn("high", F.least(high, F.lit(1.0))).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    goal = goal.withColumn("high", F.when(F.lead("high").over(order).isNull(), F.lit(1.0)).otherwise(F.col("high")))
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1)).cast("long")
    arcs = goal.select("source", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    point = (F.col("id") + 1) % RANGE * STEP % RANGE / RANGE
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("x"))
    drawn = (
        points.withColumn("cell", cell(F.col("x")))
        .join(arcs, "cell")
        .where("x >= low and x < high")
        .select("slot", "source", F.expr(f"slot div {chunk}").alias("chunk"))
    )
    # Rank in two steps, so that no task orders all slots of a large source.
    counts = drawn.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("source", "chunk").orderBy("slot")
    ranked = drawn.withColumn("nth", F.row_number().over(within) - 1)
    ranked = ranked.join(counts, ["source", "chunk"]).select("source", "slot", (F.col("before") + F.col("nth")).alias("rank"))
    got = counts.groupBy("source").agg(F.sum("n").alias("got"))
    left = goal.join(got, "source", "left").select("source", "needed", F.coalesce("got", F.lit(0)).alias("got"))
    late = left.where("got < needed").select(
        "source", F.lit(None).cast("long").alias("slot"), F.explode(F.sequence("got", F.col("needed") - 1)).alias("rank")
    )
    all_slots = ranked.unionByName(late)
    return (
        all_slots.join(goal.select("source", "needed", "blocks", "rounds", "rest"), "source")
        .where("rank < needed")
        .withColumn("piece", F.expr("rank % blocks"))
        .withColumn("take", F.when(F.expr("rank div blocks") < F.col("rounds"), F.lit(block)).otherwise(F.col("rest") - F.col("piece") * block))
        .select("slot", "source", "rank", "piece", F.least("take", F.lit(block)).cast("long").alias("take"))
    )


def blocks(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Lay the documents of each source end to end in an order shuffled by hash, and cut them into blocks.

    Adds ``start``, the words before the document in its source. The sums are taken over parts of a
    source first, so no task gets all documents of one.
    """
    parts = max(PARTS, math.isqrt(sizes.count()))  # as many documents in a part as parts, if one source has nearly all
    docs = sizes.withColumn("h", F.xxhash64(F.lit("mix"), "doc_id", "size")).withColumn("part", F.expr(f"pmod(h, {parts})"))
    sums = docs.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return docs.join(sums, ["source", "part"]).select("doc_id", "source", "size", (F.col("base") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    # A source as a key that is never null and sorts as asked: null comes last.
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    sizes = written(docs.select("doc_id", key.alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    goals = written(targets(sizes, share, most, weights), "targets")
    words = goals.agg(F.sum("target")).first()[0] or 0.0
    laid = blocks(sizes, block)
    pieces = (
        laid.where("size > 0")
        .select("source", "size", "start", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("piece"))
        .withColumn("from", F.greatest(F.col("start") - F.col("piece") * block, F.lit(0)))
        .withColumn("to", F.least(F.col("start") + F.col("size") - F.col("piece") * block, F.lit(block)))
    )
    slots = schedule(goals, int(-(-words // block)), block).select("source", "piece", "take")
    taken = (
        pieces.join(slots, ["source", "piece"])
        .groupBy("source", "start")
        .agg(F.sum(F.greatest(F.least("take", "to") - F.col("from"), F.lit(0))).alias("taken"))
        .withColumn("some", F.lit(True))
    )
    return (
        laid.withColumn("some", F.col("size") > 0)
        .join(taken, ["source", "start", "some"], "left")
        .join(goals.select("source", "source_size", "target"), "source")
        .select(
            "doc_id",
            F.when(F.col("source") != "1", F.substr("source", F.lit(2))).alias("source"),
            "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )
