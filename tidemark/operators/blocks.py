"""Block extents: placement, packing, free space and overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a packed extent: block number, count, chunk. Fixed values of the layout.
BLK_BITS, COUNT_BITS, CHUNK_BITS = 31, 16, 16


def append_alloc(requests: DataFrame) -> DataFrame:
    """A pointer per chunk that only moves on: adds blk_num."""
    order = Window.partitionBy("chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("blk_num", F.sum("nblks").over(order) - F.col("nblks"))


def fixed_alloc(requests: DataFrame, free: DataFrame) -> DataFrame:
    """Single free blocks in queue order, one for each request of the chunk: requests beyond them get null."""
    nth = lambda by: F.row_number().over(Window.partitionBy("chunk").orderBy(by))
    return requests.withColumn("_n", nth("seq")).join(free.withColumn("_n", nth("queue")), ["chunk", "_n"], "left").drop("_n", "queue")


def round_robin(requests: DataFrame, chunks: int, by: str, order: str) -> DataFrame:
    """The chunk of each request, in turn within each stream of requests ``by``."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return requests.withColumn("chunk", F.pmod(nth - 1, F.lit(chunks)).cast("int"))


def most_available(chunks: DataFrame, by: str) -> DataFrame:
    return chunks.groupBy(by).agg(F.max_by("chunk", F.struct("available", -F.col("chunk"))).alias("chunk"), F.max("available").alias("available"))


def pack(chunk: Column, blk_num: Column, nblks: Column) -> Column:
    """An extent as one number: chunk, count and block number from the high bits down, with the multi bit 0."""
    value = F.shiftleft(chunk.cast("long"), BLK_BITS + COUNT_BITS).bitwiseOR(F.shiftleft(nblks.cast("long"), BLK_BITS))
    return value.bitwiseOR(blk_num.cast("long"))


def unpack(value: Column) -> Column:
    part = lambda shift, bits: F.shiftright(value, shift).bitwiseAND(F.lit((1 << bits) - 1))
    return F.struct(part(BLK_BITS + COUNT_BITS, CHUNK_BITS).alias("chunk"), part(0, BLK_BITS).alias("blk_num"), part(BLK_BITS, COUNT_BITS).alias("nblks"))


def pieces(df: DataFrame, column: str) -> DataFrame:
    """A row for each piece of a multi-piece extent, in order."""
    return df.select("*", F.posexplode(column).alias("piece_no", "piece")).drop(column)


def merged(extents: DataFrame) -> DataFrame:
    """Extents of a chunk, those that touch or overlap merged: chunk, blk_num, nblks."""
    end = F.col("blk_num") + F.col("nblks")
    before = Window.partitionBy("chunk").orderBy("blk_num", "nblks").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("blk_num") <= F.max(end).over(before), 0).otherwise(1)
    run = Window.partitionBy("chunk").orderBy("blk_num", "nblks").rowsBetween(Window.unboundedPreceding, 0)
    rows = extents.select("chunk", "blk_num", "nblks", new.alias("_new")).withColumn("_run", F.sum("_new").over(run))
    return rows.groupBy("chunk", "_run").agg(F.min("blk_num").alias("blk_num"), (F.max(end) - F.min("blk_num")).alias("nblks")).drop("_run")


def free_gaps(used: DataFrame, capacity: int) -> DataFrame:
    """Free extents between used ones, and after the last: chunk, blk_num, free_blks."""
    rows = merged(used)
    end = F.col("blk_num") + F.col("nblks")
    order = Window.partitionBy("chunk").orderBy("blk_num")
    gaps = rows.select("chunk", end.alias("a"), F.coalesce(F.lead("blk_num").over(order), F.lit(capacity)).alias("b"))
    head = rows.groupBy("chunk").agg(F.min("blk_num").alias("b")).select("chunk", F.lit(0).cast("long").alias("a"), "b")
    return gaps.unionByName(head).where("a < b").select("chunk", F.col("a").alias("blk_num"), (F.col("b") - F.col("a")).alias("free_blks"))


def overlaps(reads: DataFrame, frees: DataFrame, bucket: int = 16) -> DataFrame:
    """Pairs of a read and a free that share a block: an equi-join on aligned buckets, each pair once (in its first shared bucket)."""
    of = lambda c: F.expr(f"{c} div {bucket}")
    spread = lambda df: df.withColumn("bucket", F.explode(F.sequence(of("blk_num"), of("(blk_num + nblks - 1)"))))
    a = spread(reads.select("chunk", F.col("seq").alias("read_seq"), "blk_num", "nblks")).alias("a")
    b = spread(frees.select("chunk", F.col("seq").alias("free_seq"), "blk_num", "nblks")).alias("b")
    on = (F.col("a.chunk") == F.col("b.chunk")) & (F.col("a.bucket") == F.col("b.bucket"))
    meet = (F.col("a.blk_num") < F.col("b.blk_num") + F.col("b.nblks")) & (F.col("b.blk_num") < F.col("a.blk_num") + F.col("a.nblks"))
    first = F.expr(f"greatest(a.blk_num, b.blk_num) div {bucket}")
    return a.join(b, on & meet).where(F.col("a.bucket") == first).select("a.chunk", "read_seq", "free_seq")


def allocated(wanted: DataFrame, used: DataFrame) -> DataFrame:
    """Whether each wanted extent lies within a used one: adds ``is_alloced``. The covering extent is the last that starts at or before it."""
    have = merged(used).select("chunk", "blk_num", F.lit(None).cast("long").alias("seq"), (F.col("blk_num") + F.col("nblks")).alias("_end"), F.lit(0).alias("_ask"), F.col("nblks"))
    asks = wanted.select("chunk", "blk_num", "seq", F.lit(None).cast("long").alias("_end"), F.lit(1).alias("_ask"), "nblks")
    order = Window.partitionBy("chunk").orderBy("blk_num", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    both = have.unionByName(asks).withColumn("_top", F.last("_end", ignorenulls=True).over(order))
    return both.where("_ask = 1").select("chunk", "seq", "blk_num", "nblks", F.coalesce(F.col("blk_num") + F.col("nblks") <= F.col("_top"), F.lit(False)).alias("is_alloced"))


def usage(used: DataFrame, capacity: int) -> DataFrame:
    out = used.groupBy("chunk").agg(F.sum("nblks").alias("used_blks"), F.count("*").alias("n_extents"))
    return out.withColumn("available_blks", F.lit(capacity) - F.col("used_blks")).withColumn("used_pct", F.expr(f"used_blks * 100 div {capacity}"))


def deferred_free(used: DataFrame, frees: DataFrame, checkpoint: int) -> DataFrame:
    """Extents left when the frees of checkpoints up to ``checkpoint`` are applied; later ones are still pending."""
    return used.join(frees.where(F.col("cp_id") <= checkpoint).select("seq"), "seq", "left_anti")


def slabs(used: DataFrame) -> DataFrame:
    return used.groupBy(F.floor(F.log2("nblks")).cast("long").alias("slab")).agg(F.count("*").alias("n"), F.sum("nblks").alias("blks"))


def split_payload(df: DataFrame, block: int) -> DataFrame:
    """Payload rows for each piece of a write: the text of its blocks. df: id, data, pieces array<struct<blk_num, nblks>>."""
    rows = pieces(df, "pieces")
    order = Window.partitionBy("id").orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("piece.nblks").over(order), F.lit(0)) * block
    return rows.select("id", "piece_no", "piece.blk_num", "piece.nblks", F.substring(F.col("data"), (start + 1).cast("int"), (F.col("piece.nblks") * block).cast("int")).alias("part"))


def joined_payload(parts: DataFrame) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("piece_no", "part")))
    return parts.groupBy("id").agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "").alias("data"))


def normalised(pieces: Column) -> Column:
    """The pieces (blk_num, nblks) of a multi-piece extent in order, those that adjoin merged: equal for equal sets of blocks."""
    seed = F.expr("cast(array() as array<struct<blk_num: bigint, nblks: bigint>>)")

    def step(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["blk_num"] + F.get(acc, F.size(acc) - 1)["nblks"] == p["blk_num"])
        grown = F.struct(last["blk_num"].alias("blk_num"), (last["nblks"] + p["nblks"]).alias("nblks"))
        whole = F.struct(p["blk_num"].cast("long").alias("blk_num"), p["nblks"].cast("long").alias("nblks"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(whole)))

    return F.aggregate(F.sort_array(pieces), seed, step)


def fragmentation(free: DataFrame) -> DataFrame:
    """Per chunk: free extents, free blocks, the largest extent, and the part of the free blocks outside it, in percent."""
    out = free.groupBy("chunk").agg(F.count("*").alias("n_free"), F.sum("free_blks").alias("free_blks"), F.max("free_blks").alias("largest"))
    return out.withColumn("scattered_pct", F.expr("(free_blks - largest) * 100 div free_blks"))
