"""Reads of ordered, uniquely keyed tables.

Range predicates reach the Parquet scan, and pages are ``TakeOrderedAndProject``. Ranks over a whole table come
from range partitions and their counts, never from one sorted partition. Range partitions that are used twice are
written first: Spark samples their bounds, and merges small ones, anew in each branch of a plan. The other reads are lazy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written


def in_range(key: Column, low=None, high=None, low_in: bool = True, high_in: bool = True) -> Column:
    """The range predicate, each side open, closed or absent."""
    out = F.lit(True)
    if low is not None:
        out = out & ((key >= low) if low_in else (key > low))
    if high is not None:
        out = out & ((key <= high) if high_in else (key < high))
    return out


def normalised(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed integer ranges, sorted, those that touch or overlap merged."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(r for r in ranges if r[0] <= r[1]):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in normalised(ranges):
        out = out | key.between(low, high)
    return out


def point_get(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def multi_get(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """All wanted keys with a status; those absent have null columns. Spark broadcasts ``wanted`` if it is small."""
    found = df.withColumn("_found", F.lit(True))
    return wanted.join(found, key, "left").withColumn("status", F.when(F.col("_found"), "success").otherwise("not_found")).drop("_found")


def range_query(df: DataFrame, key: str, low=None, high=None, low_in=True, high_in=True, where: Column | None = None, batch: int | None = None) -> DataFrame:
    """Filter, then order, then limit: no match is ever skipped. A batch of 0 is empty."""
    out = df.where(in_range(F.col(key), low, high, low_in, high_in))
    if where is not None:
        out = out.where(F.coalesce(where, F.lit(False)))
    return out.orderBy(key) if batch is None else out.orderBy(key).limit(batch)


def snapshot_query(df: DataFrame, key: str, version: str, at: int, **more) -> DataFrame:
    """A serialisable read: of rows of versions up to ``at``, the latest of each key, then the range query."""
    seen = df.where(F.col(version) <= at)
    names = [c for c in df.columns if c != key]
    latest = seen.groupBy(key).agg(F.max_by(F.struct(*names), version).alias("_row")).select(key, "_row.*")
    return range_query(latest, key, **more)


def page(df: DataFrame, key: str, size: int, after=None, where: Column | None = None) -> DataFrame:
    """The next page by key, with exact ``has_more``: one row more than the page is fetched."""
    rows = range_query(df, key, low=after, low_in=False, where=where, batch=size + 1)
    order = Window.orderBy(key)  # a page and a row
    rows = rows.withColumn("_nth", F.row_number().over(order)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > size)
    return rows.where(F.col("_nth") <= size).drop("_nth")


def get_any(df: DataFrame, key: str, which: str, low=None, high=None) -> DataFrame:
    """One row of the range: 'left', 'right', 'mid' (of n rows the one at (n + 1) div 2) or 'any' (as left)."""
    rows = df.where(in_range(F.col(key), low, high))
    if which in ("left", "any"):
        return rows.orderBy(key).limit(1)
    if which == "right":
        return rows.orderBy(F.col(key).desc()).limit(1)
    n = F.broadcast(rows.agg(F.count("*").alias("_n")))  # one row
    return ranked(rows, key).join(n, F.col("nth") == F.expr("(_n + 1) div 2")).drop("nth", "_n")


def first_last(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def lower_bound(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) >= value).orderBy(key).limit(1)


def lower_bounds(df: DataFrame, key: str, wanted: DataFrame, within: str | None = None) -> DataFrame:
    """The first key at or after each wanted key: a forward as-of join by one sort, no join of all with all.

    ``within``: a column that both share and that bounds the search; without it, all rows are one sequence.
    """
    by = [within] if within else []
    have = df.select(*by, F.col(key).alias("_at"), F.col(key).alias("_found"), F.lit(1).alias("_asks"))
    asks = wanted.select(*by, F.col(key).alias("_at"), F.lit(None).cast(df.schema[key].dataType).alias("_found"), F.lit(0).alias("_asks"))
    both = have.unionByName(asks)
    if not by:  # each range partition is worked off alone; what its last rows look for is the first key of a later one
        both = written(both.repartitionByRange("_at").withColumn("_part", F.spark_partition_id()), "ranged")
        by = ["_part"]
    order = Window.partitionBy(*by).orderBy("_at", "_asks").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("bound", F.first("_found", ignorenulls=True).over(order)).where("_asks = 0")
    if within:
        return found.select(within, F.col("_at").alias(key), "bound")
    after = Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # a row for each partition
    firsts = both.groupBy("_part").agg(F.min("_found").alias("_first")).select("_part", F.min("_first").over(after).alias("_next"))
    return found.join(firsts, "_part").select(F.col("_at").alias(key), F.coalesce("bound", "_next").alias("bound"))


def ranked(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Adds ``nth``, from 1, in key order. Each range partition is sorted and numbered alone; their counts give the offsets.

    Rows of one key, which lie in one range partition, go by the other columns (maps and variants have no order), so reruns agree.
    """
    ties = [F.col(f"`{c}`") for c, kind in df.dtypes if c != key and "map<" not in kind and "variant" not in kind]
    ranged = (df.repartitionByRange(parts, key) if parts else df.repartitionByRange(key)).sortWithinPartitions(key, *ties)
    ids = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranked")  # the partition, and 33 bits of the row in it
    ids = ids.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    counts = ids.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = F.broadcast(counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    own = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ids.join(counts, "_part").withColumn("nth", F.col("_before") + own).drop("_part", "_id", "_before")


def page_numbers(df: DataFrame, key: str, size: int) -> DataFrame:
    return ranked(df, key).withColumn("page", F.expr(f"(nth - 1) div {size}")).drop("nth")


def neighbours(df: DataFrame, key: str, at: int, most: int) -> DataFrame:
    """``most`` entries around slot ``at`` (from 0); where the window would begin before 0, its end grows by as much."""
    low = at - (-(-most // 2) - 1)
    high = at + most // 2 + max(0, -low)
    return ranked(df, key).where((F.col("nth") - 1).between(max(0, low), high)).withColumn("slot", F.col("nth") - 1).drop("nth")


def nth_entry(df: DataFrame, key: str, slot: int) -> DataFrame:
    return ranked(df, key).where(F.col("nth") == slot + 1).drop("nth")


def key_runs(df: DataFrame, key: str) -> DataFrame:
    """Runs of consecutive integer keys: run_start, run_end, n."""
    return ranked(df.select(key), key).groupBy((F.col(key) - F.col("nth")).alias("_g")).agg(F.min(key).alias("run_start"), F.max(key).alias("run_end"), F.count("*").alias("n")).drop("_g")
