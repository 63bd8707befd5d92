"""Device topology: capacities, composition of virtual devices, and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def capacity(chunks: DataFrame, *levels: str) -> DataFrame:
    """Capacity and use at each level of the hierarchy, and in all (levels above are null)."""
    return chunks.rollup(*levels).agg(F.sum("capacity").alias("capacity"), F.sum("used").alias("used"), F.count("*").alias("n_chunks"))


def first_gap(chunks: DataFrame, size: int, start: int = 0) -> DataFrame:
    """The lowest place on each device with room for ``size`` between its chunks: device, lo. After the last there is room."""
    order = Window.partitionBy("device").orderBy("lo")
    ends = chunks.select("device", F.col("hi").alias("a"), F.lead("lo").over(order).alias("b"))
    head = chunks.groupBy("device").agg(F.min("lo").alias("b")).select("device", F.lit(start).cast("long").alias("a"), "b")
    return ends.unionByName(head).where(F.col("b").isNull() | (F.col("b") - F.col("a") >= size)).groupBy("device").agg(F.min("a").alias("lo"))


def composed(vdevs: DataFrame, least: int, most: int, block: int) -> DataFrame:
    """Chunks and size of virtual devices (size, n_chunks, streams): as many as streams at least, in [ceil(size / most), size div least], size a multiple."""
    striped = F.expr("ceil(n_chunks / streams) * streams").cast("long")
    low, high = F.expr(f"ceil(size / {most})").cast("long"), F.greatest(F.expr(f"size div {least}"), F.lit(1))
    out = vdevs.withColumn("chunks", F.least(F.greatest(striped, low), F.greatest(high, low)))
    return out.withColumn("chunk_size", F.expr(f"(size div chunks) div {block} * {block}")).withColumn("vdev_size", F.col("chunk_size") * F.col("chunks"))


def shares(vdev_chunks: Column, device: Column, total: Column, room: Column) -> Column:
    """A device's part of a virtual device's chunks, by its size, not beyond its room."""
    return F.least(F.floor(vdev_chunks * device / total), room).cast("long")


def percent_size(total: Column, pct: Column, page: int) -> Column:
    """A percentage of a size, up to a whole page."""
    return F.ceil(F.ceil(total * pct / 100) / page).cast("long") * page


def pressure(df: DataFrame, used: str, limit: str, high: int = 50, critical: int = 90) -> DataFrame:
    pct = F.expr(f"{used} * 100 div {limit}")
    return df.withColumn("used_pct", pct).withColumn("level", F.when(pct >= critical, "critical").when(pct >= high, "high").otherwise("ok"))
