"""Integrity audits: each gives the rows that break a rule, so a sound table gives none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def key_order(df: DataFrame, page: str, slot: str, key: str) -> DataFrame:
    """Slots of a page whose key isn't above the one before."""
    before = F.lag(key).over(Window.partitionBy(page).orderBy(slot))
    return df.withColumn("before_key", before).where(F.col("before_key") >= F.col(key))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def child_bounds(links: DataFrame, children: DataFrame) -> DataFrame:
    """Children with a key above their parent's bound, or of a level that isn't one below. links: parent_level, child, bound."""
    own = children.groupBy("node", "level").agg(F.max("key").alias("top"))
    joined = links.join(own, links["child"] == own["node"], "left")
    return joined.where("node is null or top > bound or level != parent_level - 1").select("child", "bound", "top")


def sibling_links(nodes: DataFrame) -> DataFrame:
    """Nodes whose sibling link isn't the next node of their level. nodes: level, node, first_key, next_node."""
    following = F.lead("node").over(Window.partitionBy("level").orderBy("first_key"))
    return nodes.withColumn("following", following).where(~F.col("following").eqNullSafe(F.col("next_node")))


def node_counts(nodes: DataFrame) -> DataFrame:
    """Nodes and entries of each level of a tree. nodes: level, node, entries."""
    return nodes.groupBy("level").agg(F.count("*").alias("n_nodes"), F.sum("entries").alias("n_entries"))


def occupancy(nodes: DataFrame, capacity: int) -> DataFrame:
    return nodes.withColumn("occupancy_pct", F.expr(f"entries * 100 div {capacity}"))


def chain(df: DataFrame, group: str, order: str, checksum: str, before: str) -> DataFrame:
    """Links of a checksum chain that don't repeat the checksum of their predecessor."""
    prior = F.lag(checksum).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("_prior", prior).where(F.col("_prior").isNotNull() & (F.col("_prior") != F.col(before))).drop("_prior")
