"""Writes to keyed tables as pure functions: the new state, and a result with a status for each request.

Nothing is changed in place; a state is published by ``sources.snapshots``. Statuses: success,
already_exists, not_found, filtered_out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import in_range


def _matched(state: DataFrame, new: DataFrame, key: str, how: str) -> DataFrame:
    cur = state.select(key, F.col("v").alias("existing_v"), F.lit(True).alias("_cur"))
    req = new.select(key, F.col("v").alias("new_v"), F.lit(True).alias("_req"))
    return cur.join(req, key, how)


def put(state: DataFrame, new: DataFrame, key: str = "k", kind: str = "upsert", decide: Column | None = None) -> DataFrame:
    """All keys after the put with what happened to them: key, v (null: gone), existing_v, status (null: not asked).

    ``kind``: insert, update or upsert. ``decide``: a Column over existing_v and new_v that gives keep, replace or
    remove; it is asked for existing keys, before the kind, and anything but replace is filtered_out.
    """
    m = _matched(state, new, key, "full")
    cur, req = F.col("_cur").isNotNull(), F.col("_req").isNotNull()
    status = F.when(~req, F.lit(None).cast("string"))
    if decide is not None:
        status = status.when(cur & (decide != "replace"), "filtered_out")
    if kind == "insert":
        status = status.when(cur, "already_exists")
    if kind == "update":
        status = status.when(~cur, "not_found")
    m = m.withColumn("status", status.otherwise("success"))
    return m.select(key, F.when(F.col("status") == "success", F.col("new_v")).otherwise(F.col("existing_v")).alias("v"), "existing_v", "status")


def state_of(result: DataFrame, key: str = "k") -> DataFrame:
    """The table after a put: a request for a key that isn't there and failed leaves none."""
    return result.where("status is null or status in ('success', 'already_exists', 'filtered_out')").select(key, "v")


def results_of(result: DataFrame, key: str = "k") -> DataFrame:
    """A row for each request: key, existing_v, status."""
    return result.where("status is not null").select(key, "existing_v", "status")


def range_update(state: DataFrame, value: Column, low, high, key: str = "k", decide: Column | None = None) -> DataFrame:
    """One value for all existing keys of the range; ``decide`` as in put, but here remove removes. Adds ``changed``."""
    inside = in_range(F.col(key), low, high)
    verdict = F.when(inside, decide if decide is not None else F.lit("replace")).otherwise("keep")
    out = state.withColumn("_d", F.coalesce(verdict, F.lit("keep"))).where("_d != 'remove'")
    return out.withColumn("changed", F.col("_d") == "replace").withColumn("v", F.when(F.col("changed"), value).otherwise(F.col("v"))).drop("_d")


def interval_put(state: DataFrame, low: int, high: int, first, key: str = "k", kind: str = "upsert") -> DataFrame:
    """Every key of the range gets ``first`` plus its distance from ``low``; kinds as in put. Key ranges are made by Spark's range."""
    keys = state.sparkSession.range(low, high + 1).select(F.col("id").alias(key), (F.lit(first) + F.col("id") - low).alias("v"))
    return put(state, keys, key, kind)


def tombstone(state: DataFrame, low, high, key: str = "k", zero=0) -> DataFrame:
    """Soft delete: values in the range become zero; those already zero don't count as changed."""
    return range_update(state, F.lit(zero), low, high, key, F.when(F.col("v") != zero, F.lit("replace")).otherwise("keep"))


def tombstone_status(state: DataFrame, wanted: DataFrame, key: str = "k", zero=0) -> DataFrame:
    """Per wanted key: success, filtered_out (already zero) or not_found."""
    cur = state.select(key, F.col("v").alias("existing_v"), F.lit(True).alias("_cur"))
    status = F.when(F.col("_cur").isNull(), "not_found").when(F.col("existing_v") == zero, "filtered_out").otherwise("success")
    return wanted.select(key).join(cur, key, "left").select(key, status.alias("status"))


def remove(state: DataFrame, wanted: DataFrame, key: str = "k") -> tuple[DataFrame, DataFrame]:
    """The state without the wanted keys, and the removed rows."""
    return state.join(wanted.select(key), key, "left_anti"), state.join(wanted.select(key), key, "left_semi")


def range_remove(state: DataFrame, low, high, key: str = "k", where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The state without the rows of the range that pass the filter, and those rows."""
    gone = in_range(F.col(key), low, high) & (F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    gone = F.coalesce(gone, F.lit(False))
    return state.where(~gone), state.where(gone)


def remove_any(state: DataFrame, which: str, low, high, key: str = "k") -> tuple[DataFrame, DataFrame]:
    from .index import get_any

    return remove(state, get_any(state, key, which, low, high), key)


def tombstone_gc(state: DataFrame, low, high, key: str = "k", zero=0) -> tuple[DataFrame, DataFrame]:
    """Remove the tombstones of a range: survivors of all, and what went."""
    return range_remove(state, low, high, key, F.col("v") == zero)


def state_diff(a: DataFrame, b: DataFrame, key: str = "k") -> DataFrame:
    """Keys in one state only, or with different values: key, side (left, right, both), left_v, right_v."""
    x = a.select(key, F.col("v").alias("left_v"), F.lit(True).alias("_l"))
    y = b.select(key, F.col("v").alias("right_v"), F.lit(True).alias("_r"))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    out = x.join(y, key, "full").withColumn("side", side)
    return out.where((F.col("side") != "both") | ~F.col("left_v").eqNullSafe(F.col("right_v"))).select(key, "side", "left_v", "right_v")
