"""Counters, histograms and status from rows; the only aggregations that the ordered store itself reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counters(df: DataFrame, labels: list[str], value: str) -> DataFrame:
    return df.groupBy(*labels).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def histogram(df: DataFrame, labels: list[str], value: str) -> DataFrame:
    """Counts by powers of two: bucket b holds 2**b <= value < 2**(b + 1), -1 what is below 1. The edges are our own."""
    bucket = F.when(F.col(value) < 1, -1).otherwise(F.length(F.bin(F.col(value))) - 1).cast("long")
    return df.groupBy(*labels, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def reduced(buckets: DataFrame, labels: list[str]) -> DataFrame:
    """A histogram as its sum of counts and number of buckets, as production builds export it."""
    return buckets.groupBy(*labels).agg(F.sum("n").alias("n"), F.count("*").alias("n_buckets"))


def cardinality(series: DataFrame) -> DataFrame:
    """Time series by component: entities times buckets (+ sum and count), or 2 where reduced. series: component, metric, entities, buckets, is_reduced."""
    full = F.col("entities") * (F.col("buckets") + 2)
    return series.groupBy("component").agg(F.sum(full).alias("before"), F.sum(F.when(F.col("is_reduced"), 2 * F.col("entities")).otherwise(full)).alias("after"))


def status_json(df: DataFrame, module: str, columns: list[str], wanted: list[str] | None = None) -> DataFrame:
    """A JSON status for each module; of the wanted ones, unknown modules are left out."""
    rows = df if wanted is None else df.where(F.col(module).isin(wanted))
    return rows.select(module, F.to_json(F.struct(*columns)).alias("status"))
