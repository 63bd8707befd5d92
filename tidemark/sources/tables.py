"""Shared tables seen as the engine's abstractions: indexes, logs, journals, extents, metadata, topology."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset: a temporary one in local mode, as in tests; an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and losing executors loses nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def orders_index(spark: SparkSession, folder: str) -> DataFrame:
    """Fixed-length key: k -> v (customer), status, price."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")
    )


def parts_index(spark: SparkSession, folder: str) -> DataFrame:
    """Variable-length key: eight hex digits of the id and a text; text order equals id order."""
    key = F.concat(F.lpad(F.hex("p_partkey"), 8, "0"), F.lit("-"), F.col("p_name"))
    return table(spark, folder, "part").select(key.alias("k"), F.col("p_size").cast("long").alias("v"))


def events_index(spark: SparkSession, folder: str) -> DataFrame:
    """Composite key (chunk, shard, blob) -> v, ordered field by field."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("chunk"), F.col("event_type").alias("shard"), F.col("event_id").alias("blob"), F.round(F.col("value") * 100).cast("long").alias("v")
    )


#: Every 17th record is a hole, every 29th arrived late.
HOLE, LATE = 17, 29


def event_log(spark: SparkSession, folder: str, holes: bool = True) -> DataFrame:
    """A log: logdev, store, lsn from 0 in each store, idx (device order), size, code, data. Holes are missing rows."""
    lsn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    out = table(spark, folder, "events").select(
        (F.col("user_id") % 4).cast("int").alias("logdev"), F.col("user_id").alias("store"), lsn.cast("long").alias("lsn"), F.col("event_id").alias("idx"),
        F.length("props").cast("long").alias("size"), F.col("event_type").alias("code"), F.col("props").alias("data"), F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    return out.where(F.col("idx") % HOLE != 0) if holes else out


def extents(spark: SparkSession, folder: str, block: int = 4096) -> DataFrame:
    """Block requests from documents: seq, chunk, nblks."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"), (F.col("doc_id") % 8).cast("int").alias("chunk"), F.greatest(F.ceil(F.coalesce("n_chars", F.lit(0)) / block), F.lit(1)).cast("long").alias("nblks")
    )


def peers(spark: SparkSession, folder: str) -> DataFrame:
    """Replicas of groups: suppliers of a nation. grp, peer, idx (replicated), priority, can_vote."""
    return table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("peer"), (F.col("s_suppkey") * 37 % 5000).alias("idx"),
        (F.col("s_suppkey") * 13 % 101).cast("int").alias("priority"), (F.col("s_suppkey") % 5 != 0).alias("can_vote"),
    )
