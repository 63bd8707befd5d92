"""From raw documents to token ids in five stages; each is written as Parquet and read again by the next.

1. quality: documents that the quality classifier rejects go.
2. near_dedup: one document of each group of near copies stays, the one with the least doc_id. Candidates are found by the
   SimHash search of operator 1, those further apart than its distance by keys of min-hashes; links are between
   documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by the sets themselves.
3. decontaminate: documents of which hit words make up a twentieth or more go.
4. mix: documents are left out, kept or repeated as the low-discrepancy schedule takes their words.
5. token_ids: the ids of all documents, written as Re-Pair shards and read back.

Rows with the same doc_id stay or go together; a row without doc_id is no copy's representative and stays in stage 2.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, quality, similar, tokens
from tidemark.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    near = similar.near_copies(docs)
    copies = written(near.where("doc_id != component_id").select("doc_id").distinct(), "copies")
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.report(decontam.spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.where("not (n_hit > 0 and 20 * n_hit >= n_words)").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, to the nearest whole: all but one of a source are taken whole. Empty ones stay."""
    taken = mixing.mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size")).cast("int"))
    times = written(taken.select(F.col("doc_id").alias("id"), times.alias("times")).where("times > 0"), "times")
    # As many rows as documents: never broadcast, so the stage does the same work a document at any size.
    mixed = docs.join(times.hint("merge"), docs["doc_id"].eqNullSafe(times["id"]))
    return mixed.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = tokens.stored(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES = [("quality", keep_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_ids", token_ids)]

#: SQL can express neither the classifier nor the tokenizer; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
