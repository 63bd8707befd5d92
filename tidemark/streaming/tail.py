"""Logs as streams: tailing, group commits, folds of journals and event-time windows (an extension)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, folder: str, schema, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process what there is, micro-batch by micro-batch, and stop; a restart goes on after the last committed batch."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def store_tails(stream: DataFrame) -> DataFrame:
    """Per store the highest lsn, the count and the device index at the highest lsn, as a running aggregate."""
    return stream.groupBy("logdev", "store").agg(F.max("lsn").alias("tail_lsn"), F.count("*").alias("n_records"), F.max_by("idx", "lsn").alias("tail_idx"))


def deduplicated(stream: DataFrame, event_time: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(["server_id", "term", "dsn"])


def tumbling(stream: DataFrame, event_time: str, width: str, late: str, *labels: str) -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are dropped."""
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, late)
    return timed.groupBy(F.window(event_time, width), *labels).agg(F.count("*").alias("n")).select("window.start", "window.end", *labels, "n")


def contiguous(stream: DataFrame) -> DataFrame:
    """Per store the last lsn of the gap-free run from 0, updated as records arrive in any order.

    The state of a store is that lsn and the records beyond it, which wait for their gap to be filled.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        upto, waiting = state.get if state.exists else (-1, [])
        beyond = set(waiting)
        for p in parts:
            beyond.update(p["lsn"].tolist())
        while upto + 1 in beyond:
            beyond.discard(upto + 1)
            upto += 1
        state.update((upto, sorted(x for x in beyond if x > upto)))
        yield pd.DataFrame({"logdev": [key[0]], "store": [key[1]], "upto": [upto]})

    return stream.groupBy("logdev", "store").applyInPandasWithState(
        fold, "logdev int, store long, upto long", "upto long, waiting array<long>", "update", GroupStateTimeout.NoTimeout
    )
