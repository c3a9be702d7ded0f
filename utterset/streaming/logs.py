"""Streaming metric logs: last-wins merge, interval and window means."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from utterset.operators import runlogs

LOG_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("ts", T.TimestampType()),
    ]
)


def read_log_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_batch: int = 1000) -> DataFrame:
    """New log files as a stream of long metric rows."""
    return (
        spark.readStream.format(fmt).schema(LOG_SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(path)
    )


def start_merge(stream: DataFrame, target: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Last-wins merge into ``target``: one folder per micro-batch.

    A batch is reduced to its last value per (run, step, key) and written under
    its own number, so a repeated batch overwrites itself and nothing else.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        reduced = runlogs.merge_rows(batch)
        reduced.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def read_merged(spark: SparkSession, target: str) -> DataFrame:
    """The merged log: the same reduction over the batch folders."""
    return runlogs.merge_rows(spark.read.parquet(target)).select("run", "step", "key", "value")


def compact(spark: SparkSession, target: str, compacted: str) -> None:
    """Write the merged state once, to start a new target from."""
    runlogs.merge_rows(spark.read.parquet(target)).write.mode("overwrite").parquet(f"{compacted}/batch_id=-1")


def interval_stream(stream: DataFrame, every: int) -> DataFrame:
    """Interval means of a stream (update mode): the batch grouping, unchanged."""
    return stream.groupBy(
        runlogs.interval_of(F.col("step"), every).alias("interval"), "run", "key"
    ).agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.count("value").alias("count"))


COUNTER_STATE = "total long"
COUNTER_OUTPUT = "run string, key string, added long, total long"


def cumulative_counters(stream: DataFrame) -> DataFrame:
    """Counters per (run, key) that survive every interval (update mode)."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0
        added = sum(len(pdf) for pdf in batches)
        state.update((total + added,))
        yield pd.DataFrame({"run": [key[0]], "key": [key[1]], "added": [added], "total": [total + added]})

    return stream.groupBy("run", "key").applyInPandasWithState(
        count, COUNTER_OUTPUT, COUNTER_STATE, "update", "NoTimeout"
    )


def window_means(stream: DataFrame, *, ts: str = "ts", window: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Metric means per event-time window, rows later than ``lateness`` dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return (
        timed.withWatermark(ts, lateness)
        .groupBy(F.window(ts, window).alias("w"), "key")
        .agg(F.avg("value").alias("mean"), F.count("value").alias("count"))
        .select(F.col("w.start").alias("window_start"), "key", "mean", "count")
    )
