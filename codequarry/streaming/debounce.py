"""Debounced changes: events that follow each other within a gap are one change, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, keys: list[str], time: str, gap: str = "1500 milliseconds") -> DataFrame:
    """(keys, started, ended, n): an event exactly one gap after another belongs to it."""
    return events.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n")).drop("w")


def watch(spark: SparkSession, folder: str, schema: str, on_change: Callable[[DataFrame, int], None], checkpoint: str, time: str = "ts", gap: str = "1500 milliseconds", late: str = "10 seconds") -> StreamingQuery:
    """A stream of change events (Parquet files in a folder) to debounced changes, handed on once they are quiet."""
    events = spark.readStream.schema(schema).parquet(folder).withWatermark(time, late)
    return sessions(events, ["path"], time, gap).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(on_change).start()
