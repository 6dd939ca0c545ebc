"""The log as a stream: the newest mutation of each key, and operations counted by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_stream(log: DataFrame) -> DataFrame:
    """key, seq, op, value as they change, for a sink in update or complete mode. The state is one
    row for each key, kept and recovered by the state store."""
    newest = log.where("op <> 'get'").groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("n"))
    return newest.select("key", "n.seq", "n.op", "n.value")


def windowed_ops(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, event_type, ops in tumbling windows; later than the watermark is dropped."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("ops"))
    return windows.select(F.col("window.start").alias("start"), "event_type", "ops")
