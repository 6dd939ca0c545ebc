"""A log kept on disk as Parquet by level: append, reopen, compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.keyvalue import latest

SCHEMA = "seq bigint, key bigint, op string, value string, level int"


def append(log: DataFrame, root: str, level: int = 0) -> None:
    """Writes operations as sorted files of a level; a key range stays together for pruning."""
    rows = log.select("seq", "key", "op", "value").withColumn("level", F.lit(level))
    rows.repartitionByRange("key").sortWithinPartitions("key", "seq").write.mode("append").partitionBy("level").parquet(root)


def reopen(spark: SparkSession, root: str) -> DataFrame:
    """The log as it was written, with its levels."""
    return spark.read.schema(SCHEMA).parquet(root)


def compact(spark: SparkSession, root: str, target: str, level: int, purge: bool = False) -> None:
    """Writes the newest mutation of each key to a new root's level; deletions stay unless purged."""
    newest = latest(reopen(spark, root))
    append(newest.where("op = 'put'") if purge else newest, target, level)
