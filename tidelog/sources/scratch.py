"""Lineage cuts for iterative jobs, in the folder that the cluster names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_registered: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only a session on one
    machine may do without and gets a folder of that machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """This session's own folder in the shared one."""
    base = f"{shared_dir(spark)}/tidelog-loops-{spark.sparkContext.applicationId}"
    if base not in _registered:
        _registered.add(base)
        atexit.register(_delete, spark, base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, reread.

    Rows and plan are cut: what is reread carries the table's real size, where a checkpoint keeps
    the estimates of all joins before it, which multiply in a loop. Deleted when Python ends.
    """
    spark = df.sparkSession
    path = f"{scratch_path(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """The same, and for how many rows the condition holds, counted while they are written."""
    seen = Observation()
    found = checkpointed(df.observe(seen, F.count_if(condition).alias("n")))
    return found, seen.get["n"]


def _delete(spark: SparkSession, base: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(base)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before
        return
