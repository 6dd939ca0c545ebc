"""Helpers that the operators share: tables, shared storage, words."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.scratch import shared_dir

#: Whether Spark deletes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space of the word rules of the contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = "\t\n\x0b\x0c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, reread.

    A lost executor costs no more than the tasks it ran: what is written stays. The
    tables of a session are deleted when the driver's Python ends, the shuffles behind a
    table as soon as it is written (Spark would keep them until the driver's JVM collects).
    discard() deletes a table sooner.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/tidelog-{spark.sparkContext.applicationId}"
    _delete_at_exit(spark, base)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _paths[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for found in tables:
        _delete(found.sparkSession, _paths.pop(found))


_registered: set[str] = set()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _delete(spark: SparkSession, place: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _delete_at_exit(spark: SparkSession, base: str) -> None:
    if base in _registered:
        return
    _registered.add(base)

    def delete() -> None:
        try:
            _delete(spark, base)
        except Exception:  # the session has ended before
            return

    atexit.register(delete)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)


def without(text: Column, chars: str, put: str = "") -> Column:
    """text with each of the characters replaced by put; runs over bytes, not by a pattern."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(put))
    return text


def space_words(text: Column) -> Column:
    """The array of words between white space; null has none.

    With one space as the only separator, split takes its short way without a pattern.
    """
    return F.array_remove(F.split(without(F.coalesce(text, F.lit("")), SPACES, " "), " "), "")
