"""Substring search and failure tables; positions are in characters, from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.registry import query
from tidelog.sources.tables import table

#: Needles up to which they are broadcast.
NEEDLES = 100_000


def index_of(text: Column, needle: Column) -> Column:
    """Where the needle first stands; -1 where it doesn't, 0 for an empty one."""
    return (F.instr(text, needle) - 1).cast("long")


def count_of(text: Column, needle: Column) -> Column:
    """How often the needle stands without overlap; 0 for an empty one."""
    left = F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) == 0, F.lit(0)).otherwise(F.floor((F.length(text) - left) / F.length(needle))).cast("long")


def failure_table(needle: Column) -> Column:
    """For each prefix the length of its longest proper border, less 1, comma-joined."""

    def border(end: Column) -> Column:
        fits = F.filter(F.sequence(F.lit(0), end - 1), lambda b: F.substring(needle, F.lit(1), b) == F.substring(needle, end - b + 1, b))
        return (F.array_max(fits) - 1).cast("string")

    return F.when(F.length(needle) == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(needle)), border), ","))


def search(texts: DataFrame, needles: DataFrame, limit: int = NEEDLES) -> DataFrame:
    """Each of texts (doc_id, text) with each of needles (item_id, needle) that stands in it.

    The needles are the query set, and every text meets all of them where it is read; up to limit
    they are broadcast, beyond it they are dealt in blocks.
    """
    held = F.broadcast(needles) if needles.count() <= limit else needles
    return texts.join(held, F.expr("contains(text, needle)"))


def _with_needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.get(F.split("text", " "), F.lit(0)).alias("needle"))
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), needles)


_NEEDLES = "d AS (SELECT doc_id, item_id, d.text, needle FROM documents d JOIN (SELECT item_id, split_part(text, ' ', 1) AS needle FROM benchmark) ON contains(d.text, needle))"


@query(f"WITH {_NEEDLES} SELECT doc_id, item_id, strpos(text, needle)::BIGINT - 1 AS position FROM d")
def substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_needles(spark, sf_dir).select("doc_id", "item_id", index_of(F.col("text"), F.col("needle")).alias("position"))


@query(f"WITH {_NEEDLES} SELECT doc_id, item_id, ((length(text) - length(replace(text, needle, ''))) // length(needle))::BIGINT AS times FROM d")
def substring_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_needles(spark, sf_dir).select("doc_id", "item_id", count_of(F.col("text"), F.col("needle")).alias("times"))


@query("""SELECT item_id, array_to_string(list_transform(range(1, length(text) + 1), lambda j: list_max(list_filter(range(0, j), lambda b: left(text, b) = right(left(text, j), b))) - 1), ',') AS failure FROM benchmark""")
def kmp_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", failure_table(F.col("text")).alias("failure"))
