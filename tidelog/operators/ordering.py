"""Total orders over data of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.plans.registry import query
from tidelog.sources.scratch import checkpointed
from tidelog.sources.tables import table

#: monotonically_increasing_id has the partition above this bit.
_PART = 33


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """df with its rank (from 1) in a total order: range partitions are sorted each, and a rank is
    the place in the partition after the sizes of the partitions before it."""
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PART)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND((1 << _PART) - 1) + 1).drop("__part", "__before", "__at")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank FROM orders")
def sort_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "rank")


@query("SELECT user_id AS key, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3 GROUP BY 1")
def newest_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.col("event_id").desc())
    top = table(spark, sf_dir, "events").select("user_id", "event_id").withColumn("n", F.row_number().over(order)).where("n <= 3")
    return top.groupBy(F.col("user_id").alias("key")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("events"))
