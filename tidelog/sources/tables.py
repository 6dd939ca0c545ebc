"""Tables of the given folders, the operation log, runs and graphs that derive from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Events that make a run of the log, and keys that a run spans.
RUN_EVENTS, RUN_KEYS = 1000, 15
#: Edges of the nation graph below this weight stay.
WEIGHT_CUT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, key, op (put, get or del) and value of each event."""
    op = F.when(F.col("event_type") == "error", "del").when(F.col("event_type") == "view", "get").otherwise("put")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), F.col("props").alias("value"))


def run_cut(log: DataFrame) -> DataFrame:
    """The log's mutations with ts and run_id of the run by time and key range that each is in."""
    ts = F.floor(F.col("seq") / RUN_EVENTS)
    return log.where("op <> 'get'").withColumn("ts", ts).withColumn("run_id", ts * 100000 + F.floor(F.col("key") / RUN_KEYS))


def run_entries(log: DataFrame) -> DataFrame:
    """The log's mutations cut into sorted runs by time and key range; the newest of a key in a run
    stays: run_id, ts, level, key, op, value, seq."""
    newest = run_cut(log).groupBy("run_id", "ts", "key").agg(F.max(F.struct("seq", "op", "value")).alias("n"))
    return newest.select("run_id", "ts", (F.col("ts") % 3).alias("level"), "key", "n.op", "n.value", "n.seq")


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, w (u < v): the least price, as a whole number, of a trade between two nations."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.floor("l_extendedprice").cast("long").alias("w"))
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    pairs = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(order, line.l_orderkey == order.o_orderkey).join(customer, order.o_custkey == customer.c_custkey)
    return pairs.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst, w of undirected edges u, v, w."""
    return edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w").unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "w"))


def position(value: Column) -> Column:
    """Characters from 0, as a whole number."""
    return value.cast("long")


OPLOG_SQL = """oplog AS (SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'error' THEN 'del' WHEN 'view' THEN 'get' ELSE 'put' END AS op, props AS value FROM events)"""
RUNS_SQL = f"""{OPLOG_SQL},
entries AS (SELECT run_id, ts, ts % 3 AS level, key, op, value, seq FROM (SELECT *, seq // {RUN_EVENTS} AS ts, (seq // {RUN_EVENTS}) * 100000 + key // {RUN_KEYS} AS run_id FROM oplog WHERE op <> 'get')
    QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1)"""
EDGES_SQL = """edges AS (SELECT least(c_nationkey, s_nationkey)::BIGINT AS u, greatest(c_nationkey, s_nationkey)::BIGINT AS v, min(floor(l_extendedprice))::BIGINT AS w
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2)"""
