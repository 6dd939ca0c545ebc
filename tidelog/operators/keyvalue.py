"""Point reads, deletes, scans and snapshots of a versioned key-value log.

The log is (seq, key, op, value), op one of put, get and del. State is never kept: what a key held
at some time is the last mutation before it. A key may have any share of the log: running values
are carried in two steps, the last mutation of each block of BLOCK operations and then the blocks
before, so that no task needs all operations of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.plans.registry import query
from tidelog.sources.tables import OPLOG_SQL, oplog, table

BLOCK = 4096
#: Operations after which the store of kv_reset_epoch is emptied.
RESET = 797


def latest(log: DataFrame) -> DataFrame:
    """key, seq, op, value: the newest mutation of each key, deletions included."""
    newest = log.where("op <> 'get'").groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("n"))
    return newest.select("key", "n.seq", "n.op", "n.value")


def snapshot(log: DataFrame) -> DataFrame:
    """key, seq, value of the keys that are there."""
    return latest(log).where("op = 'put'").select("key", "seq", "value")


def with_previous(log: DataFrame, block: int = BLOCK, mark: Column | None = None) -> DataFrame:
    """The log and, as a struct, the last mutation of the key before each operation (or null), or
    the last mark instead: a column that is null where an operation is none."""
    if mark is None:
        mark = F.when(F.col("op") != "get", F.struct("seq", "op", "value"))
    cut = log.withColumn("block", F.floor(F.col("seq") / block)).withColumn("m", mark)
    blocks = cut.where("m IS NOT NULL").groupBy("key", "block").agg(F.max("m").alias("last"))
    marks = cut.select("key", "block").distinct().join(blocks, ["key", "block"], "left")
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("key", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("key", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    near = cut.withColumn("near", F.last("m", ignorenulls=True).over(inside))
    return near.join(carried, ["key", "block"]).select("seq", "key", "op", "value", F.coalesce("near", "carried").alias("previous"))


def op_results(log: DataFrame) -> DataFrame:
    """What each operation returns: a get its value or '', a delete whether the key was there."""
    there = F.coalesce(F.col("previous.op") == "put", F.lit(False))
    found = F.when(F.col("op") == "put", None).otherwise(there)
    value = F.when(F.col("op") == "get", F.when(there, F.coalesce("previous.value", F.lit(""))).otherwise(F.lit("")))
    return with_previous(log).select("seq", "key", "op", found.alias("found"), value.alias("result"))


def batch_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """key, value ('' if absent), found for each probed key."""
    return probes.join(snapshot(log), "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"), F.col("seq").isNotNull().alias("found"))


def range_scan(log: DataFrame, first: int, last: int) -> DataFrame:
    """key, value from first to last, both included, in order."""
    return snapshot(log.where(F.col("key").between(first, last))).select("key", "value").orderBy("key")


def lower_bounds(log: DataFrame, probes: DataFrame, reach: int) -> DataFrame:
    """key, bound: the first key there is from key to key + reach, or null.

    Keys are dealt into buckets as wide as the reach: a probe looks into its own and the next."""
    live = snapshot(log).select(F.col("key").alias("bound"), F.floor(F.col("key") / (reach + 1)).alias("bucket"))
    place = F.floor(F.col("key") / (reach + 1))
    asked = probes.select("key", F.explode(F.array(place, place + 1)).alias("bucket"))
    met = asked.join(live, "bucket", "left").withColumn("bound", F.when(F.col("bound").between(F.col("key"), F.col("key") + reach), F.col("bound")))
    return met.groupBy("key").agg(F.min("bound").alias("bound"))


def epoch_snapshots(log: DataFrame, operations: int) -> DataFrame:
    """epoch, key, seq, value: what is there at the end of each epoch, when the store is emptied
    after every so many operations."""
    epoch = F.floor(F.col("seq") / operations).alias("epoch")
    newest = log.where("op <> 'get'").groupBy(epoch, "key").agg(F.max(F.struct("seq", "op", "value")).alias("n"))
    return newest.where("n.op = 'put'").select("epoch", "key", "n.seq", "n.value")


def first_wins(log: DataFrame) -> DataFrame:
    """key, value, seq of the first put after the key's last delete, if any."""
    deleted = log.where("op = 'del'").groupBy("key").agg(F.max("seq").alias("gone"))
    puts = log.where("op = 'put'").join(deleted, "key", "left").where("seq > coalesce(gone, -1)")
    return puts.groupBy("key").agg(F.min(F.struct("seq", "value")).alias("f")).select("key", "f.value", "f.seq")


@query(f"WITH {OPLOG_SQL} SELECT key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM oplog WHERE op <> 'get') WHERE n = 1 AND op = 'put'")
def kv_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(oplog(spark, sf_dir))


@query(f"""WITH {OPLOG_SQL}, s AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM oplog WHERE op <> 'get' GROUP BY key)
SELECT c_custkey AS key, CASE WHEN op = 'put' THEN value ELSE '' END AS value, coalesce(op = 'put', false) AS found FROM customer LEFT JOIN s ON key = c_custkey""")
def kv_batch_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_get(oplog(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


_BEFORE = f"""{OPLOG_SQL}, p AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN op END IGNORE NULLS) OVER b AS was, last_value(CASE WHEN op <> 'get' THEN value END IGNORE NULLS) OVER b AS held
FROM oplog WINDOW b AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {_BEFORE} SELECT seq, key, CASE WHEN was = 'put' THEN held ELSE '' END AS value FROM p WHERE op = 'get'")
def kv_get_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_results(oplog(spark, sf_dir)).where("op = 'get'").select("seq", "key", F.col("result").alias("value"))


@query(f"WITH {_BEFORE} SELECT seq, key, coalesce(was = 'put', false) AS deleted FROM p WHERE op = 'del'")
def kv_delete_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_results(oplog(spark, sf_dir)).where("op = 'del'").select("seq", "key", F.col("found").alias("deleted"))


@query(f"""WITH {_BEFORE} SELECT seq, key, op, CASE WHEN op <> 'put' THEN coalesce(was = 'put', false) END AS found,
CASE WHEN op = 'get' THEN CASE WHEN was = 'put' THEN held ELSE '' END END AS result FROM p""")
def kv_op_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_results(oplog(spark, sf_dir))


@query(f"WITH {_BEFORE} SELECT seq, key, coalesce(was = 'put', false) AS found FROM p WHERE op = 'get'")
def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op_results(oplog(spark, sf_dir)).where("op = 'get'").select("seq", "key", "found")


@query(f"WITH {OPLOG_SQL}, s AS (SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM oplog WHERE op <> 'get' GROUP BY key) SELECT key, value FROM s WHERE op = 'put' AND key BETWEEN 20 AND 90")
def kv_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_scan(oplog(spark, sf_dir), 20, 90)


@query(f"""WITH {OPLOG_SQL}, s AS (SELECT key AS live FROM oplog WHERE op <> 'get' GROUP BY key HAVING arg_max(op, seq) = 'put')
SELECT c_custkey AS key, min(live) AS bound FROM customer LEFT JOIN s ON live BETWEEN c_custkey AND c_custkey + 5 GROUP BY 1""")
def kv_lower_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lower_bounds(oplog(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), 5)


@query(f"""WITH {OPLOG_SQL} SELECT seq // {RESET} AS epoch, key, max(seq) AS seq, arg_max(value, seq) AS value FROM oplog WHERE op <> 'get' GROUP BY 1, 2 HAVING arg_max(op, seq) = 'put'""")
def kv_reset_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epoch_snapshots(oplog(spark, sf_dir), RESET)


@query(f"""WITH {OPLOG_SQL}, g AS (SELECT key AS k, max(seq) AS gone FROM oplog WHERE op = 'del' GROUP BY key)
SELECT key, arg_min(value, seq) AS value, min(seq) AS seq FROM oplog LEFT JOIN g ON key = k WHERE op = 'put' AND seq > coalesce(gone, -1) GROUP BY key""")
def first_wins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_wins(oplog(spark, sf_dir))


@query(f"WITH {OPLOG_SQL} SELECT key, arg_max(value, seq) AS value, count(*) AS writes FROM oplog WHERE op = 'put' GROUP BY key")
def last_wins_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    puts = oplog(spark, sf_dir).where("op = 'put'")
    return puts.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.count(F.lit(1)).alias("writes"))
