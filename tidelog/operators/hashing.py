"""Hash buckets with chain order, and two-choice placement, as relations over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.keyvalue import with_previous
from tidelog.operators.ordering import ranked
from tidelog.plans.registry import query
from tidelog.sources.scratch import checkpointed
from tidelog.sources.tables import OPLOG_SQL, oplog, table

BUCKETS, HALF = 10, 5000
#: Operations of a stretch of time in which ends are counted at once.
BLOCK = 4096


def marked(log: DataFrame) -> DataFrame:
    """seq, key, op, there (whether the key is there before), start (seq, where a put begins a life)."""
    there = F.coalesce(F.col("previous.op") == "put", F.lit(False))
    return with_previous(log).select("seq", "key", "op", there.alias("there"), F.when((F.col("op") == "put") & ~there, F.col("seq")).alias("start"))


def lives(operations: DataFrame) -> DataFrame:
    """key, start, stop of marked operations: from the put that finds the key absent to its delete
    (null: still there)."""
    starts = operations.where("start IS NOT NULL").select("key", "start")
    stops = operations.where("op = 'del' AND there").select("key", F.col("seq").alias("stop"))
    # A key's lives don't overlap: the n-th start belongs to the n-th stop.
    order = Window.partitionBy("key")
    a = starts.withColumn("n", F.row_number().over(order.orderBy("start")))
    b = stops.withColumn("n", F.row_number().over(order.orderBy("stop")))
    return a.join(b, ["key", "n"], "left").select("key", "start", "stop")


def earlier_ends(ended: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """seq, n: for each of asked (seq, bucket, mine) how many of ended (bucket, start, stop) have start
    < mine and stop < seq.

    [0, mine) is cut at its binary places into blocks of times, one for each place that is set; a life
    stands once in each level's block of its start. So rows grow with the logarithm of the times, not
    with the lives. In a block, ends before a search are counted inside a stretch of time and over the
    stretches before, as a block can hold any share of the lives.
    """
    levels = len(bin(asked.agg(F.coalesce(F.max("mine"), F.lit(0))).first()[0])) - 2
    each = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    points = ended.select("bucket", "start", F.col("stop").alias("time"), each).select("bucket", "level", F.expr("shiftright(start, level)").alias("place"), "time", F.lit(None).cast("long").alias("seq"))
    searches = asked.select("bucket", "mine", "seq", each).where("shiftright(mine, level) & 1 = 1")
    searches = searches.select("bucket", "level", (F.expr("shiftright(mine, level)") - 1).alias("place"), F.col("seq").alias("time"), "seq")
    all_ = points.unionByName(searches).withColumn("stretch", F.floor(F.col("time") / block))
    end = F.col("seq").isNull().cast("long")
    totals = all_.groupBy("bucket", "level", "place", "stretch").agg(F.sum(end).alias("ends"))
    over = Window.partitionBy("bucket", "level", "place").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("bucket", "level", "place", "stretch", F.coalesce(F.sum("ends").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("bucket", "level", "place", "stretch").orderBy("time").rangeBetween(Window.unboundedPreceding, -1)
    counted = all_.withColumn("near", F.coalesce(F.sum(end).over(inside), F.lit(0))).where("seq IS NOT NULL")
    return counted.join(before, ["bucket", "level", "place", "stretch"]).groupBy("seq").agg(F.sum(F.col("near") + F.col("before")).alias("n"))


def bucket_search(log: DataFrame) -> DataFrame:
    """seq, key, bucket, found, chain_index of each get: how many keys of the bucket that are there
    began to live before it, which is how many began before less how many of these have ended."""
    operations = checkpointed(marked(log))
    own = with_previous(operations.select("seq", "key", "op", F.col("there").alias("value"), "start"), mark=F.col("start")).where("op = 'get' AND value")
    mine = checkpointed(own.select("seq", F.col("previous").alias("mine"), F.pmod("key", F.lit(BUCKETS)).alias("bucket")))
    lived = checkpointed(lives(operations).withColumn("bucket", F.pmod("key", F.lit(BUCKETS))))
    # How many lives of the bucket begin before a life does: its place among them.
    order = ranked(lived.select("bucket", "start"), "bucket", "start")
    first = order.groupBy("bucket").agg(F.min("rank").alias("first"))
    begins = order.join(F.broadcast(first), "bucket").select(F.col("start").alias("mine"), (F.col("rank") - F.col("first")).alias("begun"))
    ends = earlier_ends(lived.where("stop IS NOT NULL"), mine)
    found = mine.join(begins, "mine").join(ends, "seq", "left").select("seq", (F.col("begun") - F.coalesce("n", F.lit(0))).alias("chain_index"))
    asked = log.where("op = 'get'").select("seq", "key", F.pmod("key", F.lit(BUCKETS)).alias("bucket"))
    return asked.join(found, "seq", "left").select("seq", "key", "bucket", F.col("chain_index").isNotNull().alias("found"), "chain_index")


def bucket_display(log: DataFrame) -> DataFrame:
    """bucket, chain_index, key, value of what is there at the end; empty buckets give no row."""
    alive = lives(marked(log)).where("stop IS NULL")
    values = log.where("op = 'put'").groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    bucket = F.pmod("key", F.lit(BUCKETS)).alias("bucket")
    order = Window.partitionBy("bucket").orderBy("start")
    return alive.join(values, "key").select("key", "value", "start", bucket).select("bucket", (F.row_number().over(order) - 1).cast("long").alias("chain_index"), "key", "value")


def cuckoo_place(keys: DataFrame) -> DataFrame:
    """seq, key, slot, status of each put of (seq, key): the first key of a residue takes its first
    slot, the second its other one, a third would cycle; 0 is invalid, repeats are rejected."""
    first = keys.groupBy("key").agg(F.min("seq").alias("first"))
    order = Window.partitionBy("residue").orderBy("first")
    placed = first.where("key <> 0").withColumn("residue", F.pmod("key", F.lit(HALF))).withColumn("n", F.row_number().over(order))
    slot = F.when(F.col("n") == 1, F.col("residue")).when(F.col("n") == 2, F.col("residue") + HALF)
    found = keys.join(placed.select("key", "first", "n", slot.alias("slot")), "key", "left")
    # A key that wasn't placed is no duplicate the next time.
    status = F.when(F.col("key") == 0, "invalid").when(F.col("n") > 2, "cycle").when(F.col("seq") == F.col("first"), "placed").otherwise("duplicate")
    return found.select("seq", "key", F.when(status == "placed", F.col("slot")).alias("slot"), status.alias("status"))


_LIVES = f"""{OPLOG_SQL}, p AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'get' THEN op END IGNORE NULLS) OVER b, 'del') AS was FROM oplog WINDOW b AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lives AS (SELECT a.key, a.seq AS start, min(b.seq) AS stop FROM p a LEFT JOIN p b ON b.key = a.key AND b.op = 'del' AND b.seq > a.seq WHERE a.op = 'put' AND a.was = 'del' GROUP BY 1, 2)"""


@query(f"""WITH {_LIVES}, own AS (SELECT g.seq, g.key, l.start FROM oplog g LEFT JOIN lives l ON l.key = g.key AND l.start < g.seq AND (l.stop IS NULL OR l.stop > g.seq) WHERE g.op = 'get')
SELECT o.seq, o.key, o.key % {BUCKETS} AS bucket, o.start IS NOT NULL AS found, CASE WHEN o.start IS NOT NULL THEN (SELECT count(*) FROM lives l WHERE l.key % {BUCKETS} = o.key % {BUCKETS} AND l.start < o.start AND (l.stop IS NULL OR l.stop > o.seq)) END AS chain_index FROM own o""")
def hash_bucket_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_search(oplog(spark, sf_dir))


@query(f"""WITH {_LIVES}, v AS (SELECT key, arg_max(value, seq) AS value FROM oplog WHERE op = 'put' GROUP BY key)
SELECT key % {BUCKETS} AS bucket, row_number() OVER (PARTITION BY key % {BUCKETS} ORDER BY start) - 1 AS chain_index, key, value FROM lives JOIN v USING (key) WHERE stop IS NULL""")
def hash_bucket_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_display(oplog(spark, sf_dir))


@query(f"""WITH k AS (SELECT event_id AS seq, user_id * 2503 AS key FROM events), f AS (SELECT key, min(seq) AS first FROM k GROUP BY key),
n AS (SELECT *, row_number() OVER (PARTITION BY key % {HALF} ORDER BY first) AS n FROM f WHERE key <> 0)
SELECT seq, key, CASE WHEN seq = first AND n = 1 THEN key % {HALF} WHEN seq = first AND n = 2 THEN key % {HALF} + {HALF} END AS slot,
CASE WHEN key = 0 THEN 'invalid' WHEN n > 2 THEN 'cycle' WHEN seq = first THEN 'placed' ELSE 'duplicate' END AS status FROM k LEFT JOIN n USING (key)""")
def cuckoo_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return cuckoo_place(events.select(F.col("event_id").alias("seq"), (F.col("user_id") * 2503).alias("key")))
