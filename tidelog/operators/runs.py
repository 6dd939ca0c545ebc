"""Sorted runs: metadata, overlap, compaction victims, merge and pruned probes.

Runs are the log's mutations cut by time and key range. Interval questions are answered by
equality on buckets of the key range, so that no join compares all runs with all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.plans.registry import query
from tidelog.sources.scratch import checkpointed
from tidelog.sources.tables import RUN_KEYS, RUNS_SQL, oplog, run_entries, table

#: Bytes that an entry takes besides its value, and that a written run may hold.
ENTRY_BYTES, RUN_BYTES = 12, 512


def metadata(entries: DataFrame) -> DataFrame:
    """One row for each run: counts, key range, the last value's length, bytes and file name."""
    rows = entries.groupBy("run_id", "ts", "level").agg(
        F.count(F.lit(1)).alias("entries"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count_if(F.col("op") == "del").alias("deletes"),
        F.length(F.max_by("value", "key")).cast("long").alias("end_length"), F.sum(ENTRY_BYTES + F.coalesce(F.length("value"), F.lit(0))).cast("long").alias("bytes"),
    )
    return rows.withColumn("file_name", F.concat(F.lit("f"), F.concat_ws("-", "ts", "entries", "min_key", "max_key"), F.lit(".sst")))


def _bucketed(runs: DataFrame, width: int) -> DataFrame:
    return runs.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("min_key") / width), F.floor(F.col("max_key") / width))))


def overlaps(runs: DataFrame, width: int = RUN_KEYS) -> DataFrame:
    """(run_id, next_run_id): runs and those of the next level whose key ranges meet theirs."""
    a, b = _bucketed(runs, width).alias("a"), _bucketed(runs, width).alias("b")
    met = a.join(b, F.expr("a.bucket = b.bucket AND b.level = a.level + 1 AND a.min_key <= b.max_key AND b.min_key <= a.max_key"))
    return met.select("a.run_id", F.col("b.run_id").alias("next_run_id")).distinct()


def overflow(runs: DataFrame) -> DataFrame:
    """level, runs, most (2 to the level + 1) and how many runs there are above it."""
    counts = runs.groupBy("level").agg(F.count(F.lit(1)).alias("runs"))
    most = F.expr("shiftleft(2L, cast(level AS int))")
    return counts.select("level", "runs", most.alias("most"), F.greatest(F.col("runs") - most, F.lit(0)).alias("excess"))


def victims(runs: DataFrame) -> DataFrame:
    """The runs to compact: all of level 0, elsewhere the oldest (then lowest) above the limit."""
    order = Window.partitionBy("level").orderBy("ts", "min_key")
    ranked = runs.withColumn("rank", F.row_number().over(order)).join(overflow(runs).select("level", "excess"), "level")
    return ranked.where("level = 0 AND excess > 0 OR level > 0 AND rank <= excess").select("run_id", "level", "ts", "min_key", "max_key")


def merged(entries: DataFrame) -> DataFrame:
    """Entries of many runs as one: the newest of each key; deletions stay."""
    newest = entries.groupBy("key").agg(F.max(F.struct("ts", "seq", "op", "value")).alias("n"))
    return newest.select("key", "n.op", "n.value", "n.ts")


def envelopes(runs: DataFrame) -> DataFrame:
    """level, first and last key of all victims of a level together."""
    return victims(runs).groupBy("level").agg(F.min("min_key").alias("first_key"), F.max("max_key").alias("last_key"))


def inputs(runs: DataFrame, level: int) -> DataFrame:
    """run_id of a level's victims and of the next level's runs that meet their joint range."""
    joint = envelopes(runs).where(F.col("level") == level)  # one row
    below = runs.where(F.col("level") == level + 1).join(F.broadcast(joint.drop("level")), F.expr("min_key <= last_key AND first_key <= max_key"))
    return victims(runs).where(F.col("level") == level).select("run_id").union(below.select("run_id"))


def compacted(entries: DataFrame, level: int) -> DataFrame:
    """Victims of a level and what they meet in the next one, merged."""
    return merged(entries.join(inputs(metadata(entries), level), "run_id", "left_semi"))


def cascaded(entries: DataFrame, budget: int = RUN_BYTES) -> DataFrame:
    """The entries after compacting level by level until no level has too many runs: what a level has
    too many of is merged into the next one, as files cut by running bytes that share the newest
    time of their inputs. A loop of as many rounds as there are levels."""
    level, entries = 0, checkpointed(entries)
    while True:
        runs = checkpointed(metadata(entries))
        top = runs.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0]
        if level > top:
            return entries
        mine = checkpointed(inputs(runs, level))
        if not mine.isEmpty():
            taken = entries.join(mine, "run_id", "left_semi")
            newest = taken.agg(F.max("ts")).first()[0]
            whole = taken.groupBy("key").agg(F.max(F.struct("ts", "seq", "op", "value")).alias("n")).select("key", "n.seq", "n.op", "n.value")
            out = placed(whole, budget).withColumn("run_id", F.shiftleft(F.lit(level + 1).cast("long"), 40) + F.col("file"))
            out = out.select("run_id", F.lit(newest).cast("long").alias("ts"), F.lit(level + 1).cast("long").alias("level"), "key", "op", "value", "seq")
            kept = entries.join(mine, "run_id", "left_anti").select(*out.columns)
            entries = checkpointed(kept.unionByName(out))
        level += 1


def placed(entries: DataFrame, budget: int) -> DataFrame:
    """entries and the output file of each, cut by running bytes.

    The sum runs inside each run's key range and over the ranges' totals, never over all rows.
    """
    sized = entries.withColumn("range", F.floor(F.col("key") / RUN_KEYS)).withColumn("size", (ENTRY_BYTES + F.coalesce(F.length("value"), F.lit(0))).cast("long"))
    inside = Window.partitionBy("range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("range").agg(F.sum("size").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    found = sized.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, "range")
    return found.withColumn("file", F.floor((F.col("at") + F.col("offset")) / budget)).drop("range", "at", "offset")


def split(entries: DataFrame, budget: int = RUN_BYTES) -> DataFrame:
    """file, first and last key, entries and bytes of output files cut by running bytes."""
    return placed(entries, budget).groupBy("file").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"), F.sum("size").alias("bytes"))


def probed(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """key, gated (runs whose key range has it), found (runs that hold it)."""
    runs = _bucketed(metadata(entries), RUN_KEYS)
    asked = probes.withColumn("bucket", F.floor(F.col("key") / RUN_KEYS))
    gated = asked.join(runs, "bucket").where("key BETWEEN min_key AND max_key").groupBy("key").agg(F.count(F.lit(1)).alias("gated"))
    found = entries.join(probes, "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("found"))
    return probes.join(gated, "key", "left").join(found, "key", "left").select("key", F.coalesce("gated", F.lit(0)).alias("gated"), F.coalesce("found", F.lit(0)).alias("found"))


_META = f"""{RUNS_SQL}, meta AS (SELECT run_id, ts, level, count(*) AS entries, min(key) AS min_key, max(key) AS max_key, count(*) FILTER (WHERE op = 'del') AS deletes,
length(arg_max(value, key))::BIGINT AS end_length, sum({ENTRY_BYTES} + coalesce(length(value), 0))::BIGINT AS bytes FROM entries GROUP BY 1, 2, 3),
caps AS (SELECT level, count(*) AS runs, (2 ** (level + 1))::BIGINT AS most FROM meta GROUP BY level),
vict AS (SELECT m.* FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY ts, min_key) AS r FROM meta) m JOIN caps USING (level) WHERE level = 0 AND runs > most OR level > 0 AND r <= runs - most)"""


@query(f"WITH {_META} SELECT *, 'f' || ts || '-' || entries || '-' || min_key || '-' || max_key || '.sst' AS file_name FROM meta")
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(run_entries(oplog(spark, sf_dir)))


@query(f"WITH {_META} SELECT a.run_id, b.run_id AS next_run_id FROM meta a JOIN meta b ON b.level = a.level + 1 AND a.min_key <= b.max_key AND b.min_key <= a.max_key")
def run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(metadata(run_entries(oplog(spark, sf_dir))))


@query(f"WITH {_META} SELECT level, runs, most, greatest(runs - most, 0) AS excess FROM caps")
def level_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overflow(metadata(run_entries(oplog(spark, sf_dir))))


@query(f"WITH {_META} SELECT run_id, level, ts, min_key, max_key FROM vict")
def compaction_victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return victims(metadata(run_entries(oplog(spark, sf_dir))))


@query(f"WITH {_META} SELECT level, min(min_key) AS first_key, max(max_key) AS last_key FROM vict GROUP BY level")
def compaction_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(metadata(run_entries(oplog(spark, sf_dir))))


@query()
def compaction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that are left once no level has too many."""
    return metadata(cascaded(run_entries(oplog(spark, sf_dir))))


@query(f"""WITH {_META}, joint AS (SELECT min(min_key) AS lo, max(max_key) AS hi FROM vict WHERE level = 0),
mine AS (SELECT run_id FROM vict WHERE level = 0 UNION SELECT run_id FROM meta, joint WHERE level = 1 AND min_key <= hi AND lo <= max_key)
SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(ts) AS ts FROM entries WHERE run_id IN (SELECT run_id FROM mine) GROUP BY key""")
def compaction_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted(run_entries(oplog(spark, sf_dir)), 0)


@query(f"""WITH {RUNS_SQL}, m AS (SELECT key, {ENTRY_BYTES} + coalesce(length(arg_max(value, seq)), 0) AS size FROM entries GROUP BY key),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM m)
SELECT pos // {RUN_BYTES} AS file, min(key) AS first_key, max(key) AS last_key, count(*) AS entries, sum(size)::BIGINT AS bytes FROM p GROUP BY 1""")
def run_split_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(merged(run_entries(oplog(spark, sf_dir))))


@query(f"""WITH {_META} SELECT c_custkey AS key, (SELECT count(*) FROM meta WHERE c_custkey BETWEEN min_key AND max_key) AS gated, (SELECT count(*) FROM entries WHERE key = c_custkey) AS found FROM customer""")
def run_probe_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probed(run_entries(oplog(spark, sf_dir)), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")))


@query(f"WITH {RUNS_SQL} SELECT key, arg_max(op, seq) AS op, arg_max(value, seq) AS value, max(ts) AS ts FROM entries GROUP BY key")
def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(run_entries(oplog(spark, sf_dir)))


@query(f"WITH {_META} SELECT level, run_id, bytes, rank FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY bytes DESC, run_id) AS rank FROM meta) WHERE rank <= 3")
def topk_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("level").orderBy(F.col("bytes").desc(), "run_id")
    return metadata(run_entries(oplog(spark, sf_dir))).withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("level", "run_id", "bytes", F.col("rank").cast("long").alias("rank"))
