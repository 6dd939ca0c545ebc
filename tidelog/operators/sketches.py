"""Bloom filters as relations of set bits, one filter for each run of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashes import mix32, mix32_sql, murmur3, murmur3_sql
from tidelog.plans.registry import query
from tidelog.sources.tables import RUN_KEYS, RUNS_SQL, oplog, run_cut, table

#: Bits of a run's filter, which holds the RUN_KEYS keys of its range at most, and probes of a key.
BITS, PROBES = 80, 5
#: Bits of the filter of four Murmur3 words.
WIDE_BITS = 81_920


def probe_bits(keys: DataFrame, bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """keys (a column key) with a row for each probe's bit: of key, 2 * key, ... probes * key."""
    turns = keys.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(probes)))).withColumn("multiple", F.col("key") * F.col("turn"))
    return mix32(turns, "multiple", bits, "bit").drop("turn", "multiple")


def mixed_bits(keys: DataFrame, bits: int = BITS, probes: int = PROBES) -> DataFrame:
    """keys (a column key) with the same bits as an array."""
    names = [f"__bit{turn}" for turn in range(1, probes + 1)]
    for turn, name in enumerate(names, 1):
        keys = mix32(keys.withColumn("__multiple", F.col("key") * F.lit(turn)), "__multiple", bits, name)
    return keys.withColumn("bits", F.array(*names)).drop("__multiple", *names)


def wide_bits(keys: DataFrame) -> DataFrame:
    """keys (a column key) with the bits of a wide filter as an array: four Murmur3 words."""
    return keys.withColumn("bits", F.transform(murmur3("key"), lambda w: w % WIDE_BITS))


def run_filters(entries: DataFrame) -> DataFrame:
    """run, keys and ones (the set bits) of each run, from entries (run, key, bits): a row for each run,
    made behind one exchange of the entries' keys."""
    return entries.groupBy("run").agg(F.collect_set("key").alias("keys"), F.array_distinct(F.flatten(F.collect_list("bits"))).alias("ones"))


def gate_counts(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """run, hits, false_hits of the filters (run, keys, ones) that let a key pass: how many of the keys
    (key, bits, no key twice) in the run's ranges of RUN_KEYS keys pass, and how many of these the run
    doesn't hold. The keys of a range are one row, so that a run meets them without a row for each."""
    ranged = asked.groupBy(F.floor(F.col("key") / RUN_KEYS).alias("range")).agg(F.collect_list(F.struct("key", "bits")).alias("asked"))
    spread = runs.withColumn("range", F.explode(F.array_distinct(F.transform("keys", lambda k: F.floor(k / RUN_KEYS)))))
    passed = F.filter("asked", lambda a: F.forall(a["bits"], lambda b: F.array_contains(F.col("ones"), b)))
    met = spread.join(ranged, "range").select("run", "keys", passed.alias("passed"))
    counted = met.select("run", F.size("passed").alias("hits"), F.size(F.filter("passed", lambda a: ~F.array_contains(F.col("keys"), a["key"]))).alias("false_hits"))
    return counted.where("hits > 0").groupBy("run").agg(F.sum("hits").alias("hits"), F.sum("false_hits").alias("false_hits"))


def filters(entries: DataFrame, bits: int = BITS) -> DataFrame:
    """(run, bit): the set bits of each run's filter."""
    return run_filters(mixed_bits(entries, bits)).select("run", F.explode("ones").alias("bit"))


def hits(probes: DataFrame, filter_bits: DataFrame) -> DataFrame:
    """(run, key): the probes (run, key, bit), those that a run was asked for, whose bits are all set
    in the run's filter. Joined by run and bit, so that no bit gathers all probes."""
    own = probes.select("run", "key", "bit").distinct()
    met = own.join(filter_bits.withColumn("hit", F.lit(1)), ["run", "bit"], "left")
    return met.groupBy("run", "key").agg(F.count(F.lit(1)).alias("bits"), F.count("hit").alias("set")).where(F.col("set") == F.col("bits")).select("run", "key")


def stored(filter_bits: DataFrame, bits: int) -> DataFrame:
    """run, filter: each run's bits as a string of bits / 8 bytes, the lowest bit of a byte first, as
    it is kept beside the run."""
    ones = filter_bits.groupBy("run").agg(F.collect_set(F.col("bit").cast("int")).alias("ones"))
    byte = lambda k: F.aggregate(F.filter("ones", lambda b: F.floor(b / 8) == k), F.lit(0).cast("int"), lambda acc, b: acc + F.pow(F.lit(2), F.pmod(b, F.lit(8))).cast("int"))
    digits = F.transform(F.sequence(F.lit(0), F.lit(-(-bits // 8) - 1)), lambda k: F.lpad(F.hex(byte(k)), 2, "0"))
    return ones.select("run", F.unhex(F.array_join(digits, "")).alias("filter"))


def restored(filters_: DataFrame) -> DataFrame:
    """(run, bit) of stored filters."""
    places = filters_.select("run", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("filter")), lambda k: F.conv(F.hex(F.substring("filter", k, F.lit(1))), 16, 10).cast("int"))).alias("at", "byte"))
    return places.select("run", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.when(F.getbit("byte", b) == 1, F.col("at") * 8 + b)), lambda x: x.isNotNull())).alias("bit")).select("run", F.col("bit").cast("long").alias("bit"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, key): the keys that each run of the log holds, those of a run in one partition."""
    return run_cut(oplog(spark, sf_dir)).select(F.col("run_id").alias("run"), "key").repartition("run").distinct()


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's key: the runs whose range of keys has it are asked for it."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).distinct()


_ASKED_SQL = f"""{RUNS_SQL}, r AS (SELECT run_id AS run, key FROM entries),
a AS (SELECT DISTINCT run, c_custkey AS key FROM customer JOIN r ON c_custkey // {RUN_KEYS} = r.key // {RUN_KEYS})"""
_BITS_SQL = f"""{_ASKED_SQL}, f AS (SELECT DISTINCT run, bit FROM {mix32_sql(f"(SELECT run, key * unnest(range(1, {PROBES + 1})) AS m FROM r)", "m", BITS, "bit")}),
p AS (SELECT DISTINCT run, key, bit FROM {mix32_sql(f"(SELECT run, key, key * unnest(range(1, {PROBES + 1})) AS m FROM a)", "m", BITS, "bit")}),
h AS (SELECT run, key FROM p LEFT JOIN f USING (run, bit) GROUP BY run, key HAVING count(f.bit) = count(*))"""
_FOUND_SQL = "SELECT run, count(*) AS hits, count(*) FILTER (WHERE (run, key) NOT IN (SELECT (run, key) FROM r)) AS false_hits FROM h GROUP BY 1"


@query(f"WITH {_BITS_SQL} SELECT run, count(*) AS bits_set FROM f GROUP BY 1")
def bloom_bits_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters(_entries(spark, sf_dir)).groupBy("run").agg(F.count(F.lit(1)).alias("bits_set"))


@query(f"WITH {_BITS_SQL} {_FOUND_SQL}")
def bloom_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate_counts(run_filters(mixed_bits(_entries(spark, sf_dir))), mixed_bits(_asked(spark, sf_dir)))


@query(f"""WITH {_BITS_SQL}, b AS (SELECT run, bit // 8 AS place, sum(1 << (bit % 8)::INT) AS byte FROM f GROUP BY 1, 2),
g AS (SELECT run, place, coalesce(byte, 0)::BIGINT AS byte FROM (SELECT DISTINCT run, unnest(range(0, {-(-BITS // 8)})) AS place FROM f) LEFT JOIN b USING (run, place))
SELECT run, string_agg(printf('%02X', byte), '' ORDER BY place) AS filter FROM g GROUP BY 1""")
def bloom_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters as they are stored, in hexadecimal digits."""
    return stored(filters(_entries(spark, sf_dir)), BITS).select("run", F.hex("filter").alias("filter"))


@query(f"""WITH {_ASKED_SQL}, f AS (SELECT DISTINCT run, bit FROM {murmur3_sql("r", "key", WIDE_BITS)}), p AS (SELECT DISTINCT run, key, bit FROM {murmur3_sql("a", "key", WIDE_BITS)}),
h AS (SELECT run, key FROM p LEFT JOIN f USING (run, bit) GROUP BY run, key HAVING count(f.bit) = count(*)) {_FOUND_SQL}""")
def bloom_run_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of the runs' wide filters: per run how many of the keys that it is asked for pass, and
    how many of these it doesn't hold."""
    return gate_counts(run_filters(wide_bits(_entries(spark, sf_dir))), wide_bits(_asked(spark, sf_dir)))


@query(f"SELECT c_custkey AS key, word, bit AS value FROM {murmur3_sql('customer', 'c_custkey', 1 << 32)}")
def murmur3_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four words of each customer's key."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("key"))
    return keys.select("key", F.posexplode(murmur3("key")).alias("word", "value")).select("key", F.col("word").cast("long").alias("word"), "value")
