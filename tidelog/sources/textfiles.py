"""Readers of the three text formats: operation scripts, dense matrices with tours, sparse graphs.

A file is one ordered script, so it is read whole; many files are read side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    """file, tokens of each text file."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return whole.select("file", F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("tokens"))


def operations(spark: SparkSession, path: str) -> DataFrame:
    """struct_id (the file), seq, op, key, value of scripts of Op(key) and Op(key,value)."""
    rows = _tokens(spark, path).select(F.col("file").alias("struct_id"), F.posexplode("tokens").alias("seq", "token"))
    part = lambda k: F.regexp_extract("token", r"^(\w+)\((-?\d+)(?:,(-?\d+))?\)$", k)
    return rows.select("struct_id", F.col("seq").cast("long").alias("seq"), part(1).alias("op"), _whole(part(2)).alias("key"), _whole(part(3)).alias("value"))


def _whole(text: Column) -> Column:
    return F.when(text != "", text).cast("int")


def as_log(script: DataFrame) -> DataFrame:
    """A script as the key-value log: seq, key, op, value; a structure's keys are kept apart by the
    caller's filter on struct_id."""
    op = F.when(F.col("op") == "Insert", "put").when(F.col("op") == "Delete", "del").otherwise("get")
    return script.select("struct_id", "seq", F.col("key").cast("long").alias("key"), op.alias("op"), F.col("value").cast("string").alias("value"))


def matrix(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Edges (file, src, dst, w) without the diagonal and missing ones ('@'), and tour queries
    (file, query_id, source, mids)."""
    files = _tokens(spark, path).withColumn("n", F.get("tokens", F.lit(0)).cast("int"))
    cells = files.select("file", "n", F.posexplode(F.slice("tokens", F.lit(2), F.col("n") * F.col("n"))).alias("at", "w"))
    edges = cells.select("file", F.floor(F.col("at") / F.col("n")).cast("int").alias("src"), (F.col("at") % F.col("n")).alias("dst"), "w")
    edges = edges.where("src <> dst AND w <> '@'").select("file", "src", "dst", F.col("w").cast("int").alias("w"))
    rest = F.array_join(F.slice("tokens", F.col("n") * F.col("n") + 2, F.size("tokens")), " ")
    asked = files.select("file", F.posexplode(F.filter(F.split(rest, r"\$"), lambda x: F.trim(x) != "")).alias("query_id", "stops"))
    stops = asked.select("file", "query_id", F.transform(F.split(F.trim("stops"), " "), lambda x: x.cast("int")).alias("stops"))
    return edges, stops.select("file", "query_id", F.get("stops", F.lit(0)).alias("source"), F.slice("stops", F.lit(2), F.size("stops")).alias("mids"))


def sparse_graph(spark: SparkSession, path: str, edge_limit: bool = True) -> DataFrame:
    """file, pos, u, v, w of 'n m' and lines 'u v w'; only the first m of them with edge_limit."""
    files = _tokens(spark, path).withColumn("m", F.get("tokens", F.lit(1)).cast("int"))
    cells = files.select("file", "m", F.posexplode(F.slice("tokens", F.lit(3), F.size("tokens"))).alias("at", "x"))
    rows = cells.groupBy("file", "m", F.floor(F.col("at") / 3).alias("pos")).agg(*(F.max(F.when(F.col("at") % 3 == k, F.col("x").cast("int"))).alias(c) for k, c in enumerate("uvw")))
    return rows.where(F.col("pos") < F.col("m") if edge_limit else F.lit(True)).select("file", "pos", "u", "v", "w")
