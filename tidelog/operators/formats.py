"""The text formats and the store, written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.graphs import NO_TOUR, TOURS_SQL, region_tours, tours, trades
from tidelog.operators.keyvalue import snapshot
from tidelog.plans.registry import query
from tidelog.sources import store, textfiles
from tidelog.sources.scratch import scratch_path
from tidelog.sources.tables import EDGES_SQL, OPLOG_SQL, both_ways, nation_edges, oplog, table


def _path(spark: SparkSession, name: str) -> str:
    return f"{scratch_path(spark)}/{name}-{uuid.uuid4().hex}"


def write_script(log: DataFrame, path: str) -> None:
    """Operations (seq, key, op, value; whole numbers) as scripts, a file for each range of seq."""
    name = F.when(F.col("op") == "put", "Insert").when(F.col("op") == "del", "Delete").otherwise("Search")
    line = F.concat(name, F.lit("("), F.col("key"), F.when(F.col("op") == "put", F.concat(F.lit(","), F.col("value"))).otherwise(F.lit("")), F.lit(")"))
    log.repartitionByRange("seq").sortWithinPartitions("seq").select(line.alias("value")).write.text(path)


def write_sparse_graph(edges: DataFrame, vertices: int, path: str) -> None:
    """Edges (u, v, w) of one graph as one file: it is read whole, so it has to be small."""
    size = edges.count()
    head = edges.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), F.lit(f"{vertices} {size}").alias("value"))
    rows = edges.select(F.lit(1).alias("part"), "u", "v", F.concat_ws(" ", "u", "v", "w").alias("value"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("part", "u", "v").select("value").write.text(path)


def write_matrix(arcs: DataFrame, asked: DataFrame, vertices: int, path: str) -> None:
    """Arcs (src, dst, w) of one graph and tour queries (query_id, source, mids) as one file."""
    row = arcs.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("dst", "w"))).alias("to"))
    every = arcs.sparkSession.range(vertices).select(F.col("id").alias("src")).join(row, "src", "left")
    cell = lambda k: F.coalesce(F.get(F.array(F.col("to")[k.cast("long")]), F.lit(0)).cast("string"), F.lit("@"))
    lines = every.select(F.lit(1).alias("part"), F.col("src").alias("at"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), cell), " ").alias("value"))
    stops = asked.select(F.lit(2).alias("part"), F.col("query_id").cast("long").alias("at"), F.concat_ws(" ", F.col("source").cast("string"), F.transform("mids", lambda x: x.cast("string")), F.lit("$")).alias("value"))
    head = arcs.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit(str(vertices)).alias("value"))
    head.unionByName(lines).unionByName(stops).coalesce(1).sortWithinPartitions("part", "at").select("value").write.text(path)


@query(f"""WITH {OPLOG_SQL} SELECT CASE op WHEN 'put' THEN 'Insert' WHEN 'del' THEN 'Delete' ELSE 'Search' END AS op, key::INT AS key, count(*) AS times,
sum(CASE WHEN op = 'put' THEN seq % 1000 END)::BIGINT AS total FROM oplog GROUP BY 1, 2""")
def script_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as scripts, read back: how often each operation names each key."""
    path = _path(spark, "script")
    write_script(oplog(spark, sf_dir).withColumn("value", F.col("seq") % 1000), path)
    return textfiles.operations(spark, path).groupBy("op", "key").agg(F.count(F.lit(1)).alias("times"), F.sum("value").alias("total"))


@query(f"WITH {EDGES_SQL} SELECT u::INT AS u, v::INT AS v, w::INT AS w FROM edges")
def sparse_graph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of trades as a text file, read back."""
    path = _path(spark, "graph")
    write_sparse_graph(nation_edges(spark, sf_dir), table(spark, sf_dir, "nation").count(), path)
    return textfiles.sparse_graph(spark, path).select("u", "v", "w")


@query(f"WITH {TOURS_SQL} SELECT coalesce(min(length), {NO_TOUR})::BIGINT AS length FROM t GROUP BY query_id")
def matrix_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut graph and the regions' tours as a matrix file, read back and solved."""
    path = _path(spark, "matrix")
    asked = region_tours(spark, sf_dir)
    write_matrix(both_ways(trades(spark, sf_dir)), asked, table(spark, sf_dir, "nation").count(), path)
    edges, queries = textfiles.matrix(spark, path)
    arcs = edges.select(*(F.col(c).cast("long").alias(c) for c in ("src", "dst", "w")))
    read = queries.select("query_id", F.col("source").cast("long").alias("source"), F.col("mids").cast("array<bigint>").alias("mids"))
    return tours(arcs, read).select("length")


@query(f"WITH {OPLOG_SQL} SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM oplog WHERE op <> 'get' GROUP BY key HAVING arg_max(op, seq) = 'put'")
def store_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log appended to a store in two parts, compacted, and read back."""
    root, log = _path(spark, "store"), oplog(spark, sf_dir).where("op <> 'get'")
    middle = F.col("seq") % 2 == 0
    store.append(log.where(middle), root)
    store.append(log.where(~middle), root)
    store.compact(spark, root, f"{root}-compacted", 1)
    return snapshot(store.reopen(spark, f"{root}-compacted"))
