"""Phase counters and positional comparison of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.keyvalue import op_results
from tidelog.plans.registry import query
from tidelog.sources.tables import OPLOG_SQL, oplog, table


def phases(results: DataFrame, size: int = 1000) -> DataFrame:
    """phase, ops, found and missed among the gets and deletes, per so many operations."""
    rows = results.withColumn("phase", F.floor(F.col("seq") / size))
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("ops"), F.count_if(F.col("found")).alias("found"), F.count_if(~F.col("found")).alias("missed"))


def first_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, line: the first place (from 0) where the lines of two texts (id, text) differ, blank
    lines left out; null where they don't."""

    def lines(df: DataFrame, name: str) -> DataFrame:
        cut = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
        return df.select("id", F.posexplode(cut).alias("line", name))

    met = lines(left, "a").join(lines(right, "b"), ["id", "line"], "full")
    found = met.where(~F.col("a").eqNullSafe(F.col("b"))).groupBy("id").agg(F.min("line").cast("long").alias("line"))
    return left.select("id").union(right.select("id")).distinct().join(found, "id", "left")


@query(f"""WITH {OPLOG_SQL}, p AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'get' THEN op END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'del') AS was FROM oplog)
SELECT seq // 1000 AS phase, count(*) AS ops, count(*) FILTER (WHERE op <> 'put' AND was = 'put') AS found, count(*) FILTER (WHERE op <> 'put' AND was <> 'put') AS missed FROM p GROUP BY 1""")
def phase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phases(op_results(oplog(spark, sf_dir)))


@query("""WITH l AS (SELECT doc_id // 2 AS id, doc_id % 2 AS side, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents),
e AS (SELECT id, side, unnest(lines) AS t, generate_subscripts(lines, 1) - 1 AS line FROM l),
f AS (SELECT coalesce(a.id, b.id) AS id, min(coalesce(a.line, b.line)) AS line FROM (SELECT * FROM e WHERE side = 0) a FULL JOIN (SELECT * FROM e WHERE side = 1) b ON a.id = b.id AND a.line = b.line WHERE a.t IS DISTINCT FROM b.t GROUP BY 1)
SELECT i.id, f.line::BIGINT AS line FROM (SELECT DISTINCT id FROM l) i LEFT JOIN f USING (id)""")
def line_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 2).alias("id"), (F.col("doc_id") % 2).alias("side"), "text")
    return first_difference(docs.where("side = 0").select("id", "text"), docs.where("side = 1").select("id", "text"))
