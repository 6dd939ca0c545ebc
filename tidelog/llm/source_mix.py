"""Mixing sources to target weights.

Every document gets a hash-random key; rows are range-sorted by source and key, so that a
source of any size spreads over as many partitions as its rows need. Prefix sums of the word
counts are distributed: a running sum inside each sorted partition, and the sums of the
partitions before it. Each source is then cut at its exact budget: whole passes over the source
first, then the documents before the cut once more, the document at the cut in part.

Defined results for unusual input: a null or empty text has size 0 and nothing is taken of it;
a null source is a source of its own and comes last; repeated rows and repeated ids are rows of
their own, ordered by key, id and the text's digest (rows equal in all of these are
interchangeable, as are their results); an empty table gives an empty table; columns of any name
may be carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import space_words, written

#: Weights by the rank of the source, repeating.
WEIGHTS = (3, 1, 2)
#: Per cent of all words that the mix has.
SHARE = 150
#: No target is above so many times its source's size.
MOST = 2
SEED = "mix"


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """The same key in each rerun, from the id alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target: one row for each source.

    A source whose share by weight is above its cap gets the cap and the rest is shared among
    the others. In ascending order of cap over weight the capped sources come first, so running
    sums tell which they are. The windows hold one aggregated row for each source.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    rank = ((F.row_number().over(by_name) - 1) % len(weights)).cast("int")
    weighed = sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), rank).cast("long")).withColumn("cap", most * F.col("source_size"))
    left = (
        weighed.withColumn("all", F.sum("source_size").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("capped", F.col("weight") * (share * F.col("all") - 100 * F.col("cap_before")) > 100 * F.col("cap") * F.col("weight_left"))
    )
    rest = (share * F.col("all")).cast("double") / 100 - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every).cast("double")
    open_weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every).cast("double")
    return left.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * rest / open_weight).alias("target"),
    )


def _running(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the partition and the sum of the sizes before each row in its source and partition."""
    part, last, carried = TaskContext.get().partitionId(), object(), 0
    for rows in batches:
        if not len(rows):
            continue
        source = rows["source"].where(rows["source"].notna(), None).to_numpy(dtype=object)
        sizes = rows["size"].to_numpy(dtype=np.int64)
        before = np.cumsum(sizes) - sizes
        first = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        base = np.repeat(before[first], np.diff(np.append(first, len(rows))))
        before = before - base
        if source[0] == last or (source[0] is None and last is None):
            before[: first[1] if len(first) > 1 else len(rows)] += carried
        last, carried = source[-1], int(before[-1] + sizes[-1])
        yield rows.assign(part=part, before=before)


def mix(docs: DataFrame, carry: list[str], weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """row (a struct of the carried columns), size, source_size, target, taken."""
    sized = docs.select(
        F.col("source").cast("string").alias("source"),
        F.size(space_words(F.col("text"))).cast("long").alias("size"),
        random_key(F.col("doc_id"), seed).alias("key"),
        F.col("doc_id").alias("id"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("digest"),
        F.struct(*carry).alias("row"),
    )
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("id"), F.col("digest")]
    ordered = sized.repartitionByRange(*order).sortWithinPartitions(*order).drop("key", "id", "digest")
    schema = T.StructType([*ordered.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])
    # Written, as a second run of the range partitioning may cut elsewhere.
    runs = written(ordered.mapInPandas(_running, schema), "mix-runs")
    parts = runs.groupBy("source", "part").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("source", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    targets = source_targets(runs, weights, share, most)
    found = offsets.alias("o").join(targets.alias("t"), F.expr("o.source <=> t.source")).select("o.source", "o.part", "o.offset", "t.source_size", "t.target")
    budget = F.floor("target")
    rest = budget % F.greatest(F.col("source_size"), F.lit(1))
    taken = F.floor(budget / F.greatest(F.col("source_size"), F.lit(1))) * F.col("size") + F.greatest(
        F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("offset"))
    )
    return (
        runs.alias("r")
        .join(found.alias("f"), F.expr("r.part = f.part AND r.source <=> f.source"))
        .select("r.row", "r.size", "f.source_size", "f.target", taken.cast("long").alias("taken"))
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a document stands as often as it is taken, the
    last time cut to the words that are taken."""
    found = mix(docs, docs.columns)
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)))
    left = F.col("taken") - copies * F.col("size")
    cuts = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), copies.cast("int")),
        F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<bigint>")),
    )
    cut = F.array_join(F.slice(space_words(F.col("row.text")), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(cut)
    rows = found.where("taken > 0").select("row", F.explode(cuts).alias("words")).withColumn("text", text)
    kept = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kept["n_chars"] = F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*(kept.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op8_source_mix(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mix(docs, ["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS key, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight, {MOST} * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER ())::BIGINT AS every, coalesce(sum(cap) OVER b, 0)::BIGINT AS cap_before,
    ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0))::BIGINT AS weight_left
    FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * ({SHARE} * every - 100 * cap_before) > 100 * cap * weight_left AS capped FROM l),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight::DOUBLE
    * (({SHARE} * every)::DOUBLE / 100 - (sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())::DOUBLE)
    / (sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM c),
p AS (SELECT d.*, source_size, target, floor(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, digest
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (budget // greatest(source_size, 1) * size
    + greatest(0, least(size, budget % greatest(source_size, 1) - before)))::BIGINT AS taken FROM p"""
