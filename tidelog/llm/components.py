"""Connected groups of similar nodes, by joins alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, written

#: Nodes of one pivot that are compared at once with as many others.
BLOCK = 2048
#: Gives the pairs to verify of a group's rows; whether only pairs across its two blocks are wanted.
Compare = Callable[[pa.Table, bool], Iterator[tuple[np.ndarray, np.ndarray]]]


def connected(links: DataFrame) -> DataFrame:
    """node, label: each node of links (a, b) with the smallest node that it reaches.

    Each round takes the smallest label among the neighbours and then the label of the label, so
    that chains shorten by half; labels are written between rounds, and a round that changes
    nothing ends the loop. A node with many links is aggregated before the shuffle.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    last = labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        best = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(best, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = near.select(F.col("node").alias("j"), F.col("label").alias("to"))
        step = near.join(jump, F.col("label") == F.col("j")).select("node", "old", F.col("to").alias("label"))
        step = written(step, "labels")
        discard(last)
        last, labels = step, step.select("node", "label")
        if step.where("old <> label").isEmpty():
            discard(edges)
            return labels


def in_rounds(df: DataFrame, keys: list[str], rounds: int, step: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The written result of step over so many parts of df by the keys' hash, one after the other: the
    shuffle of a part is deleted before the next begins."""
    parts = [df] if rounds == 1 else [df.where(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == k) for k in range(rounds)]
    return reduce(DataFrame.union, [written(step(part), name) for part in parts])


def near_misses(met: DataFrame, facts: DataFrame, labels: DataFrame, compare: Compare, block: int = BLOCK, rounds: Callable[[int], int] | None = None) -> DataFrame:
    """The pairs (a, b) that compare gives of nodes with a pivot in common and different labels.

    met has (pivot, node), each pair of which has been verified, facts a row for each node. Only pivots whose nodes have several labels
    are looked at; their nodes meet in blocks, each block with itself and each other, so that a task
    holds two blocks at once, whatever the number of a pivot's nodes. No row is made for a pair that
    compare drops. rounds gives the rounds in which so many rows meet their facts.
    """
    labelled = met.select("pivot", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_ = labelled.groupBy("pivot").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("many")).where("lo < hi")
    placed = labelled.join(open_.select("pivot", F.ceil(F.col("many") / block).alias("blocks")), "pivot").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = dealt.select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node", "label", "block")

    def close(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(rows)
        found = list(compare(group, group["low"][0].as_py() != group["high"][0].as_py()))
        if found:
            a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("pivot", "low", "high")], axis=1)
            new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist()
            for a, b in zip(new, [*new[1:], len(keys)], strict=True):
                key = tuple(keys[a].tolist())
                if rows and now != key:
                    yield from close(rows)
                    rows = []
                now = key
                rows.append(batch.slice(a, b - a))
        if rows:
            yield from close(rows)

    def compared(rows: DataFrame) -> DataFrame:
        sorted_ = rows.join(facts, "node").repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high")
        return sorted_.mapInArrow(run, "a bigint, b bigint").distinct()

    if rounds is None:
        return compared(keyed)
    keyed = written(keyed, "dealt")
    found = in_rounds(keyed, ["pivot", "low", "high"], rounds(keyed.count()), compared, "near-misses")
    discard(keyed)
    return found.distinct()
