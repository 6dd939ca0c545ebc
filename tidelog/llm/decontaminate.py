"""Benchmark decontamination: size-partitioned MinHash containment search.

A set holds the distinct shingles (alphanumeric words, A-Z lower-cased) of a text as hashes. Items are
partitioned by set size; in a partition whose sizes stay below u, an item's MinHash sketch is its
floor((1 - t) * u) + 1 smallest hashes. A document with at least the part t of an item's shingles
lacks fewer than that, so it has one of the sketch: whatever a document's length, none is missed
(recall 1). Documents look up their hashes among the sketches alone; the items they meet there are
the candidates, and only candidates are verified by exact containment:
100 * shared >= PER_CENT * size.

The items are small beside the corpus; up to INDEX_LIMIT shingles they are broadcast and each
document is searched where it stands, without a shuffle. A larger benchmark goes through joins with
the sketches, and the candidates' texts and items through joins by key, with the same result.

Defined results for unusual input: null, empty or blank texts and items contain nothing and are
contained in nothing; a text or item of fewer than five words has its whole sequence as its one
shingle, so such an item is found only in a document of just these words; a hit row stands for
each repeated row of a document; items with equal ids are told apart only by their shingles; ids may be
null on either side; an empty table on either side gives no hits; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import ASCII_LOWER, ASCII_UPPER, free_name, written
from tidelog.llm.shingles import NOT_ALPHANUMERIC, shingle_runs, shingle_set

WIDTH = 5
PER_CENT = 75
#: Shingles of all items up to which they are broadcast: eight bytes each, so 40 MB at most, and 20 MB of sketches.
INDEX_LIMIT = 5_000_000
#: Items of sizes in [b^k, b^(k + 1)) make a partition.
SIZE_BASE = 1.25
HITS = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint"
_U = np.uint64


def sketch_size(n: int, per_cent: int = PER_CENT) -> int:
    """Smallest hashes that stand for an item of n shingles: by its partition's largest size."""
    top = n
    while int(np.log(top + 1) / np.log(SIZE_BASE)) == int(np.log(n) / np.log(SIZE_BASE)):
        top += 1
    return min(n, (100 - per_cent) * top // 100 + 1)


def item_sets(benchmark: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """The written (item, item_id, n_item, elements, sketch): a row for each item with a word; item is
    the set's hash, elements are sorted, and the first of them, sketch, is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, NOT_ALPHANUMERIC) for t in batch.column(1)]
            keep = [k for k, x in enumerate(sets) if len(x)]
            items = [int(np.bitwise_xor.reduce(sets[k]).view(np.int64)) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.int64()), batch.column(0).take(pa.array(keep, pa.int64())), pa.array([len(sets[k]) for k in keep], pa.int64()), pa.array([sets[k].tobytes() for k in keep], pa.binary()), pa.array([sketch_size(len(sets[k]), per_cent) for k in keep], pa.int64())],
                names=["item", "item_id", "n_item", "elements", "sketch"],
            )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = rows.mapInArrow(run, "item bigint, item_id bigint, n_item bigint, elements binary, sketch bigint")
    return written(found.dropDuplicates(["item", "item_id"]), "items")


class Index:
    """Items by the hashes of their sketches, and their whole sets to verify candidates."""

    def __init__(self, sets: list[np.ndarray], sketches: list[int]) -> None:
        self.sets = sets
        held = np.concatenate([x[:k] for x, k in zip(sets, sketches, strict=True)]) if sets else np.zeros(0, dtype=_U)
        order = np.argsort(held, kind="stable")
        self.items = np.repeat(np.arange(len(sets)), [min(k, len(x)) for x, k in zip(sets, sketches, strict=True)])[order]
        self.unique, self.first = np.unique(held[order], return_index=True)
        self.first = np.append(self.first, len(held))
        self.low = np.zeros(1 << 22, dtype=bool)
        self.low[self.unique & _U((1 << 22) - 1)] = True

    def candidates(self, runs: np.ndarray) -> np.ndarray:
        """The items with a hash of their sketch among these shingles."""
        runs = runs[self.low[runs & _U((1 << 22) - 1)]]
        if not len(runs) or not len(self.unique):
            return self.items[:0]
        at = np.searchsorted(self.unique, runs)
        at = np.unique(at[self.unique[np.minimum(at, len(self.unique) - 1)] == runs])
        return np.unique(np.concatenate([self.items[self.first[i] : self.first[i + 1]] for i in at])) if len(at) else self.items[:0]

    def search(self, runs: np.ndarray, per_cent: int) -> list[tuple[int, int]]:
        """(item, shared) of the items that a text of these shingles contains."""
        candidates = self.candidates(runs).tolist()
        if not candidates:
            return []
        own = np.unique(runs)
        shared = [shared_count(self.sets[i], own) for i in candidates]
        return [(i, n) for i, n in zip(candidates, shared, strict=True) if 100 * n >= per_cent * len(self.sets[i])]


def shared_count(item: np.ndarray, own: np.ndarray) -> int:
    """How many of an item's shingles a text's sorted shingles hold."""
    return int((own[np.minimum(np.searchsorted(own, item), len(own) - 1)] == item).sum())


def _by_index(docs: DataFrame, items: DataFrame, width: int, per_cent: int) -> DataFrame:
    rows = items.select("item_id", "elements", "sketch").orderBy("item_id", "elements").toArrow()  # at most INDEX_LIMIT shingles
    ids = rows["item_id"].to_pylist()
    index = Index([np.frombuffer(x, dtype="<u8") for x in rows["elements"].to_pylist()], rows["sketch"].to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            hits: tuple[list, list, list, list] = ([], [], [], [])
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                for item, n in found.search(shingle_runs(text.as_py(), width, NOT_ALPHANUMERIC), per_cent):
                    for column, value in zip(hits, (doc_id.as_py(), ids[item], len(found.sets[item]), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in hits], names=["doc_id", "item_id", "n_item", "n_shared"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, HITS)


def _text_key() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key")


def _by_joins(docs: DataFrame, items: DataFrame, width: int, per_cent: int) -> DataFrame:
    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, NOT_ALPHANUMERIC).view(np.int64) for t in batch.column(1)]
            at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["key", "element"])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), dtype="<i8")[: k.as_py()] for x, k in zip(batch.column(1), batch.column(2), strict=True)]
            at = pa.array(np.repeat(np.arange(len(held)), [len(s) for s in held]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(held) if held else np.zeros(0, np.int64))], names=["item", "element"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [shared_count(np.frombuffer(x.as_buffer(), dtype="<u8"), shingle_set(t.as_py(), width, NOT_ALPHANUMERIC)) for t, x in zip(batch.column(1), batch.column(4), strict=True)]
            keep = pa.array([100 * n >= per_cent * size for n, size in zip(counts, batch.column(3).to_pylist(), strict=True)], pa.bool_())
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["doc_id", "item_id", "n_item", "n_shared"])

    sketch = items.select("item", "elements", "sketch").mapInArrow(sketches, "item bigint, element bigint")
    met = docs.select(_text_key(), "text").mapInArrow(elements, "key string, element bigint").join(sketch, "element").select("key", "item").distinct()
    candidates = written(met, "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key(), "text").join(candidates, "key")
    return texts.join(items, "item").select("doc_id", "text", "item_id", "n_item", "elements").mapInArrow(verify, HITS)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT, limit: int = INDEX_LIMIT) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: a row for each item that a document contains."""
    items = item_sets(benchmark, width, per_cent)
    shingles = items.agg(F.coalesce(F.sum("n_item"), F.lit(0))).first()[0]
    return (_by_index if shingles <= limit else _by_joins)(docs, items, width, per_cent)


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, with the columns they came with. A row goes if any row
    of its id contains an item."""
    hit = free_name(docs, "hit")
    found = hits(docs, benchmark).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(found, docs["doc_id"].eqNullSafe(found[hit]), "left_anti")


def op7_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All hits of all items in all documents."""
    return hits(docs, benchmark)


def _words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"


_SHINGLES_SQL = f"""CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) END"""
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words_sql("text")} AS w FROM documents),
b AS (SELECT item_id, {_words_sql("text")} AS w FROM benchmark),
s AS (SELECT rid, doc_id, unnest({_SHINGLES_SQL}) AS x FROM d),
i AS (SELECT DISTINCT item_id, list_sort({_SHINGLES_SQL}) AS held FROM b WHERE len(w) > 0),
e AS (SELECT item_id, held, len(held)::BIGINT AS n_item, unnest(held) AS x FROM i)
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM s JOIN e USING (x) GROUP BY rid, doc_id, item_id, held, n_item HAVING 100 * count(*) >= {PER_CENT} * n_item"""
