"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct shingles, as 64-bit hashes; rows of one set are one node. Two
sets of sizes a and b are similar if they differ in at most (a + b) * (1 - t) / (1 + t) elements.
An element that no other set has differs from any partner's, so such elements use up a part of that
budget and are left out of the rest:

1. shared elements: all sets' elements are dealt by hash (see packing), those of two or more nodes
   come back to their node, and nodes with more others than the budget are linked with nothing.
2. signatures: sizes are cut into bands by the least ratio two similar sets can have, so such sets
   lie in one band or in neighbouring ones. For each band the feature domain is partitioned by hash
   into groups of cells and subsets of a group's cells are enumerated: what a set has in such a
   subset is a signature, and sets within the budget have one in common. Signatures of few elements
   (FEWEST), which unlike documents share too, are given only by a set whose other signatures
   could all be spoiled within its budget; if either of two similar sets has enough of the others
   they share one of those, and if neither has, both give all. So no similar pair is missed.
3. of the nodes with a signature, the one with the fewest elements of its own is the pivot, the one
   that copies are nearest to; nodes are verified against their pivots exactly. A key that very many
   nodes share gives a row for each of them, never a pair.
4. two nodes can only be similar if they have a pivot in common. Of those in different components,
   pairs are left out whose counts of elements in 128 cells of the domain differ by more than the
   budget; the others, close to the threshold, are verified, and components are joined (see
   components.near_misses).

Defined results for unusual input: null, empty and blank texts have an empty set and are linked
with nothing; repeated rows and rows with equal ids are rows of their own, linked if their texts
are; a null id never is a component's id unless all ids of the component are null; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import packing
from tidelog.llm.common import free_name, written
from tidelog.llm.components import connected, near_misses
from tidelog.llm.shingles import mixed, shingle_set

WIDTH = 5
#: Similar: 100 * intersection >= PER_CENT * union.
PER_CENT = 75
#: Elements that a signature needs, by its band's first size, to be given without further ado.
FEWEST = ((96, 3), (24, 2), (0, 1))
#: Cells in which elements are counted to compare sets without their elements; each is cut into so
#: many for sets with at least one element to a cell even then.
CELLS, FINE = 128, 8
#: Elements that a task packs at once, and sets that it remembers to have packed.
_CHUNK = 250_000
_SEEN = 200_000
_U = np.uint64
_SETS = "node bigint, n bigint, share bigint, elements binary, cells binary"


def bands(per_cent: int) -> np.ndarray:
    """The first size of each band: the next band begins above the largest size that a set of the
    band's first size can be similar to."""
    first, ratio = [1], Fraction(100, per_cent)
    while first[-1] < 1 << 40:
        first.append(int(first[-1] * ratio) + 1)
    return np.array(first, dtype=np.int64)


def budget(a: int, b: int, per_cent: int) -> int:
    """Elements in which similar sets of these sizes can differ."""
    return (a + b) * (100 - per_cent) // (100 + per_cent)


def shape(first: int, after: int, per_cent: int) -> tuple[int, int, int]:
    """(groups, cells of a group, of which a signature takes so many) for sets of [first, after) and
    larger ones similar to them: some group has no more errors than cells that a signature omits."""
    k = budget(after - 1, (after - 1) * 100 // per_cent, per_cent)
    if k < 2:
        return 1, 2 * k + 1, k + 1
    return (-(-(k + 1) // 3), 5, 3) if first < 64 else (-(-(k + 1) // 3), 4, 2)


def fewest(first: int) -> int:
    """Elements that a signature needs in the band that begins with this size."""
    return next(n for size, n in FEWEST if first >= size)


@cache
def _subsets(cells: int, taken: int) -> tuple[tuple[tuple[int, ...], ...], np.ndarray]:
    """The subsets of a group's cells, and for each set of them (as bits) the least number of cells
    that meets all of these."""
    subsets = tuple(combinations(range(cells), taken))
    least = np.full(1 << len(subsets), cells, dtype=np.int64)
    every = np.arange(1 << len(subsets))
    for size in range(cells, -1, -1):
        for hit in combinations(range(cells), size):
            spoiled = sum(1 << i for i, s in enumerate(subsets) if set(s) & set(hit))
            least[every & ~spoiled == 0] = size
    return subsets, least


def signatures(elements: np.ndarray, n: int, starts: np.ndarray, per_cent: int) -> np.ndarray:
    """The signatures of a set of n elements, of which these are shared with others: those of its
    own band and, for a set that could be the larger one of a pair, those of the band below."""
    own = int(np.searchsorted(starts, n, side="right")) - 1
    found = []
    for band in (own, own - 1):
        # The band below matters only if one of its sizes is large enough for this one.
        if band < 0 or (band < own and 100 * (int(starts[own]) - 1) < per_cent * n):
            continue
        first, after = int(starts[band]), int(starts[band + 1])
        groups, cells, taken = shape(first, after, per_cent)
        spread = mixed(elements + _U((0x9E3779B97F4A7C15 * (band + 1)) % 2**64))
        part = (spread % _U(groups * cells)).astype(np.int64)
        content = np.zeros(groups * cells, dtype=_U)
        np.add.at(content, part, mixed(spread))
        content = mixed(content ^ mixed(np.arange(groups * cells, dtype=_U) + _U(band * 1_000_003 + 1))).reshape(groups, cells)
        counts = np.bincount(part, minlength=groups * cells).reshape(groups, cells)
        subsets, least = _subsets(cells, taken)
        sigs = np.stack([mixed(content[:, s].sum(axis=1, dtype=_U) + _U(i + 1)) for i, s in enumerate(subsets)], axis=1)
        enough = np.stack([counts[:, s].sum(axis=1) for s in subsets], axis=1) >= fewest(first)
        found.append(sigs[enough])
        partner = n * 100 // per_cent if band == own else after - 1
        if least[enough @ (1 << np.arange(len(subsets)))].sum() <= budget(n, partner, per_cent) - (n - len(elements)):
            found.append(mixed(sigs[~enough]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=_U)


def set_hash(elements: np.ndarray) -> int:
    """64 bits that stand for the set, as a signed number."""
    total = mixed(elements).sum(dtype=_U) + _U(len(elements))
    return int(mixed(np.array([total], dtype=_U)).view(np.int64)[0])


def row_key() -> Column:
    """A key of a row's id and text; equal for repeated rows alone."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, key, n_shingles and node (the set's hash; null for an empty set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(2):
                elements = shingle_set(text.as_py(), width)
                sizes.append(len(elements))
                nodes.append(set_hash(elements) if len(elements) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], names=["doc_id", "key", "n_shingles", "node"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), "text").mapInArrow(run, "doc_id bigint, key string, n_shingles bigint, node bigint")


def _packed(sets: list[np.ndarray], nodes: list[int], buckets: int, sizes: list[int] | None = None, shares: list[int] | None = None) -> pa.RecordBatch:
    lengths = [len(s) for s in sets]
    keys = np.concatenate(sets) if sets else np.zeros(0, dtype=_U)
    return packing.packed(keys, np.repeat(np.arange(len(sets)), lengths), nodes, buckets, sizes or lengths, shares)


def _all_elements(buckets: int, width: int):
    """Packs the elements of texts; a set that a task has seen before isn't packed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets, nodes, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                elements = shingle_set(text.as_py(), width)
                if not len(elements) or (node := set_hash(elements)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(node)
                sets.append(elements)
                nodes.append(node)
                held += len(elements)
                if held >= _CHUNK:
                    yield _packed(sets, nodes, buckets)
                    sets, nodes, held = [], [], 0
        yield _packed(sets, nodes, buckets)

    return run


def _homeward(buckets: int):
    """Numbers the elements that two or more nodes have and sends them back to their nodes: a row for
    each range of nodes."""
    kind = packing.id_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, given = -1, 0
        for key, node, size, _ in packing.met(batches):
            if not len(key):
                continue
            bucket = int(key[0] >> _U(48))
            given = given if bucket == last else 0
            last = bucket
            number = np.cumsum(np.append(False, key[1:] != key[:-1])) + given
            given = int(number[-1]) + 1
            number = ((bucket << 23) + number).astype(kind)
            to = ((node.view(_U) >> _U(48)) * _U(buckets) >> _U(16)).astype(np.uint16)
            order = np.lexsort((node, to))
            to, node, size, number = to[order], node[order], size[order], number[order]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            ends = np.append(first, len(node))
            cuts = np.flatnonzero(np.append(True, to[first][1:] != to[first][:-1])).tolist()
            pairs = list(zip(cuts, [*cuts[1:], len(first)], strict=True))
            columns = [pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in (node[first], size[first], np.diff(ends).astype("<u4"))]
            columns.append(pa.array([number[ends[a] : ends[b]].tobytes() for a, b in pairs], pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([int(to[first[a]]) for a in cuts], pa.int32()), *columns], names=["home", "nodes", "sizes", "counts", "elements"])

    return run


def cell_counts(elements: np.ndarray, n: int) -> np.ndarray:
    """How many elements lie in each cell; of large sets in CELLS * FINE of them, FINE to each of CELLS."""
    cells = CELLS * (FINE if n >= CELLS * FINE else 1)
    return np.minimum(np.bincount((mixed(elements.astype(_U)) % _U(cells)).astype(np.int64), minlength=cells), 65535).astype("<u2")


def coarse(cells: np.ndarray) -> np.ndarray:
    """Counts in CELLS cells of those in CELLS * FINE."""
    return cells.reshape(*cells.shape[:-1], -1, CELLS).sum(axis=-2)


def _gathered(buckets: int, per_cent: int):
    """The sets of nodes that can be similar to any other: their shared elements' numbers, sorted."""
    kind = packing.id_type(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                held.setdefault(batch.column(0)[row].as_py(), []).append(tuple(batch.column(c)[row].as_buffer() for c in range(1, 5)))
        for home in list(held):
            rows = held.pop(home)
            node, size, count, number = (np.concatenate([np.frombuffer(r[c], dtype=k) for r in rows]) for c, k in enumerate(("<i8", "<u4", "<u4", kind)))
            del rows
            node, size = np.repeat(node, count), np.repeat(size, count)
            order = np.lexsort((number, node))
            node, size, number = node[order], size[order], number[order]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            count = np.diff(np.append(first, len(node)))
            keep = np.flatnonzero(100 * count >= per_cent * size[first].astype(np.int64))
            for k in range(0, len(keep), 1000):
                at = keep[k : k + 1000]
                sizes = size[first[at]].tolist()
                sets = [number[a : a + c] for a, c in zip(first[at].tolist(), count[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[first[at]]), pa.array(sizes, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([cell_counts(x, n).tobytes() for x, n in zip(sets, sizes, strict=True)], pa.binary())],
                    names=["node", "n", "share", "elements", "cells"],
                )

    return run


def shared_sets(docs: DataFrame, buckets: int, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """The written table (node, n, share, elements, cells) of the sets that share enough elements with
    others to be similar to any: n is the whole set's size, elements are numbers of the shared ones."""
    dealt = docs.select("text").mapInArrow(_all_elements(buckets, width), packing.PACKED).repartition(buckets, "bucket")
    home = dealt.mapInArrow(_homeward(buckets), "home int, nodes binary, sizes binary, counts binary, elements binary").repartition(buckets, "home")
    return written(home.mapInArrow(_gathered(buckets, per_cent), _SETS), "sets")


def _all_signatures(buckets: int, kind: str, per_cent: int):
    starts = bands(per_cent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = [np.frombuffer(x.as_buffer(), dtype=kind).astype(_U) for x in batch.column(2)]
            yield _packed([signatures(s, n, starts, per_cent) for s, n in zip(sets, sizes, strict=True)], nodes, buckets, sizes, [len(s) for s in sets])

    return run


def _pivots(per_cent: int):
    """(pivot, node, near) for the nodes of a signature: near if their sizes and shared elements allow
    similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros((0, 3), dtype=np.int64)]
        for key, node, size, share in packing.met(batches):
            size, share = size.astype(np.int64), share.astype(np.int64)
            order = np.lexsort((node, 64 * (size - share) // size, key))
            key, node, size, share = key[order], node[order], size[order], share[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key.astype(np.int64)
            pivot = np.repeat(first, np.diff(np.append(first, len(key))))
            near = (100 + per_cent) * np.minimum(share, share[pivot]) >= per_cent * (size + size[pivot])
            rows = np.stack([node[pivot], node, near.astype(np.int64)], axis=1)[pivot != np.arange(len(key))]
            found = [np.unique(np.concatenate([*found, rows]), axis=0)]
        rows = found[0]
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2] == 1)], names=["pivot", "node", "near"])

    return run


def pivot_pairs(sets: DataFrame, kind: str, per_cent: int) -> DataFrame:
    """The written table (pivot, node, near): a row for each node and each pivot it shares a signature with."""
    total = sets.agg(F.coalesce(F.sum("share"), F.lit(0))).first()[0]
    buckets = packing.bucket_count(2 * total)
    dealt = sets.select("node", "n", "elements").mapInArrow(_all_signatures(buckets, kind, per_cent), packing.PACKED).repartition(buckets, "bucket")
    return written(dealt.mapInArrow(_pivots(per_cent), "pivot bigint, node bigint, near boolean").distinct(), "pivots")


def apart(n: np.ndarray, share: np.ndarray, cells: np.ndarray, other: int, other_share: int, other_cells: np.ndarray, per_cent: int) -> np.ndarray:
    """Whether sets differ from another in more elements than similar ones can, by what the others
    don't have and by their counts in cells (rows of the same cells)."""
    errors = (n - share) + (other - other_share) + np.abs(cells.astype(np.int32) - other_cells.astype(np.int32)).sum(axis=1)
    return (100 + per_cent) * errors > (100 - per_cent) * (n + other)


def close_pairs(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) that their counts in cells don't keep apart."""
    facts = [sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("share").alias(f"share{x}"), F.col("cells").alias(f"cells{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, sa, ca, nb, sb, cb in zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True):
                x, y = np.frombuffer(ca, dtype="<u2"), np.frombuffer(cb, dtype="<u2")
                if len(x) != len(y):
                    x, y = coarse(x), coarse(y)
                keep.append(not apart(np.array([na]), np.array([sa]), x[None], nb, sb, y, per_cent)[0])
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(facts[0], "a").join(facts[1], "b").select("a", "b", "na", "sharea", "cellsa", "nb", "shareb", "cellsb").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, kind: str, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar: an exact count of what they have in common."""
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("elements").alias("left"))
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for na, left, nb, right in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5), strict=True):
                both = np.sort(np.concatenate([np.frombuffer(left.as_buffer(), dtype=kind), np.frombuffer(right.as_buffer(), dtype=kind)]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                similar.append(100 * shared >= per_cent * (na + nb - shared))
            keep = pa.array(similar, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "left", "nb", "right").mapInArrow(run, "a bigint, b bigint")


def _near_misses(group: pa.Table, sides: bool, per_cent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group's nodes in different components that their counts don't keep apart; with
    sides, only pairs of a node of either block."""
    node, n, share, label, block = (group[c].to_numpy() for c in ("node", "n", "share", "label", "block"))
    counts = [np.frombuffer(x, dtype="<u2") for x in group["cells"].to_pylist()]
    fine = np.array([len(x) > CELLS for x in counts])
    place = np.where(fine, np.cumsum(fine), np.arange(len(node))) - fine
    rough = np.stack([coarse(x) if f else x for x, f in zip(counts, fine, strict=True)])
    exact = np.stack([x for x, f in zip(counts, fine, strict=True) if f]) if fine.any() else None
    for i in range(len(node) - 1):
        later = slice(i + 1, None)
        could = (label[later] != label[i]) & ((100 + per_cent) * np.minimum(share[later], share[i]) >= per_cent * (n[later] + n[i]))
        if sides:
            could &= block[later] != block[i]
        at = i + 1 + np.flatnonzero(could)
        if len(at):
            at = at[~apart(n[at], share[at], rough[at], n[i], share[i], rough[i], per_cent)]
        if len(at) and fine[i]:
            both = at[fine[at]]
            far = both[apart(n[both], share[both], exact[place[both]], n[i], share[i], exact[place[i]], per_cent)]
            at = np.setdiff1d(at, far, assume_unique=True)
        if len(at):
            yield node[at], np.full(len(at), node[i])


def node_labels(docs: DataFrame, found: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """node, label of the components of similar nodes; a node that is alone may be absent."""
    buckets = packing.bucket_count(found.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0])
    kind = packing.id_type(buckets)
    sets = shared_sets(docs, buckets, width, per_cent)
    met = pivot_pairs(sets, kind, per_cent)
    near = met.where("near").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    links = written(verified(close_pairs(near, sets, per_cent), sets, kind, per_cent), "links")
    labels = connected(links)
    missed = near_misses(met, sets.select("node", "n", "share", "cells"), labels, lambda group, sides: _near_misses(group, sides, per_cent))
    more = written(verified(missed, sets, kind, per_cent), "links")
    return labels if more.isEmpty() else connected(links.unionByName(more))


def join(docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row, and its node (rows of one set have one node)."""
    found = written(digests(docs, width), "digests")
    labels = node_labels(docs, found.where("node IS NOT NULL"), width, per_cent)
    placed = found.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = placed.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    return placed.join(smallest, "label", "left").select("doc_id", "n_shingles", F.coalesce("smallest", "doc_id").alias("component_id"), "node")


def one_of_each(docs: DataFrame, width: int = WIDTH, per_cent: int = PER_CENT) -> DataFrame:
    """One document of each component, with the columns it came with: that with the smallest id
    (null ids last), then the smallest key; of equal rows of these one stays. Documents without words
    are linked with nothing and all stay."""
    found = written(digests(docs, width), "digests")
    labels = node_labels(docs, found.where("node IS NOT NULL"), width, per_cent)
    key = free_name(docs, "key")
    placed = found.where("node IS NOT NULL").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    best = placed.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best"))
    keyed = docs.withColumn(key, row_key())
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.where(has_words).join(best.select(F.col("best.key").alias(key)), key, "left_semi").dropDuplicates([key])
    return kept.unionByName(keyed.where(~has_words)).drop(key)


def op10_ngram_join(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return join(docs).select("doc_id", "n_shingles", "component_id")


OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) END AS s FROM d),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= {PER_CENT} * (na.n + nb.n - i)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
SELECT n.doc_id, n.n AS n_shingles, min(reached) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2"""
