"""Packed exchange of 64-bit keys: many keys in one row, grouped by array operations.

A task packs the keys of many owners (documents' sets) by bucket, the leading bits of a key: a row
for each bucket and chunk, six bytes for each key, and each owner's numbers once a bucket. Dealt by
bucket, all owners of a key meet in one task, which needs the memory of one bucket's packed keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A packed row: owners (node, size, share) with the number of keys each has here, and the keys.
PACKED = "bucket int, nodes binary, sizes binary, shares binary, counts binary, low binary, high binary"
#: Keys that one bucket takes, and that are sorted at once.
BUCKET_KEYS = 16_000_000
SORTED_KEYS = 1_000_000
LEAST_BUCKETS = 24
_U = np.uint64
_LOW = _U((1 << 48) - 1)


def bucket_count(keys: int) -> int:
    """Buckets for so many keys: by their number alone, at most one for each leading 16 bits."""
    return min(1 << 16, max(LEAST_BUCKETS, -(-keys // BUCKET_KEYS)))


def id_type(buckets: int) -> str:
    """What holds a shared key's number: its bucket, then its place among the bucket's shared keys, of
    which there are at most 2^23: two nodes have each of the bucket's keys (BUCKET_KEYS)."""
    return "<u4" if buckets <= 512 else "<u8"


def packed(keys: np.ndarray, owner: np.ndarray, nodes: np.ndarray | list[int], buckets: int, sizes: list[int] | None = None, shares: list[int] | None = None) -> pa.RecordBatch:
    """Rows PACKED of keys, each with its owner's place in nodes (ascending); numbers of the owners that
    aren't given leave their columns empty."""
    bucket = ((keys >> _U(48)) * _U(buckets) >> _U(16)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    bucket, owner, value = bucket[order], owner[order], keys[order] & _LOW
    first = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    counts = np.diff(np.append(first, len(bucket))).astype("<u4")
    at = owner[first]
    numbers = [np.zeros(0, dtype="<u4") if x is None else np.asarray(x, dtype="<u4")[at] for x in (sizes, shares)]
    columns = [np.asarray(nodes, dtype="<i8")[at], *numbers, counts] if len(first) else []
    values = [(value & _U(0xFFFFFFFF)).astype("<u4"), (value >> _U(32)).astype("<u2")]
    new = np.flatnonzero(np.diff(bucket[first].astype(np.int64), prepend=-1)) if len(first) else first
    cuts = list(zip(new.tolist(), [*new[1:].tolist(), len(first)], strict=True)) if len(new) else []
    ends = np.append(first, len(bucket))
    rows = [pa.array([int(bucket[first[a]]) for a, _ in cuts], pa.int32())]
    rows += [pa.array([c[a:b].tobytes() for a, b in cuts], pa.binary()) for c in columns] or [pa.array([], pa.binary())] * 4
    rows += [pa.array([v[ends[a] : ends[b]].tobytes() for a, b in cuts], pa.binary()) for v in values]
    return pa.RecordBatch.from_arrays(rows, names=["bucket", "nodes", "sizes", "shares", "counts", "low", "high"])


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, node, size, share), ordered by key and node and without repeats, of the keys that two
    or more nodes have, of the packed rows of whole buckets; in pieces that no key spans."""
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            held.setdefault(batch.column(0)[row].as_py(), []).append(tuple(batch.column(c)[row].as_buffer() for c in range(1, 7)))
    for bucket in list(held):
        rows = held.pop(bucket)
        joined = [np.concatenate([np.frombuffer(r[c], dtype=kind) for r in rows]) for c, kind in enumerate(("<i8", "<u4", "<u4", "<u4", "<u4", "<u2"))]
        del rows
        nodes, sizes, shares, counts = joined[:4]
        pieces = 1 + len(joined[4]) // SORTED_KEYS
        piece = (joined[5].astype(np.uint32) * np.uint32(pieces) >> np.uint32(16)) if pieces > 1 else None
        owner = np.repeat(np.arange(len(nodes), dtype=np.int32), counts)
        for k in range(pieces):
            mine = slice(None) if piece is None else np.flatnonzero(piece == k)
            key = joined[4][mine].astype(_U) | joined[5][mine].astype(_U) << _U(32)
            if not len(key):
                continue
            order = np.argsort(key)
            key, at = key[order], owner[mine][order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            node = nodes[at]
            shared = np.minimum.reduceat(node, first) != np.maximum.reduceat(node, first)
            keep = np.repeat(shared, np.diff(np.append(first, len(key))))
            key, node, at = key[keep], node[keep], at[keep]
            order = np.lexsort((node, key))
            key, node, at = key[order], node[order], at[order]
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])) if len(key) else keep[:0]
            yield key[new] | _U(bucket) << _U(48), node[new], sizes[at[new]] if len(sizes) else sizes, shares[at[new]] if len(shares) else shares
