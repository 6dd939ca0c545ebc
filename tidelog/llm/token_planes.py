"""Token ids in a file format of shuffled planes.

Documents are range-sorted by id and encoded by partition; each partition writes its stream of
ids as shards of about a million ids, in whole documents. A shard's ids are cut into blocks of
fixed size; a block is transposed into byte or bit planes, each plane is compressed with
zstandard, and the shard's chunk index tells where each plane begins. Shards are rows of a
Parquet table that Spark writes and commits, so the format needs no file system of its own and
a lost executor costs the shards it was writing.

Shard columns: part, shard (their order is the order of the ids), first (ids of the part before
the shard), doc_ids and n_tokens (the
documents of the shard), n_ids, block (ids in a block), planes (4: bytes, 32: bits), offsets
(where each plane of each block begins in payload, and its end), payload.

Defined results for unusual input: a null or empty text is the end id alone; ids that are null
come first; repeated rows are encoded each, equal ids in the order of their texts; an empty table
gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import written

#: Appended to each document.
END_ID = 1
BLOCK = 1 << 16
SHARD_IDS = 1 << 20
#: Entries of the table of encoded chunks that a worker keeps; it starts anew when full.
CACHE = 1_000_000
SHARD_SCHEMA = "part int, shard int, first bigint, doc_ids array<bigint>, n_tokens array<bigint>, n_ids bigint, block int, planes int, offsets array<bigint>, payload binary"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The steps of a tokenizer that Encoder takes chunk by chunk: fixed values of the tokenizer's file.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def _by_chunks(tokenizer) -> bool:
    """Whether the tokenizer never joins over a blank or a line end, as Encoder knows it."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    normal, split = (json.loads(x.__getstate__()) for x in (tokenizer.normalizer, tokenizer.pre_tokenizer))
    steps = split.get("pretokenizers") or [{}]
    return normal.get("normalizers") == _NORMALIZERS and steps[0] == _SPLIT and [x["type"] for x in steps[1:]] == ["ByteLevel"]


class Encoder:
    """Ids of whole texts; by chunks for a tokenizer that never joins over a blank or a line end.

    word_bpe_49k drops white space before it splits and lower-cases by character, so the ids of
    a text are those of its chunks between blanks in turn, a first capital counts as its
    small letter, and the signs after a last letter are tokens of their own. What isn't
    known yet is encoded by the library: plain words by its model alone, other chunks whole and
    many at a time, joined by a special token at whose id the result is cut again. Texts for a
    tokenizer of other steps are encoded whole.
    """

    def __init__(self, path: str, separator: str = "<|endoftext|>") -> None:
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.by_chunks = _by_chunks(self.tokenizer) and self.tokenizer.token_to_id(separator) is not None
        self.separator, self.separator_id = separator, self.tokenizer.token_to_id(separator)
        self.known: dict[str, bytes] = {"": b""}

    def __call__(self, text: str | None) -> bytes:
        if not self.by_chunks:
            return np.asarray(self.tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()
        chunks = (text or "").replace("\n", " ").split(" ")
        known = self.known
        found = [known.get(c) for c in chunks]
        if None not in found:
            return b"".join(found)
        if len(known) + len(chunks) > CACHE:
            known = self.known = {"": b""}
            new = set(chunks) - {""}
        else:
            new = {c for c, ids in zip(chunks, found, strict=True) if ids is None}
        parts = {c: _parts(c) for c in new}
        hard = []
        for p in {p for x in parts.values() for p in x if p not in known}:
            if p.isalpha() and p == p.lower() and is_normalized("NFC", p):
                # One word that normalising leaves alone: only the model is needed.
                tokens = self.model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_VISIBLE))
                known[p] = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
            else:
                hard.append(p)
        self._learn([p for p in hard if self.separator not in p], known)
        for p in hard:
            if self.separator in p:
                known[p] = np.asarray(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes()
        for c, x in parts.items():
            if len(x) > 1 or x[0] != c:
                known[c] = b"".join([known[p] for p in x])
        return b"".join([known[c] for c in chunks])

    def _learn(self, plain: list[str], known: dict[str, bytes]) -> None:
        if not plain:
            return
        ids = np.asarray(self.tokenizer.encode(self.separator.join(plain), add_special_tokens=False).ids, dtype="<u4")
        ends = np.append(np.flatnonzero(ids == self.separator_id), len(ids)).tolist()
        at = 0
        for p, end in zip(plain, ends, strict=True):
            known[p] = ids[at:end].tobytes()
            at = end + 1


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker: what a task has encoded the next one needn't."""
    return Encoder(path)


def _visible() -> dict[int, int]:
    """The byte-level alphabet: bytes without a visible character stand for those from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}


_VISIBLE = _visible()


#: Signs that may end a chunk: what follows the last letter of a chunk is a token group of its own. An
#: apostrophe begins groups with letters, and the special tokens have the signs that are left out.
_SIGNS = "!#$%&*+,-./:;=?@)]}~"


def _parts(chunk: str) -> tuple[str, ...]:
    """The chunk without a first capital (ASCII or Latin-1), in lower case if the word is of ASCII letters,
    and the signs at its end apart, unless what is before them doesn't end in a letter once in lower case:
    a combining mark joins a sign, and may join a small letter alone, so that a capital before it stays."""
    word = chunk.rstrip(_SIGNS)
    signs = chunk[len(word) :]
    if signs and not (word and word[-1].isalpha() and word[-1].lower()[-1].isalpha()):
        word, signs = chunk, ""
    if word.isascii() and word.isalpha():
        word = word.lower()
    elif ("A" <= word[0] <= "Z" or "\u00c0" <= word[0] <= "\u00de" and word[0] != "\u00d7") and (word[1:2].isascii() or word[1].isalpha()):
        word = word[0].lower() + word[1:]
    return (word, signs) if signs else (word,)


def to_planes(ids: np.ndarray, planes: int = 4, level: int = 3) -> list[bytes]:
    """One block as compressed planes: 4 of bytes or 32 of bits, the lowest first."""
    rows = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == 32:
        rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little"), axis=0, bitorder="little")
    pack = zstandard.ZstdCompressor(level=level)
    return [pack.compress(np.ascontiguousarray(rows[:, k]).tobytes()) for k in range(rows.shape[1])]


def from_planes(frames: list[bytes], n: int) -> np.ndarray:
    """The n ids of a block."""
    unpack = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(unpack.decompress(f), dtype=np.uint8) for f in frames], axis=1) if n else np.zeros((0, len(frames)), np.uint8)
    if len(frames) == 32:
        rows = np.packbits(np.unpackbits(rows, axis=0, bitorder="little")[:n], axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


def _shard(part: int, shard: int, first: int, doc_ids: list, counts: list[int], stream: bytes, block: int, planes: int) -> pa.RecordBatch:
    ids = np.frombuffer(stream, dtype="<u4")
    frames = [f for at in range(0, len(ids), block) for f in to_planes(ids[at : at + block], planes)]
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([counts], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([block], pa.int32()),
            pa.array([planes], pa.int32()), pa.array([offsets.tolist()], pa.list_(pa.int64())), pa.array([b"".join(frames)], pa.binary()),
        ],
        names=["part", "shard", "first", "doc_ids", "n_tokens", "n_ids", "block", "planes", "offsets", "payload"],
    )


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK, planes: int = 4) -> DataFrame:
    """The table of shards, in ascending order of doc_id by part and shard."""
    path = tokenizer or default_tokenizer()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = _encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, counts, stream, size, first = [], [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder(text.as_py()) + end
                doc_ids.append(doc_id.as_py())
                counts.append(len(ids) // 4)
                stream.append(ids)
                size += len(ids) // 4
                if size >= SHARD_IDS:
                    yield _shard(part, shard, first, doc_ids, counts, b"".join(stream), block, planes)
                    shard, first, doc_ids, counts, stream, size = shard + 1, first + size, [], [], [], 0
        if doc_ids:
            yield _shard(part, shard, first, doc_ids, counts, b"".join(stream), block, planes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, SHARD_SCHEMA)


def decode(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                frames, at = row["payload"], row["offsets"]
                pieces, n = [], row["n_ids"]
                for k in range(-(-n // row["block"])):
                    first = k * row["planes"]
                    planes = [frames[at[i] : at[i + 1]] for i in range(first, first + row["planes"])]
                    pieces.append(from_planes(planes, min(row["block"], n - k * row["block"])))
                stream = memoryview(np.concatenate(pieces).tobytes())
                ends = np.cumsum(row["n_tokens"])
                starts = ends - row["n_tokens"]
                crcs = [zlib.crc32(stream[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["offset"] + starts, pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # One row for each part of the table: the ids of the parts before it.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_offset"))
    # As many rows as the writing stage had tasks: small by construction, so broadcast.
    placed = shards.join(F.broadcast(offsets), "part").withColumn("offset", F.col("part_offset") + F.col("first"))
    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_planes(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards, reads them back and returns the contract's columns."""
    return decode(written(encode(docs, tokenizer), "token-shards"))
