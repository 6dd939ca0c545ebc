"""Substring dedup by sliding sentence spans.

A sentence ends with a word that ends in . ! or ?, or before a line end; one of more than LONG
words counts as several, cut after words whose hash is the smallest of REACH words on either side,
so that a passage is cut alike wherever it stands. From each sentence a run grows until it has SPAN
sentences and MIN_WORDS words, and is hashed; equal hashes are joined over the whole corpus; the
first place of each (smallest id, then text, then place) stays, and sentences that any other place
covers are removed.

Defined results for unusual input: null, empty and blank texts have no sentences and stay; a
repeated row (equal id and text) is the same document, so it doesn't count as a repeat of itself;
rows with equal ids and other texts are documents of their own; null ids come first; a text
of one sentence is a run by itself, if it has MIN_WORDS words; an empty table gives an empty table; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import written
from tidelog.llm.shingles import sequence_hashes, text_words

#: Sentences in a run, and the words that it needs.
SPAN = 2
MIN_WORDS = 10
#: Sentences of more words are cut: of shorter ones a passage of over 50 words has two whole ones.
LONG = 16
REACH = 3
_ENDS = np.isin(np.arange(256), [0x21, 0x2E, 0x3F])


def sentences(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of words, first byte and end byte (where the next one begins) of each sentence."""
    data, starts, ends, words = text_words(text)
    if not len(words):
        return words, starts, starts, ends
    breaks = np.concatenate([[0], np.cumsum(data == 0x0A)])
    last = _ENDS[data[ends - 1]]
    last[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    last[-1] = True
    to = np.flatnonzero(last) + 1
    cut = np.repeat(np.diff(to, prepend=0) > LONG, np.diff(to, prepend=0))
    for k in range(1, min(REACH, len(words) - 1) + 1):
        cut[k:] &= words[k:] <= words[:-k]
        cut[:-k] &= words[:-k] <= words[k:]
    last |= cut
    to = np.flatnonzero(last) + 1
    at = np.concatenate([[0], to[:-1]])
    begins = starts[at]
    return sequence_hashes(words, at, to), to - at, begins, np.append(begins[1:], len(data))


def run_ends(words: np.ndarray, span: int, min_words: int) -> np.ndarray:
    """The end sentence of the run from each of the first sentences; the rest have too few after them."""
    total = np.concatenate([[0], np.cumsum(words)])
    to = np.maximum(np.searchsorted(total, total[:-1] + min_words), np.arange(len(words)) + min(span, len(words)))
    return to[to <= len(words)]


def runs(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(run, doc_id, digest, place, again): a row for each run of sentences; again where an earlier
    place of the run is in the same batch, so that of a run that very many documents have each batch
    has one row to compare with the others."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in batch.column(2):
                found, words, _, _ = sentences(text.as_py())
                to = run_ends(words, span, min_words)
                at = np.arange(len(to))
                hashes.append(sequence_hashes(found, at, to).view(np.int64))
                places.append(at)
            row = np.repeat(np.arange(len(hashes) - 1), [len(h) for h in hashes[1:]])
            run, place = np.concatenate(hashes), np.concatenate(places)
            doc_id, digest = batch.column(0).fill_null(0).to_numpy()[row], batch.column(1).to_numpy()[row]
            some = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)[row]
            order = np.lexsort((place, digest, doc_id, some, run))
            first = np.flatnonzero(np.append(True, run[order][1:] != run[order][:-1])) if len(run) else row
            at = order[np.repeat(first, np.diff(np.append(first, len(run))))]  # the run's first row, for each
            again = np.zeros(len(run), dtype=bool)
            again[order] = (place[order] != place[at]) | (digest[order] != digest[at]) | (doc_id[order] != doc_id[at]) | (some[order] != some[at])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(run), batch.column(0).take(at), batch.column(1).take(at), pa.array(place.astype(np.int32)), pa.array(again)], names=["run", "doc_id", "digest", "place", "again"])

    return _keyed(docs).mapInArrow(read, "run bigint, doc_id bigint, digest bigint, place int, again boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")


def repeats(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, digest, places): where each document's non-first repeated runs begin."""
    found = written(runs(docs, span, min_words), "runs")
    # Equal rows of a repeated document have one rank.
    order = Window.partitionBy("run").orderBy(F.col("doc_id").asc_nulls_first(), "digest", "place")
    later = found.where("NOT again").select("run", "doc_id", "digest", "place").withColumn("rank", F.rank().over(order)).where("rank > 1")
    again = found.where("again").select("doc_id", "digest", "place").unionByName(later.select("doc_id", "digest", "place"))
    return again.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set("place")).alias("places"))


def removed(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each document that loses sentences: doc_id, n_sentences, n_removed, spans (first
    and end sentence of what goes, as text) and the text that stays."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                content = text.as_py() or ""
                _, words, begins, ends = sentences(content)
                first = places.values.to_numpy()
                open_runs = np.zeros(len(begins) + 1, dtype=np.int64)
                np.add.at(open_runs, first, 1)
                np.add.at(open_runs, run_ends(words, span, min_words)[first], -1)
                gone = np.cumsum(open_runs) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])))
                data = content.encode("utf-8", "replace")
                kept = b"".join(data[a:b] for a, b, g in zip(begins.tolist(), ends.tolist(), gone, strict=False) if not g)
                spans = ",".join(f"{a}:{b}" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                for column, value in zip(rows, (len(begins), int(gone.sum()), spans, kept.decode("utf-8", "replace")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())],
                names=["doc_id", "n_sentences", "n_removed", "spans", "text"],
            )

    found = repeats(docs, span, min_words).alias("r")
    hit = _keyed(docs).alias("d").join(found, F.expr("d.doc_id <=> r.doc_id AND d.digest = r.digest")).select("d.doc_id", "d.text", "r.places")
    return hit.mapInArrow(cut, "doc_id bigint, n_sentences bigint, n_removed bigint, spans string, text string")


def op6_span_dedup(docs: DataFrame) -> DataFrame:
    """The documents that lose sentences, and what they keep."""
    return removed(docs)
