"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated Kneser-Ney model over the characters of a word (begin and end
marks included, ORDER characters at most). A class's own counts back off to the model of both
classes together, and that one to continuation counts of ever shorter grams, so a rare expression
is smoothed by what either class knows of it and of its parts.

What is compared are the two log-likelihoods, so a text needs their difference alone, the log of the
ratio for each of its grams. A gram that the labelled texts have gives the ratio of both smoothed
probabilities. For one that they don't have, each class backs off to the same shared probability,
which cancels: what is left is the ratio of the two backoff weights of its context, or nothing where
the context is new as well. The model is thus two tables, of grams and of contexts, of any size; up to
MODEL_LIMIT entries they are broadcast as arrays and texts are scored where they stand, beyond
that words meet them by joins, with the same result.

A document is compared by its length-normalised log-likelihoods: the mean over all its words, and
the largest mean over windows of WINDOW words, which doesn't thin out in long texts but grows with
their length by chance. A logistic curve over both and the logarithm of the length, fitted on a
bounded sample of other labelled rows than those counted, gives the score.

Labelled rows with remainder 2 of crc32(doc_id as text) by 4 are held out: neither counted nor
fitted. Rows with remainder 0 or 1 are counted, all of them; of rows with remainder 3 at most
FIT_ROWS, those with the smallest hash, fit the curve.

Defined results for unusual input: null, empty and wordless texts have a difference of 0 and get
the score of that; repeated rows get equal scores; a null id counts as an empty text's remainder
(0, not held out); rows of one id with several labels count with each; without labelled rows of
both classes every score is 0.5; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import written
from tidelog.llm.shingles import mixed, sequence_hashes

ORDER = 6
DISCOUNT = 0.75
#: Probability of a character that was never seen.
FLOOR = 1e-4
WINDOW = 24
#: Rows that the curve is fitted on, at most.
FIT_ROWS = 20_000
#: Entries up to which a model is broadcast: twelve bytes each, so 180 MB at most.
MODEL_LIMIT = 15_000_000
THRESHOLD = 0.3
#: Entries of a worker's table of scored words; it starts anew when full.
CACHE = 500_000
#: What the curve is over.
FEATURES = ("mean", "peak", "length")
#: Texts that are scored at once.
_TEXTS = 500
#: Kinds of the model's entries.
SEEN, CONTEXT = 1, 2
_WORD = re.compile(r"[^\W_]+")
_U = np.uint64


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 4


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, n1, n0): how often a word stands in texts of either label."""
    words = labelled.select("toxic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("n1"), F.sum(1 - F.col("toxic").cast("long")).alias("n0"))


def gram_ratios(words: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(kind, gram, ratio): log p1 - log p0 of a gram's last character after its others (SEEN), and of any
    other character after a context (CONTEXT)."""
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = words.select(
        F.explode(F.transform(F.sequence(F.lit(2), F.length("word") + 2), lambda i: marked.substr(F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order))))).alias("gram"), "n1", "n0"
    )
    top = written(grams.groupBy("gram").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).withColumn("context", F.expr("left(gram, length(gram) - 1)")), "grams")
    contexts = top.groupBy("context").agg(
        F.sum("n1").alias("c1"), F.sum("n0").alias("c0"), F.sum((F.col("n1") > 0).cast("long")).alias("d1"), F.sum((F.col("n0") > 0).cast("long")).alias("d0"), F.count(F.lit(1)).alias("d")
    )
    # Shared backoff: how many grams end so, by continuation counts of ever shorter suffixes.
    lower = top.select("gram", F.expr("substring(gram, 2)").alias("suffix")).where("length(suffix) >= 1")
    level, backoff = lower.groupBy("suffix").agg(F.count(F.lit(1)).alias("n")), None
    tables = []
    for _ in range(order - 1):
        level = written(level.withColumn("context", F.expr("left(suffix, length(suffix) - 1)")), "level")
        tables.append(level)
        level = level.where("length(suffix) > 1").groupBy(F.expr("substring(suffix, 2)").alias("suffix")).agg(F.count(F.lit(1)).alias("n"))
    for level in reversed(tables):
        sums = level.groupBy("context").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("d"))
        here = level.join(sums, "context")
        if backoff is None:
            found = here.select("suffix", (F.col("n") / F.col("c")).alias("p"))
        else:
            below = here.join(backoff.select(F.col("suffix").alias("s"), F.col("p").alias("q")), F.expr("substring(suffix, 2) = s"), "left")
            found = below.select("suffix", ((F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("d") * F.coalesce("q", F.lit(FLOOR))) / F.col("c")).alias("p"))
        backoff = written(found, "backoff")
    shared = top.join(contexts, "context").join(backoff.select(F.col("suffix").alias("s"), "p"), F.expr("substring(gram, 2) = s"), "left")

    def smoothed(n: Column, c: Column, d: Column, below: Column) -> Column:
        return F.when(c == 0, below).otherwise((F.greatest(n - discount, F.lit(0.0)) + discount * d * below) / c)

    # Of the top order too: both classes back off to what they have in common.
    both = smoothed(F.col("n1") + F.col("n0"), F.col("c1") + F.col("c0"), F.col("d"), F.coalesce("p", F.lit(FLOOR)))
    likelihood = [smoothed(F.col(f"n{y}"), F.col(f"c{y}"), F.col(f"d{y}"), F.col("both")) for y in (0, 1)]
    grams = shared.withColumn("both", both).select(F.lit(SEEN).alias("kind"), "gram", F.log(likelihood[1] / likelihood[0]).alias("ratio"))
    weight = [F.when(F.col(f"c{y}") > 0, discount * F.col(f"d{y}") / F.col(f"c{y}")).otherwise(1.0) for y in (0, 1)]
    return grams.unionByName(contexts.select(F.lit(CONTEXT).alias("kind"), F.col("context").alias("gram"), F.log(weight[1] / weight[0]).alias("ratio")))


def _letters(text: str) -> np.ndarray:
    return mixed(np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(_U) + _U(1))


def hashed(table: DataFrame) -> DataFrame:
    """(key, ratio) of the model's table: a hash of kind and gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_pylist()
            ends = np.cumsum([len(g) for g in grams], dtype=np.int64)
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            keys = sequence_hashes(_letters("".join(grams)), starts, ends) if len(ends) else np.zeros(0, _U)
            yield pa.RecordBatch.from_arrays([pa.array(mixed(keys + batch.column(0).to_numpy().astype(_U)).view(np.int64)), batch.column(2).cast(pa.float32())], names=["key", "ratio"])

    return table.mapInArrow(run, "key bigint, ratio float")


@dataclass
class Model:
    """A model's entries in the order of their keys (as unsigned numbers)."""

    keys: np.ndarray
    ratios: np.ndarray

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratios, and which keys are there at all."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ratios[at], 0.0), known


def collected(table: DataFrame) -> Model:
    """The model of a table of at most MODEL_LIMIT entries."""
    rows = hashed(table).toArrow()
    keys = rows["key"].to_numpy().view(_U)
    order = np.argsort(keys)
    return Model(keys[order], rows["ratio"].to_numpy()[order])


def word_keys(words: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character of the words (marks included, but for the first) the key of its gram and of
    the gram's context, and where each word's begin."""
    marked = [f"^{w}$" for w in words]
    length = np.array([len(m) for m in marked], dtype=np.int64)
    begin = np.cumsum(length) - length
    count = length - 1
    first = np.cumsum(count) - count
    end = np.repeat(begin - first, count) + np.arange(count.sum()) + 2
    start = np.maximum(end - order, np.repeat(begin, count))
    letters = _letters("".join(marked))
    return mixed(sequence_hashes(letters, start, end) + _U(SEEN)), mixed(sequence_hashes(letters, start, end - 1) + _U(CONTEXT)), first


class Scorer:
    """Log ratios of words; keeps those of words it has seen."""

    def __init__(self, model: Model, order: int = ORDER) -> None:
        self.model, self.order, self.known = model, order, {}

    def words(self, words: list[str]) -> np.ndarray:
        """The log ratio of each word: of its grams, and by the backoff weights of those unseen."""
        if not words:
            return np.zeros(0)
        grams, contexts, first = word_keys(words, self.order)
        ratio, seen = self.model.get(grams)
        ratio[~seen] = self.model.get(contexts[~seen])[0]
        return np.add.reduceat(ratio, first)

    def texts(self, texts: list[str | None]) -> list[tuple[float, float, float]]:
        """Mean, peak and length of each text."""
        split = [_WORD.findall((t or "").lower()) for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
            new = {w for words in split for w in words}
        fresh = sorted(new)
        self.known.update(zip(fresh, self.words(fresh).tolist(), strict=True))
        return [summary(np.array([self.known[w] for w in words])) for words in split]


def summary(ratios: np.ndarray) -> tuple[float, float, float]:
    """The mean of words' ratios, the largest sum of WINDOW words, as a mean (a shorter text's words
    count as a window with as much of nothing), and the logarithm of the number of words."""
    if not len(ratios):
        return 0.0, 0.0, 0.0
    total = np.concatenate([[0.0], np.cumsum(ratios)])
    size = min(WINDOW, len(ratios))
    return float(total[-1] / len(ratios)), float((total[size:] - total[:-size]).max() / WINDOW), float(np.log1p(len(ratios)))


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve with an intercept, by Newton's method with a small ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w)), a.T @ (y - p) - 1e-3 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def features(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns and FEATURES of the text's log ratios, by a model in memory."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                found = scorer.texts(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array([x[k] for x in found], pa.float64()) for k in range(3))], names=[*keep, *FEATURES])

    return docs.select(*keep, "text").mapInArrow(run, f"{types}, mean double, peak double, length double")


def features_by_joins(docs: DataFrame, table: DataFrame, keep: list[str]) -> DataFrame:
    """The same by joins: words meet the model's table, then texts their words."""
    model = hashed(table)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_WORD.findall((t or "").lower()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], names=["at", "words"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            grams, contexts, first = word_keys(words) if words else (np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))
            of = np.repeat(np.arange(len(words)), np.diff(np.append(first, len(grams))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(grams.view(np.int64)), pa.array(contexts.view(np.int64))], names=["word", "gram", "context"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [summary(np.array(x.as_py() or [], dtype=float)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], pa.float64()) for k in range(3))], names=["at", *FEATURES])

    rows = written(docs.select(*keep, "text").withColumn("at", F.monotonically_increasing_id()), "texts")
    words = rows.select("at", "text").mapInArrow(split, "at bigint, words array<string>").select("at", F.posexplode("words").alias("place", "word"))
    entries = words.select("word").distinct().mapInArrow(keyed, "word string, gram bigint, context bigint")
    met = entries.join(model.select(F.col("key").alias("gram"), F.col("ratio").alias("own")), "gram", "left").join(model.select(F.col("key").alias("context"), F.col("ratio").alias("backoff")), "context", "left")
    ratios = met.groupBy("word").agg(F.sum(F.coalesce(F.col("own"), F.col("backoff"), F.lit(0.0)).cast("double")).alias("ratio"))
    placed = words.join(ratios, "word").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("place", "ratio"))).alias("all"))
    sums = placed.select("at", F.col("all.ratio").alias("ratios")).mapInArrow(summed, "at bigint, mean double, peak double, length double")
    return rows.join(sums, "at", "left").select(*keep, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES))


def fitted(docs: DataFrame, labels: DataFrame, limit: int = MODEL_LIMIT) -> tuple[Model | DataFrame, np.ndarray]:
    """The model (in memory, or as its table beyond the limit) and the curve, from the labelled rows
    that are not held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = labels.where("toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(remainder(F.col("doc_id")) != 2)
    # Joined the same way at every size: labels grow with the corpus.
    counted = known.where(remainder(F.col("doc_id")) < 2).hint("merge")
    words = word_counts(texts.where(remainder(F.col("doc_id")) < 2).join(counted, "doc_id"))
    table = written(gram_ratios(written(words, "words")), "model")
    model = collected(table) if table.count() <= limit else table
    sample = known.where(remainder(F.col("doc_id")) == 3).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    fit_on = texts.where(remainder(F.col("doc_id")) == 3).join(F.broadcast(sample), "doc_id")
    rows = _features(fit_on, model, ["toxic"]).toPandas()
    if rows["toxic"].nunique() < 2:
        return model, np.zeros(1 + len(FEATURES))
    return model, _fit(rows[list(FEATURES)].to_numpy(), rows["toxic"].to_numpy(dtype=float))


def _features(docs: DataFrame, model: Model | DataFrame, keep: list[str]) -> DataFrame:
    return features(docs, model, keep) if isinstance(model, Model) else features_by_joins(docs, model, keep)


def scored(docs: DataFrame, model: Model | DataFrame, curve: np.ndarray) -> DataFrame:
    """doc_id, held_out, score, predicted, and what the score is made of."""
    w = [float(x) for x in curve]
    rows = _features(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, ["doc_id"])
    score = 1 / (1 + F.exp(-sum((x * F.col(c) for x, c in zip(w[1:], FEATURES, strict=True)), F.lit(w[0]))))
    return rows.select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), *FEATURES)


def op9_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, then what the score is made of."""
    return scored(docs, *fitted(docs, labels))
