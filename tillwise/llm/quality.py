"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal.

A model is fitted on a bounded sample of the labelled texts, the ``SAMPLE_ROWS``
ids with the smallest hash, whatever the size of the corpus.  One task runs
follow-the-regularised-leader updates over their n-grams, and a table of
2**``BITS`` weights goes to the workers.  A score is the sparse dot product of
the n-gram shares of a text and the weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrow import bounded, give_back, texts, with_columns

BITS = 18
#: At most so many labelled texts are learned from.
SAMPLE_ROWS = 8_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-3
#: Two more inputs after the hashed ones: a constant, and the share of repeated words.
EXTRA = 2
#: Words of a text that are turned into n-grams at once.
WORDS_AT_ONCE = 1 << 20


def counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots and shares of the one- and two-word n-grams of a whole text, each sum of shares being one."""
    words = text.encode("utf-8", "replace").split()
    slots = np.array([1 << bits], dtype=np.int64)
    shares = np.array([1.0])
    if not words:
        return slots, shares
    total = np.zeros(1 << bits) if len(words) > WORDS_AT_ONCE else None
    seen = set()
    mask = np.uint64((1 << bits) - 1)
    last = None
    for at in range(0, len(words), WORDS_AT_ONCE):
        piece = words[at : at + WORDS_AT_ONCE]
        seen.update(piece)
        h = np.fromiter(map(zlib.crc32, piece), np.uint64, len(piece))
        if last is not None:
            h = np.concatenate([last, h])
        two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
        one = (h if last is None else h[1:]) & mask
        last = h[-1:]
        grams = np.concatenate([one, two]).astype(np.int64)
        if total is not None:
            total += np.bincount(grams, minlength=1 << bits)
    if total is not None:
        found = np.flatnonzero(total)
        n = total[found]
    else:
        found, n = np.unique(grams, return_counts=True)
    repeated = 1.0 - len(seen) / len(words)
    return (
        np.concatenate([found, slots, slots + 1]),
        np.concatenate([np.sqrt(n / n.sum()), shares, [repeated]]),
    )


class Ftrl:
    """Follow the regularised leader with a learning rate for each weight."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


def learn(rows: Sequence[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights after ``EPOCHS`` passes over (slots, shares, label)."""
    model = Ftrl((1 << BITS) + EXTRA)
    for _ in range(EPOCHS):
        for at, x, y in rows:
            model.learn(at, x.astype(np.float64), y)
    return model.weights(slice(None))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights that are not zero, from the rows of one task in their order."""
    rows = []
    for batch in batches:
        for text, y in zip(texts(batch, "text"), batch.column("y").to_pylist(), strict=True):
            at, x = counts(text)
            rows.append((at.astype(np.int32), x.astype(np.float32), y))
    if rows:
        w = learn(rows)
        used = np.flatnonzero(w)
        del rows
        yield pa.RecordBatch.from_pydict({"slot": used, "weight": w[used]})
    give_back()


def fit(
    documents: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> np.ndarray:
    """Weights learned from the labelled documents for which ``learn_from`` (of the id) holds.

    Labels other than 0 and 1 and rows without an id are skipped, an id with
    several labels counts as 0 if one of them is, and an id with several texts
    is learned from the smallest.  Without a labelled row all weights are 0.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.min(label).cast("int").alias("y"))
    )
    if learn_from is not None:
        known = known.where(learn_from)
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = (
        bounded(documents).select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "_id")
        .groupBy("_id", "y")
        .agg(F.min("text").alias("text"))
        .withColumn("place", F.xxhash64(F.lit(7), "_id"))
    )
    got = (
        rows.repartition(1)
        .sortWithinPartitions("place", "_id")
        .select("text", "y")
        .mapInArrow(_fit, "slot long, weight double")
        .toArrow()
    )
    model = np.zeros((1 << BITS) + EXTRA, dtype=np.float32)
    model[got.column("slot").to_numpy()] = got.column("weight").to_numpy()
    return model


def score(docs: DataFrame, model: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text; null counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        weights = sent.value

        def work(batch: pa.RecordBatch):
            found = []
            for t in texts(batch, text):
                at, x = counts(t)
                found.append(sigmoid(float(weights[at] @ x)))
            return [found]

        return work

    return with_columns(docs, [(out, "double")], make)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % of


def rate(documents: DataFrame, labels: DataFrame, fold: int = 2, folds: int = 4, least: float = 0.7) -> DataFrame:
    """Score every document with a model that has not seen the labels of the held-out fold.

    A row without an id is not held out.  Repeated rows get the same score.
    """
    model = fit(documents, labels, remainder(F.col("_id"), folds) != fold)
    rows = documents.select(
        "doc_id", F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False)).alias("held_out"), "text"
    )
    return score(rows, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted")
    )
