"""Importance resampling towards a target text, by hashed word and word-pair features.

A feature is a word or two consecutive words, its bucket the CRC-32 of its
bytes.  How much more often a bucket comes in the target than in the documents
is its gain; the mean gain of a document's features is its weight, and Gumbel
noise seeded by the id turns the highest weights into a draw without
replacement.

Words follow a head-tail vocabulary.  The most frequent words of all documents
are known to the workers with the CRC state after them, and of the pairs of the
first thousand of them the most frequent ones with their buckets.  All other
features take the CRC of their bytes, which for a pair goes on from the state
of its first word.  Both ways give the same bucket, so that the size of the
head changes the speed alone, and both feed the totals of all buckets.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrow import bounded, give_back, pieces
from tillwise.llm.tallies import tally
from tillwise.llm.words import letters, words
from tillwise.operators.ranking import global_rank
from tillwise.scratch import materialize

BUCKETS = 10_000
PERCENT, LEAST_WORDS, SEED = 25, 20, 7
#: Words of the head and the bytes such a word has at most, words whose pairs are counted, pairs of the head.
HEAD, HEAD_BYTES, PAIRED, PAIRS = 16_384, 64, 1_024, 65_536
SHARE = 32_768
#: Words whose counts a task keeps before it passes them on.
KEPT = 100_000

#: A word is a run of digits, letters and whatever is not ASCII; A-Z become small.
TABLE = letters(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


class Places(dict[bytes, int]):
    """Places of the words of the head; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Head:
    """Frequent words with their CRC states, and buckets of frequent pairs of the first of them (-1: not known)."""

    words: list[bytes] = field(default_factory=list)
    pairs: np.ndarray | None = None
    buckets: int = BUCKETS

    def __post_init__(self) -> None:
        self.places = Places((w, i) for i, w in enumerate(self.words))
        # The last place serves words that are not in the head.
        self.states = np.array([*map(zlib.crc32, self.words), 0], dtype=np.int64)
        side = min(PAIRED, len(self.words))
        self.table = np.full((side + 1, side + 1), -1, dtype=np.int32)
        if self.pairs is not None:
            for a, b in np.stack(np.divmod(self.pairs, PAIRED), axis=1).tolist():
                self.table[a, b] = zlib.crc32(b" " + self.words[b], int(self.states[a])) % self.buckets

    def at(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, found), np.int64, len(found))

    def features(self, text: bytes) -> Iterator[np.ndarray]:
        """Buckets of the features of a text, a bounded piece after the other."""
        before: list[bytes] = []
        for more in words(text, TABLE):
            found = before + more
            at = self.at(found)
            states = self.states[at]
            tail = np.flatnonzero(at < 0)
            if len(tail):
                states[tail] = [zlib.crc32(found[i]) for i in tail.tolist()]
            yield states[len(before) :] % self.buckets
            near = np.minimum(np.where(at < 0, len(self.words), at), len(self.table) - 1)
            pairs = self.table[near[:-1], near[1:]]
            tail = np.flatnonzero(pairs < 0)
            if len(tail):
                first = states[tail].tolist()
                pairs[tail] = [
                    zlib.crc32(b" " + found[i + 1], s) % self.buckets for i, s in zip(tail.tolist(), first, strict=True)
                ]
            yield pairs
            before = found[-1:]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("_text").cast(pa.binary()).to_pylist()]


def head(texts: DataFrame, buckets: int = BUCKETS, size: int = HEAD, pairs: int = PAIRS) -> Head:
    """The most frequent words and pairs of the column ``_text``, counted over all rows.

    A word of the head makes up at least one in ``SHARE`` of all words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            some = {w: n for w, n in counts.items() if len(w) <= HEAD_BYTES}
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(some.keys(), pa.binary()), pa.array(some.values(), pa.int64())], names=["word", "n"]
            )

        for whole in batches:
            for batch in pieces(whole):
                for text in _texts(batch):
                    for found in words(text, TABLE):
                        counts.update(found)
                        if len(counts) > KEPT:
                            yield out()
        yield out()
        give_back()

    each = bounded(texts).mapInArrow(count, "word binary, n long")
    counted = materialize(each.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Not more than SHARE words of at most 64 bytes make up one in SHARE of all words.
    often = counted.where(F.col("n") * SHARE >= total).collect()
    often.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    frequent = Head([bytes(r["word"]) for r in often[:size]], None, buckets)
    if not frequent.words or not pairs:
        return frequent
    known = texts.sparkSession.sparkContext.broadcast(frequent)

    def add(counts: np.ndarray, batch: pa.RecordBatch) -> None:
        codes = []
        for text in _texts(batch):
            last = -1
            for found in words(text, TABLE):
                at = np.concatenate([[last], known.value.at(found)])
                a, b = at[:-1], at[1:]
                both = (a >= 0) & (b >= 0) & (a < PAIRED) & (b < PAIRED)
                codes.append(a[both] * PAIRED + b[both])
                last = int(at[-1])
        if codes:
            np.add.at(counts, np.concatenate(codes), 1)

    counts = tally(texts, PAIRED * PAIRED, add)
    known.unpersist()
    some = np.flatnonzero(counts)
    return Head(frequent.words, some[np.argsort(-counts[some], kind="stable")[:pairs]], buckets)


def totals(texts: DataFrame, known, buckets: int) -> np.ndarray:
    """Features of the column ``_text`` by bucket; ``known`` is a broadcast head."""

    def add(counts: np.ndarray, batch: pa.RecordBatch) -> None:
        for text in _texts(batch):
            for some in known.value.features(text):
                counts += np.bincount(some, minlength=buckets)

    return tally(texts, buckets, add)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of the shares) of each bucket."""
    n = len(source)
    s, t = float(source.sum()) + n, float(target.sum()) + n
    ratio = (target + 1.0) * s / ((source + 1.0) * t)
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise of a document in thousandths; a null id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    seed: int = SEED, buckets: int = BUCKETS, size: int = HEAD, pairs: int = PAIRS,
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every row; null texts have no words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    aim = target.select(F.col(target_text).alias("_text"))
    known = spark.sparkContext.broadcast(head(rows.select("_text"), buckets, size, pairs))
    gain = gains(totals(rows.select("_text"), known, buckets), totals(aim, known, buckets))
    sent = spark.sparkContext.broadcast(gain)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for whole in batches:
            for batch in pieces(whole):
                out: list[list[int]] = [[], [], [], []]
                for own, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                    sizes, total = [], 0
                    for some in known.value.features(text):
                        sizes.append(len(some))
                        total += int(gain[some].sum())
                    n = sum(sizes)
                    weight = total // n if n else 0
                    for column, value in zip(out, (sum(sizes[::2]), n, weight, weight + noise(own, seed)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in out]],
                    names=["doc_id", "n_words", "n_features", "weight", "score"],
                )
        give_back()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return bounded(rows).mapInArrow(rate, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS,
) -> DataFrame:
    """Every row's ``doc_id``, ``n_features``, ``weight`` and ``score``, with its ``rank`` if it is drawn.

    ``percent`` of the rows with at least ``least_words`` words are drawn
    (rounded down), those with the highest scores, ties to the smaller id, a
    null id last.  Repeated rows are drawn each for itself.  Without any text
    all features are unseen and weigh nothing.
    """
    weighed = materialize(weigh(docs, target, doc_id, text, target_text, seed, buckets), "weighed")
    long = F.col("n_words") >= least_words
    drawn = weighed.where(long).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight"]
    ranked = global_rank(weighed.where(long), *order, name="place")
    place = F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank")
    others = weighed.where(~long).withColumn("place", F.lit(None).cast("bigint"))
    return ranked.unionByName(others).select("doc_id", "n_features", "weight", "score", place)
