"""Language-model scores from a log-frequency Bloom filter.

N-gram counts of the whole corpus are quantised to 1 + floor(log_b count) and
an n-gram enters the filter once for each level up to its own, so a count is
read off by probing level after level until a probe fails.  Every n-gram has
its home in one segment of the filter, which has ``BITS_A_TOKEN`` bits a
training token, however large the corpus is.

No place holds the whole filter.  Texts are dealt into units of about
``TOKENS_AT_ONCE`` tokens, written as places in a list of the unit's words.  A
unit sends its distinct n-grams, with their counts in training texts, to their
segments; the task that holds a segment fills it from all units, reads every
n-gram sent to it, and returns the levels to the units, which are then scored.
With them come the exact counts of single words, for the base scores.

Probabilities mix the word pair with the single word:
(c(v w) + WEIGHT * p(w)) / (c(v) + WEIGHT), p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh64_intdigest

from tillwise.llm.arrow import bounded, give_back, pieces, texts
from tillwise.scratch import materialize

#: The end of a text, a token like any word, and what stands before its first; no word has a blank.
END, START = b" end", b" start"
BASE = 1.5
HASHES = 3
#: Segments of the filter at least, and training tokens of a segment at most.
SEGMENTS, SEGMENT_TOKENS = 4096, 1 << 21
BITS_A_TOKEN = 5
WEIGHT = 100.0
#: Tokens whose counts are added up before they are sent on.
TOKENS_AT_ONCE = 1 << 22
#: Keys of whole segments that are filled and read at once.
KEYS_AT_ONCE = 1 << 20
U = np.uint64


class Hasher(dict):
    """Hash of a word, kept for the most recent words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


def tokens(text: str, hasher: Hasher) -> np.ndarray:
    """Hashes of the words of a text, A-Z in lower case, and of the end."""
    words = text.encode("utf-8", "replace").lower().split()
    words.append(END)
    return np.fromiter(map(hasher.__getitem__, words), U, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of a word pair; single words are their own keys."""
    return mixed(before * U(0x9E3779B97F4A7C15) + word + U(1))


def level(count: np.ndarray) -> np.ndarray:
    """1 + floor(log_b count) of positive counts."""
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of_level(most: int = 120) -> np.ndarray:
    """The middle of the whole counts of each level, 0 for none."""
    edge = BASE ** np.arange(most + 1)
    low, high = np.ceil(edge[:-1] - 1e-9), np.ceil(edge[1:] - 1e-9) - 1
    return np.concatenate([[0.0], np.where(high >= low, (low + high) / 2, edge[:-1] * BASE**0.5)])


class Filter:
    """The segments of a filter for ``total`` tokens, ``width`` bits in each."""

    def __init__(self, total: int) -> None:
        self.segments = SEGMENTS
        while self.segments * SEGMENT_TOKENS < total:
            self.segments *= 2
        self.width = -(-max(1 << 20, total * BITS_A_TOKEN) // self.segments // 64) * 64
        self.held = np.zeros(0, dtype=np.int64)
        self.bits = np.zeros(0, dtype=bool)

    def home(self, key: np.ndarray) -> np.ndarray:
        """The segment of a key; it rises with the key."""
        return (((key >> U(32)) * U(self.segments)) >> U(32)).astype(np.int64)

    def start(self, key: np.ndarray) -> np.ndarray:
        """Where the segment of each key begins among the segments held."""
        return np.searchsorted(self.held, self.home(key)) * self.width

    def places(self, key: np.ndarray, j: np.ndarray | int, i: int) -> np.ndarray:
        """Bit of hash ``i`` at level ``j``, inside the segment."""
        h = mixed(key + U(0x9E3779B97F4A7C15) * np.asarray(j).astype(U))
        low, high = h & U(0xFFFFFFFF), (h >> U(32)) | U(1)
        return ((((low + U(i) * high) & U(0xFFFFFFFF)) * U(self.width)) >> U(32)).astype(np.int64)

    def fill(self, keys: np.ndarray, n: np.ndarray, held: np.ndarray) -> None:
        """Hold the segments ``held`` (ascending), filled with all their keys and positive counts."""
        self.held, self.bits = held, np.zeros(len(held) * self.width, dtype=bool)
        start, levels = self.start(keys), level(n)
        own = np.arange(len(keys))
        j = 1
        while len(own):
            for i in range(HASHES):
                self.bits[start[own] + self.places(keys[own], j, i)] = True
            j += 1
            own = own[levels[own] >= j]

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key of the segments held: probes go on until one fails."""
        out = np.zeros(len(keys), dtype=np.int64)
        open_ = np.arange(len(keys))
        start = self.start(keys)
        for j in range(1, 120):
            if not len(open_):
                break
            for i in range(HASHES):
                open_ = open_[self.bits[start[open_] + self.places(keys[open_], j, i)]]
            out[open_] = j
        return out


def train_counts(batches: Iterator[pa.RecordBatch], pairs: bool, text: str) -> Iterator[pa.RecordBatch]:
    """(key, n) of single words, or of words, pairs and the start, added up over many texts."""
    hasher = Hasher()
    start = U(xxh64_intdigest(START))
    held: list[np.ndarray] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        for a in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_pydict({"key": keys[a : a + (1 << 16)].view(np.int64), "n": n[a : a + (1 << 16)]})

    for whole in batches:
        for batch in pieces(whole):
            for t in texts(batch, text):
                h = tokens(t, hasher)
                held.append(h)
                if pairs:
                    before = np.concatenate([[start], h[:-1]])
                    held += [pair(before, h), before[:1]]
                size += len(h)
            if size >= TOKENS_AT_ONCE:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def word_counts(corpus: DataFrame, text: str = "text") -> DataFrame:
    """(key, n): how often every token occurs in all texts."""
    partial = corpus.select(text).mapInArrow(lambda b: train_counts(b, False, text), "key long, n long")
    return partial.groupBy("key").agg(F.sum("n").alias("n"))


def build(corpus: DataFrame, total: int, text: str = "text") -> Filter:
    """The filter of a corpus of ``total`` tokens in one place, for corpora that this process can hold."""
    partial = corpus.select(text).mapInArrow(lambda b: train_counts(b, True, text), "key long, n long")
    got = partial.groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    made = Filter(total)
    made.fill(got.column("key").to_numpy().view(U), got.column("n").to_numpy(), np.arange(made.segments))
    return made


def planes(values: np.ndarray) -> bytes:
    """Whole numbers below 2**32 byte by byte: first the lowest byte of all, and so on, which packs well."""
    return pa.compress(values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def from_planes(data: bytes, size: int) -> np.ndarray:
    plain = pa.decompress(data, 4 * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(4, size).T).view("<u4").ravel()


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binaries of runs of the values; ``ends`` begins with 0."""
    offsets = (ends * values.itemsize * (values.shape[1] if values.ndim > 1 else 1)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of binaries side by side, and how many are in each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), kind), np.diff(offsets) // np.dtype(kind).itemsize


class Unit:
    """Texts side by side: the hashes of their words, and the tokens as places among them."""

    FIELDS = "unit long, rows binary, sizes binary, learned binary, words binary, places binary"

    def __init__(self, row: dict) -> None:
        self.rows = np.frombuffer(row["rows"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.learned = np.frombuffer(row["learned"], bool)
        self.words = np.frombuffer(row["words"], U)
        self.places = from_planes(row["places"], int(self.sizes.sum()))
        self.start = U(xxh64_intdigest(START))
        self.first = np.cumsum(self.sizes) - self.sizes
        all_ = self.words[self.places]
        before = np.concatenate([[self.start], all_[:-1]])
        before[self.first] = self.start
        self.pairs = pair(before, all_)

    @staticmethod
    def pack(rows: list[int], learned: list[bool], found: list[np.ndarray]) -> dict:
        words, place, times = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(words), dtype=np.uint32)
        rank[order] = np.arange(len(words))
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        return {
            "unit": rows[0],
            "rows": np.array(rows, dtype=np.int64).tobytes(),
            "sizes": sizes.tobytes(),
            "learned": np.array(learned, dtype=bool).tobytes(),
            "words": words[order].tobytes(),
            "places": planes(rank[place]),
        }

    def keys(self) -> np.ndarray:
        """All distinct n-grams and the start, ascending."""
        return np.unique(np.concatenate([self.words, self.pairs, [self.start]]))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """How often each key occurs in training texts."""
        n = np.zeros(len(keys), dtype=np.int64)
        learned = np.repeat(self.learned, self.sizes)
        n[np.searchsorted(keys, self.words)] += np.bincount(self.places[learned], minlength=len(self.words))
        pairs, times = np.unique(self.pairs[learned], return_counts=True)
        n[np.searchsorted(keys, pairs)] += times
        n[np.searchsorted(keys, self.start)] += np.count_nonzero(self.learned)
        return n

    def scores(self, keys: np.ndarray, count: np.ndarray, exact: np.ndarray, total: int, mass: float) -> dict:
        """The scores of each text, given the counts read for ``keys`` and the exact ones of the words, ascending."""
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        n = np.empty_like(exact)
        n[np.argsort(self.words)] = exact
        base = np.log10((n + 0.5) / mass)[self.places]
        single = count[np.searchsorted(keys, self.words)][self.places]
        context = np.concatenate([[0.0], single[:-1]])
        context[self.first] = count[np.searchsorted(keys, self.start)]
        joint = np.minimum(count[np.searchsorted(keys, self.pairs)], context)
        p = (joint + WEIGHT * ((single + 0.5) / mass)) / (context + WEIGHT)
        return {
            "_row": self.rows,
            "n_known": np.bincount(of, (n > 0)[self.places], minlength=len(self.sizes)).astype(np.int64),
            "base_score": np.bincount(of, base, minlength=len(self.sizes)),
            "score": np.bincount(of, np.log10(p), minlength=len(self.sizes)),
        }


def sent_keys(keys: np.ndarray, n: np.ndarray, is_word: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    """Runs of ascending keys and their counts in few bytes: ``high`` repeats, ``more`` has the counts above 126."""
    many = n > 126
    small = np.where(many, 127, n).astype(np.uint8) | (is_word.astype(np.uint8) << 7)
    more_ends = np.append(0, np.cumsum(many))[ends]
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    high = (keys >> U(48)).astype("<u2")
    return [lists(high, ends), lists(low, ends), lists(small, ends), lists(n[many], more_ends)]


def got_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``sent_keys`` packed, all runs side by side, and the length of each run."""
    high, sizes = flat(batch.column("high"), np.uint16)
    low, _ = flat(batch.column("low"), np.uint8)
    small, _ = flat(batch.column("small"), np.uint8)
    whole = np.zeros((len(high), 8), dtype=np.uint8)
    whole[:, :6] = low.reshape(-1, 6)
    n = (small & 127).astype(np.int64)
    n[n == 127], _ = flat(batch.column("more"), np.int64)
    return whole.view("<u8").ravel() | (high.astype(U) << U(48)), n, small > 127, sizes


def model_scores(units: DataFrame, total: int, mass: float) -> DataFrame:
    """Scores of all texts of the written units, by the filter and the words of their training texts."""
    made = Filter(total)
    at_once = KEYS_AT_ONCE
    fields = Unit.FIELDS.split(", ")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                unit = Unit(row)
                keys = unit.keys()
                n = unit.counts(keys)
                is_word = np.zeros(len(keys), dtype=bool)
                is_word[np.searchsorted(keys, unit.words)] = True
                del unit
                home, at = np.unique(made.home(keys), return_index=True)
                ends = np.append(at, len(keys))
                for a in range(0, len(home), 512):
                    b = min(a + 512, len(home))
                    cut, own = slice(ends[a], ends[b]), ends[a : b + 1] - ends[a]
                    packed = sent_keys(keys[cut], n[cut], is_word[cut], own)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(home[a:b]), pa.array(np.full(b - a, row["unit"])), *packed],
                        names=["segment", "unit", "high", "low", "small", "more"],
                    )
        give_back()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fill the segments of a task, a few at a time, and read all keys sent to them."""
        held: list[pa.RecordBatch] = []
        size, last = 0, -1

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            for whole in table.to_batches():
                keys, n, is_word, sizes = got_keys(whole)
                distinct, place = np.unique(keys, return_inverse=True)
                sums = np.bincount(place, n, minlength=len(distinct)).astype(np.int64)
                known = sums > 0
                made.fill(distinct[known], sums[known], np.unique(made.home(distinct)))
                levels = made.read(distinct).astype(np.uint8)[place]
                ends = np.append(0, np.cumsum(sizes))
                exact = lists(sums[place[is_word]], np.append(0, np.cumsum(is_word))[ends])
                columns = [whole.column("unit"), whole.column("segment"), lists(levels, ends), exact]
                answered = pa.RecordBatch.from_arrays(columns, names=["unit", "segment", "levels", "exact"])
                for a in range(0, answered.num_rows, 4096):
                    yield answered.slice(a, 4096)

        for batch in batches:
            if not batch.num_rows:
                continue
            segments = batch.column("segment").to_numpy()
            if size >= at_once and segments[-1] != last:
                cut = int(np.searchsorted(segments, segments[-1]))
                held.append(batch.slice(0, cut))
                yield from out()
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += batch.column("small").nbytes
            last = segments[-1]
        if held:
            yield from out()
        give_back()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A unit comes first, its levels follow in the order of its keys."""
        counts = np.minimum(count_of_level(), total)
        unit: Unit | None = None
        levels: list[bytes] = []
        words: list[bytes] = []

        def out() -> pa.RecordBatch:
            read, exact = np.frombuffer(b"".join(levels), np.uint8), np.frombuffer(b"".join(words), np.int64)
            return pa.RecordBatch.from_pydict(unit.scores(unit.keys(), counts[read], exact, total, mass))

        for batch in batches:
            segments = batch.column("segment").to_pylist()
            for i, segment in enumerate(segments):
                if segment < 0:
                    if unit is not None:
                        yield out()
                    unit, levels, words = Unit(batch.slice(i, 1).to_pylist()[0]), [], []
                else:
                    levels.append(batch.column("levels")[i].as_py())
                    words.append(batch.column("exact")[i].as_py())
        if unit is not None:
            yield out()
        give_back()

    read = (
        units.mapInArrow(send, "segment long, unit long, high binary, low binary, small binary, more binary")
        .repartition("segment")
        .sortWithinPartitions("segment")
        .mapInArrow(answer, "unit long, segment long, levels binary, exact binary")
    )
    none = F.lit(None).cast("binary")
    first = units.select("*", F.lit(-1).cast("bigint").alias("segment"), none.alias("levels"), none.alias("exact"))
    empty = [none.alias(f.split()[0]) for f in fields[1:]]
    met = first.unionByName(read.select("unit", *empty, "segment", "levels", "exact"))
    scored = met.repartition("unit").sortWithinPartitions("unit", "segment")
    return scored.mapInArrow(score, "_row long, n_known long, base_score double, score double")


def assess(
    documents: DataFrame, learns: Column, text: str = "text", doc_id: str = "doc_id", frequent: int | None = None
) -> DataFrame:
    """Scores of every whole text (null: empty) by a model of the texts for which ``learns`` holds.

    ``base_score`` uses exact counts, which come from the segments like the
    levels; ``frequent`` is accepted as before and changes nothing.  Without a
    training text all counts are zero.
    """
    corpus = bounded(documents).where(learns).select(F.col(text).alias("text"))
    total, distinct = word_counts(corpus).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    mass = total + 0.5 * (distinct + 1)
    rows = documents.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(doc_id).alias("doc_id"),
        (~F.coalesce(learns, F.lit(True))).alias("held_out"),
        F.coalesce(learns, F.lit(False)).alias("learned"),
        F.col(text).alias("text"),
    )
    kept = ["_row", "doc_id", "held_out"]
    added = T._parse_datatype_string(f"n_tokens long, {Unit.FIELDS}")
    out = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in kept), *added.fields])
    types = to_arrow_schema(out)
    at_once = TOKENS_AT_ONCE

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each unit of texts."""
        hasher = Hasher()
        ids: list[int] = []
        learned: list[bool] = []
        held: list[np.ndarray] = []
        size = 0
        for whole in batches:
            for batch in pieces(whole):
                found = [tokens(t, hasher) for t in texts(batch, "text")]
                sizes = pa.array([len(f) for f in found], pa.int64())
                own = [*(batch.column(c) for c in kept), sizes]
                none = [pa.nulls(batch.num_rows, f.type) for f in list(types)[len(own) :]]
                yield pa.RecordBatch.from_arrays([*own, *none], schema=types)
                ids += batch.column("_row").to_pylist()
                learned += batch.column("learned").to_pylist()
                held += found
                size += sum(map(len, found))
                if size >= at_once:
                    yield pa.RecordBatch.from_pylist([Unit.pack(ids, learned, held)], schema=types)
                    ids, learned, held, size = [], [], [], 0
        if held:
            yield pa.RecordBatch.from_pylist([Unit.pack(ids, learned, held)], schema=types)
        give_back()

    written = materialize(bounded(rows).mapInArrow(dealt, out), "scored")
    units = written.where("unit IS NOT NULL").select([f.split()[0] for f in Unit.FIELDS.split(", ")])
    scores = model_scores(units, total, mass)
    return written.where("unit IS NULL").join(scores, "_row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
    )


def evaluate(documents: DataFrame, fold: int = 1, folds: int = 5) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(id) modulo ``folds`` is not ``fold``.

    A row without an id is learned from and not held out.
    """
    remainder = F.crc32(F.col("doc_id").cast("string")) % folds
    return assess(documents, F.coalesce(remainder != fold, F.lit(True)))
