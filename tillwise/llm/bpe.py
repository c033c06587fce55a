"""Byte-pair encoding and decoding with segment trees.

For every word a segment tree over the ranks of adjacent pairs gives, at its
root, the leftmost merge of the lowest rank; a merge changes at most three
leaves, each with a walk to the root, until no pair can be merged.  The trees
of all new words of a batch with the same number of leaves are kept as rows
of one array and walked together; a long word has a tree of its own.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrow import texts, with_columns

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
NONE = np.int64(2**62)
#: Ids side by side in four bytes each: one object however many they are, and none that the collector follows.
Ids = bytes
#: Letters of the words, and of the white-space separated pieces, whose encoding a worker remembers at least.
REMEMBERED = 500_000
#: Leaves of a word from which on it is merged alone.
LONG = 256
#: Leaves of the trees that are walked together.
LEAVES_AT_ONCE = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Memory:
    """What was learnt about words, by age: when the younger half is full it becomes the older one, which goes."""

    def __init__(self) -> None:
        self.young: dict[str, Ids] = {}
        self.old: dict[str, Ids] = {}
        self.letters = 0

    def recall(self, wanted: set[str], learn: Callable[[list[str]], Iterable[Ids]]) -> dict[str, Ids]:
        """A table of all that is wanted; what is not remembered is learnt."""
        if self.letters > REMEMBERED:
            self.young, self.old, self.letters = {}, self.young, 0
        young, old = self.young, self.old
        new = []
        for w in wanted.difference(young):
            x = old.get(w)
            if x is None:
                new.append(w)
            else:
                young[w] = x
            self.letters += len(w)
        young.update(zip(new, learn(new), strict=True))
        return young


class WordBpe:
    """The tokenizer of a vocabulary file with word ends: NFC, lower case, words, bytes, merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocabulary | self.special).items()}
        letters = byte_letters()
        self.inside = np.array([self.vocabulary.get(c, -1) for c in letters], dtype=np.int64)
        self.last = np.array([self.vocabulary.get(c + self.suffix, -1) for c in letters], dtype=np.int64)
        pairs = np.array([[self.vocabulary[a], self.vocabulary[b]] for a, b in model["merges"]], dtype=np.int64)
        self.wide = np.int64(len(self.names) + 1)
        self.place(pairs[:, 0] * self.wide + pairs[:, 1])
        self.merged = np.array([self.vocabulary[a + b] for a, b in model["merges"]], dtype=np.int64)
        self.gaps = bool((self.inside < 0).any() or (self.last < 0).any())
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        white = r"\p{White_Space}"
        self.word = regex.compile(split["pattern"]["Regex"].replace(r"\s", white))
        self.blank = regex.compile(white + "+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.ranks = {code: rank for rank, code in reversed(list(enumerate((pairs[:, 0] * self.wide + pairs[:, 1]).tolist())))}
        # By id; none for numbers that are no id.
        self.named = [self.names.get(i) for i in range(max(self.names) + 1)]
        self.shown = [str(i) for i in range(len(self.named))]
        self.words, self.pieces = Memory(), Memory()

    def place(self, codes: np.ndarray) -> None:
        """A hash table from pair to rank; a search ends after the longest run of taken slots."""
        self.slots = 1 << (2 * len(codes)).bit_length()
        self.code = np.full(self.slots, -1, dtype=np.int64)
        self.of = np.full(self.slots, NONE, dtype=np.int64)
        self.longest = 1
        for rank, code in enumerate(codes.tolist()):
            at, steps = self.slot(code), 1
            while self.code[at] >= 0 and self.code[at] != code:
                at, steps = (at + 1) % self.slots, steps + 1
            if self.code[at] < 0:
                self.code[at], self.of[at] = code, rank
            self.longest = max(self.longest, steps)

    def slot(self, code):
        return (code ^ (code >> 13)) * 0x2545F491 % self.slots

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; NONE where it has no merge."""
        code = a * self.wide + b
        at = self.slot(code)
        found = self.code[at]
        out = np.where(found == code, self.of[at], NONE)
        open_ = np.flatnonzero((found != code) & (found >= 0))
        for _ in range(self.longest - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % self.slots
            found = self.code[at[open_]]
            hit = found == code[open_]
            out[open_[hit]] = self.of[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return np.where((a >= 0) & (b >= 0), out, NONE)

    def merge(self, symbol: np.ndarray, leaves: int) -> np.ndarray:
        """Merge words of at most ``leaves`` + 1 symbols, one in a row, -1 behind their end.

        ``leaves`` is a power of two; merged-away symbols become -1.
        """
        m, wide = symbol.shape
        symbol = symbol.ravel()
        after = np.tile(np.arange(1, wide + 1), m)
        before = np.tile(np.arange(-1, wide - 1), m)
        tree = np.full((m, 2 * leaves), NONE)

        def leaf(word: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
            r = self.rank(symbol[word + left], symbol[word + right])
            return np.where(r < NONE, r * leaves + left, NONE)

        start = np.arange(m) * wide
        for i in range(leaves):
            tree[:, leaves + i] = leaf(start, np.full(m, i), np.full(m, i + 1))
        for i in range(leaves - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        tree = tree.ravel()

        def put(root: np.ndarray, place: np.ndarray, value: np.ndarray | np.int64) -> None:
            node = place + leaves
            tree[root + node] = value
            for _ in range(leaves.bit_length() - 1):
                node = node >> 1
                pair = root + 2 * node
                tree[root + node] = np.minimum(tree[pair], tree[pair + 1])

        rows = np.flatnonzero(tree[1 :: 2 * leaves] < NONE)
        while len(rows):
            word, root = rows * wide, rows * (2 * leaves)
            rank, left = np.divmod(tree[root + 1], leaves)
            gone = after[word + left]
            right = np.minimum(after[word + gone], wide - 1)
            symbol[word + left] = self.merged[rank]
            symbol[word + gone] = -1
            after[word + left] = right
            before[word + right] = left
            inner = np.flatnonzero(gone < leaves)
            put(root[inner], gone[inner], NONE)
            put(root, left, leaf(word, left, right))
            prior = before[word + left]
            inner = np.flatnonzero(prior >= 0)
            put(root[inner], prior[inner], leaf(word[inner], prior[inner], left[inner]))
            rows = rows[tree[root + 1] < NONE]
        return symbol.reshape(m, wide)

    def merge_long(self, symbol: list[int]) -> list[int]:
        """Merge one long word: a tree of its own, whose walks end where nothing changes."""
        leaves = 1 << (len(symbol) - 2).bit_length()
        none, ranks, wide, merged = int(NONE), self.ranks, int(self.wide), self.merged
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        tree = [none] * (2 * leaves)

        def leaf(left: int, right: int) -> int:
            r = ranks.get(symbol[left] * wide + symbol[right])
            return none if r is None else r * leaves + left

        for i in range(len(symbol) - 1):
            tree[leaves + i] = leaf(i, i + 1)
        for i in range(leaves - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(place: int, value: int) -> None:
            node = place + leaves
            tree[node] = value
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                least = a if a < b else b
                if tree[node] == least:
                    return
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            rank, left = divmod(tree[1], leaves)
            gone = after[left]
            right = after[gone]
            symbol[left], symbol[gone] = int(merged[rank]), -1
            after[left] = right
            if gone < leaves:
                put(gone, none)
            if right < len(symbol):
                before[right] = left
                put(left, leaf(left, right))
            else:
                put(left, none)
            if before[left] >= 0:
                put(before[left], leaf(before[left], left))
        return [x for x in symbol if x >= 0]

    def learn_words(self, words: list[str]) -> list[Ids]:
        """Encode words, those with the same number of leaves together."""
        if not words:
            return []
        data = [w.encode("utf-8", "replace") for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        symbols = self.inside[flat]
        ends = np.cumsum(size) - 1
        symbols[ends] = self.last[flat[ends]]
        if self.gaps:
            size = np.add.reduceat((symbols >= 0).astype(np.int64), ends - size + 1)
            symbols = symbols[symbols >= 0]
        starts = np.cumsum(size) - size
        leaves = np.where(size > 1, 1 << np.ceil(np.log2(np.maximum(size - 1, 1))).astype(np.int64), 1)
        learnt: list[Ids] = [b""] * len(words)
        for n in np.unique(leaves).tolist():
            group = np.flatnonzero(leaves == n)
            if n >= LONG:
                for w in group.tolist():
                    learnt[w] = np.array(self.merge_long(symbols[starts[w] : starts[w] + size[w]].tolist()), dtype=np.int32).tobytes()
                continue
            step = max(1, LEAVES_AT_ONCE // n)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                grid = np.full((len(part), n + 2), -1, dtype=np.int64)
                row = np.repeat(np.arange(len(part)), size[part])
                column = np.arange(len(row)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
                grid[row, column] = symbols[np.repeat(starts[part], size[part]) + column]
                grid = self.merge(grid, n)
                kept = grid >= 0
                ids = grid[kept].astype(np.int32).tobytes()
                upto = (4 * np.cumsum(kept.sum(axis=1))).tolist()
                a = 0
                for w, b in zip(part.tolist(), upto, strict=True):
                    learnt[w] = ids[a:b]
                    a = b
        return learnt

    def split(self, text: str) -> list[str]:
        """White-space separated pieces of a text without special tokens; no word spans two."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # A final capital sigma becomes the ordinary small one, letter by letter.
        text = text.replace("Σ", "σ").lower()
        pieces = text.split()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            pieces = [p for p in self.blank.split(text) if p]
        return pieces

    def learn_pieces(self, pieces: list[str]) -> Iterable[Ids]:
        """Encode white-space separated pieces."""
        cut = [[p] if p.isalpha() else self.word.findall(p) for p in pieces]
        known = self.words.recall({w for words in cut for w in words}, self.learn_words)
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def encode(self, batch: Sequence[str]) -> list[list[int]]:
        """The ids of each text."""
        cut: list[list[str]] = []
        special: dict[str, Ids] = {}
        for text in batch:
            if "<|" in text:
                parts: list[str] = []
                for i, part in enumerate(self.cut.split(text)):
                    if i % 2:
                        # A special token keeps a leading blank, which no piece of a text has.
                        special[" " + part] = np.int32(self.special[part]).tobytes()
                        parts.append(" " + part)
                    else:
                        parts.extend(self.split(part))
            else:
                parts = self.split(text)
            cut.append(parts)
        known = self.pieces.recall(set().union(*cut).difference(special), self.learn_pieces)
        if special:
            known = known | special
        return [np.frombuffer(b"".join(map(known.__getitem__, parts)), dtype=np.int32).tolist() for parts in cut]

    def text_of(self, ids: Sequence[int]) -> str:
        """The ids as decimal numbers, joined by spaces."""
        return " ".join(map(self.shown.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> str:
        """The tokens joined by spaces, special ones included; unknown ids are skipped."""
        try:
            return " ".join(map(self.named.__getitem__, ids))
        except (IndexError, TypeError):
            return " ".join([name for name in map(self.names.get, ids) if name is not None])


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    """One per worker, so that words are remembered from task to task."""
    return WordBpe(path)


def encode(docs: DataFrame, text: str = "text", path: str = VOCABULARY, decoded: bool = True) -> DataFrame:
    """``docs`` with ``ids`` of every whole text (null: empty) and, if wanted, the text ``decoded`` from them."""

    def make():
        bpe = tokenizer(path)

        def work(batch: pa.RecordBatch):
            ids = bpe.encode(texts(batch, text))
            return [ids, [bpe.decode(i) for i in ids]] if decoded else [ids]

        return work

    return with_columns(docs, [("ids", "array<int>"), ("decoded", "string")][: 1 + decoded], make)


def digests(docs: DataFrame, text: str = "text", path: str = VOCABULARY, doc_id: str = "doc_id") -> DataFrame:
    """Number of tokens and digests of ids and decoded text; a row for each row, null text as empty."""

    def make():
        bpe = tokenizer(path)

        def work(batch: pa.RecordBatch):
            found = bpe.encode(texts(batch, "_text"))
            return [
                [len(ids) for ids in found],
                [hashlib.sha256(bpe.text_of(ids).encode()).hexdigest() for ids in found],
                [hashlib.sha256(bpe.decode(ids).encode()).hexdigest() for ids in found],
            ]

        return work

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    fields = [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    return with_columns(rows, fields, make).drop("_text")
