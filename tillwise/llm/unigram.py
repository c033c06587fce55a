"""Token counts of a unigram vocabulary without keeping the tokens.

An Aho-Corasick automaton over the vocabulary enumerates, for every end
position of a word, the pieces that end there.  Dynamic programming carries
the best score up to each position and the number of pieces of that best
path, with the tie rule of the unigram tokenizer: candidates come by start,
and only a greater score replaces an earlier one, so the longest piece of
equal score stays.
"""

from __future__ import annotations

import functools

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrow import texts, with_columns

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
#: Stands for a blank, and before the first word of a text.
BLANK = "▁"
#: An unknown character costs this much more than the worst piece.
PENALTY = 10.0
#: Words whose counts a worker remembers.
REMEMBERED = 500_000


def load(path: str) -> tuple[dict[str, float], bool]:
    """Pieces and their scores as the file has them, without control and byte pieces; and whether it has all bytes."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_pieces = {}, 0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            byte_pieces += 1
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = model.get_score(i)
    return pieces, byte_pieces == 256


class Counter:
    """Counts of pieces and of unknown characters of whole texts.

    Words are cut before every blank, each with the blank in front.  Unknown
    characters count as their UTF-8 bytes where the vocabulary has byte
    pieces; otherwise a run of them counts once.
    """

    def __init__(self, pieces: dict[str, float], bytes_known: bool) -> None:
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values(), default=0.0) - PENALTY
        self.bytes_known = bytes_known
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces
        self.known: dict[str, tuple[int, int]] = {}

    def count_word(self, word: str) -> tuple[int, int]:
        """Pieces, and unknown characters, of the best path through one word."""
        n = len(word)
        best: list[float | None] = [None] * (n + 1)
        pieces, unknown, in_run = [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        done = 0

        def unknown_at(start: int) -> None:
            """The candidate of an unknown character comes after the pieces with earlier starts."""
            score = best[start] + self.unknown
            end = start + 1
            if best[end] is None or score > best[end]:
                best[end] = score
                unknown[end] = unknown[start] + 1
                if self.bytes_known:
                    pieces[end] = pieces[start] + len(word[start].encode("utf-8", "replace"))
                else:
                    pieces[end] = pieces[start] + (not in_run[start])
                in_run[end] = True

        def finish(upto: int) -> None:
            """Positions below ``upto`` have all their pieces: add unknown single characters."""
            nonlocal done
            while done < upto:
                if word[done] not in self.single:
                    unknown_at(done)
                done += 1

        for last, (length, score) in () if self.empty else self.automaton.iter(word):
            end = last + 1
            finish(last)
            start = end - length
            total = best[start] + score
            if best[end] is None or total > best[end]:
                best[end] = total
                pieces[end], unknown[end], in_run[end] = pieces[start] + 1, unknown[start], False
        finish(n)
        return pieces[n], unknown[n]

    def count(self, text: str) -> tuple[int, int]:
        """Pieces and unknown characters of a whole text; an empty one has none."""
        if not text:
            return 0, 0
        text = text.replace(BLANK, " ")
        known = self.known
        total = missing = 0
        # A first blank is put in front unless the text starts with one.
        for word in text.removeprefix(" ").split(" "):
            found = known.get(word)
            if found is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                found = known[word] = self.count_word(BLANK + word)
            total += found[0]
            missing += found[1]
        return total, missing


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per worker, so that words are remembered from task to task."""
    return Counter(*load(path))


def counts(docs: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``n_tokens`` and ``n_unknown`` of every whole text; null counts as empty."""

    def make():
        count = counter(path).count

        def work(batch: pa.RecordBatch):
            found = [count(t) for t in texts(batch, text)]
            return [[n for n, _ in found], [u for _, u in found]]

        return work

    return with_columns(docs, [("n_tokens", "bigint"), ("n_unknown", "bigint")], make)


def token_counts(docs: DataFrame, text: str = "text", path: str = VOCABULARY, doc_id: str = "doc_id") -> DataFrame:
    """Id, tokens and unknown characters of every document; a row for each row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return counts(rows, "text", path).drop("text")
