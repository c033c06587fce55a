"""Words of UTF-8 texts, a bounded piece of a text at a time."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at once; a piece ends at the next separator.
PIECE = 1 << 20
BLANKS = bytes([0x20, *range(0x09, 0x0E)])


def letters(separators: bytes) -> bytes:
    """A translation of bytes: A-Z to lower case, separators to blanks."""
    return bytes(0x20 if b in separators else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes, table: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Lists of the words of a text, in order; no list is empty.

    ``table`` must turn all ASCII white space into blanks.
    """
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = at + piece
        if end < len(text):
            end = text.find(b" ", end)
            end = len(text) if end < 0 else end
        if found := text[at:end].split():
            yield found
        at = end
