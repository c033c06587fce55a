"""Seeded draws that any SQL engine repeats exactly.

A shuffle is an order on ``md5(salt:key)``; a draw is a number read off the
same digest.  Neither depends on partitioning or on retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digest(salt: str, *keys: Column | str) -> Column:
    """Hex md5 of the salt and the keys, joined with ``:``."""
    parts = [_column(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(salt), *parts))


def draw(hex_digest: Column) -> Column:
    """A non-negative bigint from the first 15 hex digits (60 bits)."""
    return F.conv(F.substring(hex_digest, 1, 15), 16, 10).cast("bigint")


def unit(hex_digest: Column) -> Column:
    """A double in [0, 1) from the first 8 hex digits, exact in binary."""
    return F.conv(F.substring(hex_digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
