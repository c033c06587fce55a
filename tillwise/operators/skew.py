"""Equi-joins that keep a hot key from landing in one task.

Adaptive execution already splits a skewed partition where the join's output
is reshuffled.  These helpers are for the places where it is not, and for
loops that join the same rows again and again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.scratch import materialize, plan_bytes

MOST_HOT_KEYS = 10_000
HOT_ROWS = 1_000_000
SMALL_BYTES = 256 * 1024 * 1024


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """Keys with more rows than a task should hold, and how many ways to split each.

    A key is hot when it has more than HOT_ROWS rows and more than 1 in
    MOST_HOT_KEYS of all rows, so there are at most MOST_HOT_KEYS of them
    whatever the table size: the result is always small enough to broadcast.
    ``None`` when the whole table is smaller than one skewed partition.
    """
    if plan_bytes(df) < SMALL_BYTES:
        return None
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = df.agg(F.count(F.lit(1))).scalar()
    limit = F.greatest(F.lit(float(HOT_ROWS)), total / F.lit(float(MOST_HOT_KEYS)))
    hot = sizes.where(F.col("_rows") > limit).select(
        key, F.ceil(F.col("_rows") / limit).cast("int").alias("_fan")
    )
    return materialize(hot, "hot-keys")


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    spread: Sequence[str | Column],
    hot: DataFrame | None,
    how: str = "inner",
) -> DataFrame:
    """Join ``left`` to ``right`` (one row per key) on ``key``, hot keys split.

    The rows of a hot key are dealt over its share of salts by a hash of the
    ``spread`` columns, and only the matching right-hand row is repeated.
    Rows without a key match nothing and are dealt over salts of their own.
    """
    if hot is None:
        return left.join(right, key, how)
    hot = F.broadcast(hot)
    dealt = left.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(*spread), F.lit(MOST_HOT_KEYS)))
        .when(F.col("_fan").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64(*spread), F.col("_fan")))
        .cast("int"),
    )
    copies = (
        right.join(hot, key, "left")
        .withColumn(
            "_salt",
            F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_fan"), F.lit(1)) - 1)),
        )
        .drop("_fan")
    )
    return dealt.drop("_fan").join(copies, [key, "_salt"], how).drop("_salt")
