"""Ranks over a whole table without a single-task window, and top-k per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.hashing import draw
from tillwise.scratch import materialize, partitions_for

_LOW_BITS = 33  # monotonically_increasing_id: partition above, row number below


def global_rank(
    df: DataFrame, *order: str | Column, name: str = "rank", weight: str | None = None
) -> DataFrame:
    """Add the 0-based place of each row in the order of ``order``.

    One range shuffle: partitions hold consecutive key ranges, the row's place
    inside its partition comes from ``monotonically_increasing_id`` and the
    rows before the partition from a table with one row per partition.  The
    order columns must identify a row, so that equal leading keys still split.
    With ``weight`` the result is the sum of the weights before the row.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    stored = materialize(placed, "ranked").withColumn(
        "_part", F.shiftright("_place", _LOW_BITS)
    )
    amount = F.lit(1) if weight is None else F.col(weight)
    sizes = stored.groupBy("_part").agg(F.sum(amount).alias("_size"))
    # One row per partition, so this unpartitioned window is tiny.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    joined = stored.join(F.broadcast(offsets), "_part")
    if weight is None:
        inside = F.col("_place").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    else:
        earlier = (
            Window.partitionBy("_part")
            .orderBy("_place")
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        inside = F.coalesce(F.sum(weight).over(earlier), F.lit(0))
    return joined.select(*df.columns, (F.col("_offset") + inside).cast("bigint").alias(name))


def hash_rank(df: DataFrame, hex_digest: Column, *ties: str, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Add the 0-based place of each row in the order of a hex digest.

    Digests are uniform, so even ranges of them are even parts of the table:
    count the rows of each range, send every range to a task of its own, sort
    it there, and add what lies before it.  The sort compares the first 60 bits
    as a number, the rest only where these are equal, then ``ties``.  Rows must
    be distinct in what the digest covers.  The number of ranges follows the
    input unless it is given.  ``df`` is read twice, so give it a written table.
    """
    if parts is None:
        parts = partitions_for(df)
    high = draw(hex_digest)
    # The high 30 bits times the number of ranges, less 30 bits, is the range.
    part = F.shiftright(F.shiftright("_high", 30) * F.lit(parts), 30).cast("int")
    keyed = df.withColumn("_high", high)
    sizes = keyed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # One row per range, so this unpartitioned window is tiny.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    placed = (
        keyed.repartitionById(parts, part)
        .sortWithinPartitions("_high", hex_digest, *ties)
        .select(*df.columns, part.alias("_part"), inside.alias("_place"))
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_place")).cast("bigint").alias(name)
    )


def block_rank(
    df: DataFrame, group: str, code: str, name: str = "rank", block: int = 65_536
) -> DataFrame:
    """Add the 0-based place of each row inside its group, by a dense integer code.

    ``(group, code)`` must be unique.  Rows are numbered inside blocks of
    consecutive codes, so a group of any size is cut into pieces of at most
    ``block`` rows; what lies before each piece comes from the piece counts.
    """
    cut = df.withColumn("_block", F.floor(F.col(code) / block).cast("bigint"))
    pieces = cut.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = (
        Window.partitionBy(group)
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = pieces.select(
        group, "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(group, "_block").orderBy(code)
    return (
        cut.withColumn("_row", F.row_number().over(inside))
        .join(offsets, [group, "_block"])
        .select(*df.columns, (F.col("_offset") + F.col("_row") - 1).cast("bigint").alias(name))
    )


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first ``n`` rows in an order that identifies each row.

    A short head is a top-n in one pass; a long one would not fit one task,
    so it is cut by rank instead.
    """
    if n <= 100_000:
        return df.orderBy(*order).limit(n)
    return global_rank(df, *order, name="_head").where(F.col("_head") < n).drop("_head")


def first_in_group(
    df: DataFrame, group: str | Sequence[str], n: int, *order: str | Column
) -> DataFrame:
    """The first ``n`` rows of every group; pruned before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_row", F.row_number().over(inside)).where(F.col("_row") <= n).drop("_row")
    )


def top_k(
    df: DataFrame, group: str, score: str, k: int, *ties: str, name: str = "position"
) -> DataFrame:
    """The ``k`` best scores of every group, best first; equal scores by ``ties``.

    Fewer than ``k`` rows in a group are all kept.  The rank filter lets Spark
    keep at most ``k`` rows per group and map task before it shuffles.
    """
    inside = Window.partitionBy(group).orderBy(F.col(score).desc(), *ties)
    return df.withColumn(name, F.row_number().over(inside)).where(F.col(name) <= k)
