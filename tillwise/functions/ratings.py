"""Ratings derived from interaction counts and quantities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut points and scales of the composite rating.
QUANTITY_CUTS = (1, 1, 2)
COUNT_CUTS = (1, 2, 4)
QUANTITY_SCALE = 0.5
COUNT_SCALE = 0.5


def quartile_place(value: Column, cuts: Sequence[float]) -> Column:
    """1..4 by three cut points; a value equal to a cut stays below it."""
    low, middle, high = cuts
    return (
        F.when(value > high, 4).when(value > middle, 3).when(value > low, 2).otherwise(1)
    )


def composite_rating(
    count: Column, quantity: Column, stored: Column | None = None
) -> Column:
    """Half the count's quartile plus half the quantity's, unless a rating is stored."""
    derived = F.lit(COUNT_SCALE) * quartile_place(count, COUNT_CUTS) + F.lit(
        QUANTITY_SCALE
    ) * quartile_place(quantity, QUANTITY_CUTS)
    return derived if stored is None else F.coalesce(stored, derived)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int = 4) -> Column:
    """Right-closed equal-width bin 1..bins, the minimum in bin 1.

    A constant column has no width: its values count as the middle of a range
    opened around them, which is the upper edge of bin 2 of 4.
    """
    step = (high - low) / F.lit(float(bins))
    place = F.lit(1)
    for i in range(1, bins):
        place = place + F.when(value > low + step * F.lit(float(i)), 1).otherwise(0)
    return F.when(value.isNull(), None).when(
        high == low, F.lit((bins + 1) // 2)
    ).otherwise(place)


def binned_rating(days: Column, quantity: Column, count: Column) -> Column:
    """Product of the three bins, divided by three."""
    return days * quantity * count / F.lit(3.0)
