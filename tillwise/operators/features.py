"""Aggregates over (user, item) and over the whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.dates import plus_years
from tillwise.functions.ratings import binned_rating, equal_width_bin
from tillwise.operators.encode import codes_by_appearance, codes_by_value, lookup
from tillwise.operators.ranking import block_rank, global_rank
from tillwise.scratch import materialize


def total_quantity(
    df: DataFrame, user: str = "customer_id", item: str = "material",
    quantity: str = "quantity",
) -> DataFrame:
    """Summed quantity per (user, item); rows with a NULL key have no group."""
    keyed = df.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    return keyed.groupBy(user, item).agg(F.sum(quantity).alias(quantity))


def customer_material_quantity(df: DataFrame) -> DataFrame:
    """Summed quantity with the material's integer code."""
    totals = materialize(total_quantity(df), "totals")
    codes = codes_by_appearance(totals, "material", "customer_id", "product_id")
    return lookup(totals, codes, "material", "product_id", spread="customer_id").select(
        "customer_id", "material", "product_id", "quantity"
    )


def purchase_summary(
    df: DataFrame, user: str = "customer_id", item: str = "material",
    quantity: str = "quantity", day: str = "calday",
) -> DataFrame:
    """Count, summed quantity, first and last day per (user, item): one shuffle."""
    keyed = df.where(F.col(user).isNotNull() & F.col(item).isNotNull())
    return (
        keyed.groupBy(user, item)
        .agg(
            F.count(quantity).alias("transaction_count"),
            F.sum(quantity).alias("quantity_sum"),
            F.min(day).alias("first_purchase"),
            F.max(day).alias("last_purchase"),
        )
        .withColumn("time_diff_days", F.datediff("last_purchase", "first_purchase"))
    )


def interaction_features(df: DataFrame) -> DataFrame:
    """:func:`purchase_summary` with integer codes for both ids.

    The summary is written once: both code tables and the result read it.
    """
    summary = materialize(purchase_summary(df), "summary")
    users = codes_by_value(summary, "customer_id", "normalized_customer_id")
    items = codes_by_appearance(summary, "material", "customer_id", "product_id")
    coded = lookup(summary, users, "customer_id", "normalized_customer_id", spread="material")
    coded = lookup(
        coded, items, "material", "product_id", spread="customer_id", sized_by=summary
    )
    return coded.select(
        "customer_id", "normalized_customer_id", "material", "product_id",
        "transaction_count", "quantity_sum", "first_purchase", "last_purchase",
        "time_diff_days",
    )


def first_present(
    df: DataFrame, keys: Sequence[str], order: Column, columns: Sequence[str]
) -> DataFrame:
    """Per key and column, the first value that is not NULL in the given order."""
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    )


def profile(df: DataFrame, *order: str) -> DataFrame:
    """First, second and last first-purchase day, the span between the last two,
    the number of rows, and how many have a positive, negative or zero span."""
    second = (
        df.orderBy(*order).limit(2).agg(F.max("first_purchase").alias("d"), F.count("*").alias("n"))
        .select(F.when(F.col("n") == 2, F.col("d")))
        .scalar()
    )
    days = F.col("time_diff_days")
    return df.agg(
        F.min("first_purchase").alias("first_day"),
        F.max("first_purchase").alias("last_day"),
        F.count(F.lit(1)).alias("rows"),
        F.count_if(days > 0).alias("positive_spans"),
        F.count_if(days < 0).alias("negative_spans"),
        F.count_if(days == 0).alias("zero_spans"),
    ).select(
        "first_day", second.alias("second_day"), "last_day",
        F.datediff("last_day", second).alias("period_days"),
        "rows", "positive_spans", "negative_spans", "zero_spans",
    )


def shift_years(
    df: DataFrame, columns: Sequence[str], *order: str, ends_of: DataFrame | None = None
) -> DataFrame:
    """Move each date column by the years between its second and its last row.

    Rows are taken in the given order; each column has its own difference.
    The two end rows are a top-2 and a top-1, not a sort of the table.  They
    are read from ``ends_of`` when the same dates lie ready there.
    """
    rows = df if ends_of is None else ends_of
    last = F.max_by(F.struct(*columns), F.struct(*order))
    at_second = rows.orderBy(*order).limit(2).agg(last).scalar()
    at_last = rows.agg(last).scalar()
    return df.withColumns(
        {c: plus_years(F.col(c), F.year(at_last[c]) - F.year(at_second[c])) for c in columns}
    )


def equal_width_ratings(
    df: DataFrame,
    count: str = "transaction_count",
    quantity: str = "quantity_sum",
    days: str = "time_diff_days",
) -> DataFrame:
    """Four equal-width bins of count, quantity and span, and their rating.

    The six bounds come from one aggregate used as a scalar subquery.
    """
    bounds = df.agg(
        *[
            f(F.col(c).cast("double")).alias(f"{tag}_{c}")
            for c in (count, quantity, days)
            for tag, f in (("low", F.min), ("high", F.max))
        ]
    )
    packed = bounds.select(F.struct(*bounds.columns)).scalar()

    def bin_of(c: str) -> Column:
        return equal_width_bin(
            F.col(c).cast("double"), packed[f"low_{c}"], packed[f"high_{c}"]
        )

    binned = (
        df.withColumn(f"normalized_{count}", bin_of(count))
        .withColumn(f"normalized_{quantity}", bin_of(quantity))
        .withColumn(f"normalized_{days}", bin_of(days))
    )
    return binned.withColumn(
        "rating",
        binned_rating(
            F.col(f"normalized_{days}"),
            F.col(f"normalized_{quantity}"),
            F.col(f"normalized_{count}"),
        ),
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value, n) for several numeric columns, in one pass over the rows."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    return (
        df.select(F.inline(pairs))
        .where(F.col("value").isNotNull())
        .groupBy("name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quantile_edges(counts: DataFrame, parts: Mapping[str, int]) -> DataFrame:
    """Exact, linearly interpolated quantile edges per column: (name, edges).

    ``counts`` is a :func:`value_counts` table.  Values are ranked over all
    partitions, so no task holds the values of a column; each edge needs only
    the two values around its place.  Equal edges are kept once.
    """
    placed = global_rank(counts, "name", "value", name="start", weight="n")
    # One row per column.
    spans = counts.groupBy("name").agg(F.sum("n").alias("total")).join(
        placed.groupBy("name").agg(F.min("start").alias("base")), "name"
    )
    rows = placed.join(F.broadcast(spans), "name").select(
        "name", "value", "total",
        (F.col("start") - F.col("base")).alias("lo"),
        (F.col("start") - F.col("base") + F.col("n")).alias("hi"),
    )

    # The place of edge i of q lies between two neighbouring ranks.
    q = F.col("q")
    spot = (F.col("total") - 1) * F.col("i") / q.cast("double")
    steps = rows.withColumn("q", _parts_of(parts)).withColumn(
        "i", F.explode(F.sequence(F.lit(0), q))
    )

    def at(place: Column) -> Column:
        inside = (F.col("lo") <= place) & (place < F.col("hi"))
        return F.max(F.when(inside, F.col("value")))

    around = (
        steps.where((F.col("lo") <= F.ceil(spot)) & (F.floor(spot) < F.col("hi")))
        .groupBy("name", "total", "q", "i")
        .agg(at(F.floor(spot)).alias("low"), at(F.ceil(spot)).alias("high"))
    )
    edge = F.col("low") + (F.col("high") - F.col("low")) * (spot - F.floor(spot))
    # At most parts+1 edges per column.
    return around.groupBy("name").agg(F.array_sort(F.collect_set(edge)).alias("edges"))


def _parts_of(parts: Mapping[str, int]) -> Column:
    names = F.lit(None).cast("int")
    for name, q in parts.items():
        names = F.when(F.col("name") == name, F.lit(q)).otherwise(names)
    return names


def quantile_histogram(df: DataFrame, parts: Mapping[str, int]) -> DataFrame:
    """Rows per quantile bin: (name, bin, low, high, n); bins are right-closed.

    A constant column has a single edge and therefore no bins.
    """
    counts = materialize(value_counts(df, list(parts)), "value-counts")
    edges = quantile_edges(counts, parts)
    # One row per column, at most parts+1 edges in it.
    rows = counts.join(F.broadcast(edges), "name").withColumn(
        "bin",
        F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("value")))),
    )
    filled = rows.groupBy("name", "bin").agg(F.sum("n").alias("n"))
    bins = edges.where(F.size("edges") > 1).select(
        "name", "edges", F.explode(F.sequence(F.lit(1), F.size("edges") - 1)).alias("bin")
    ).select(
        "name", "bin",
        F.element_at("edges", F.col("bin")).alias("low"),
        F.element_at("edges", F.col("bin") + 1).alias("high"),
    )
    return bins.join(filled, ["name", "bin"], "left").select(
        "name", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n")
    )


def heavy_users(df: DataFrame, user: str, more_than: int = 20) -> DataFrame:
    """Users with more rows than a threshold, and how many."""
    return df.groupBy(user).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)


def item_lists(
    df: DataFrame, user: str, item: str, block: int = 1_000
) -> DataFrame:
    """Each user's distinct items in order, as lists of at most ``block`` items.

    A list per user has no bound, so it comes in numbered blocks; the blocks
    of a user put one after the other are the whole list.
    """
    ranked = block_rank(df.select(user, item).distinct(), user, item)
    return (
        ranked.withColumn("block", F.floor(F.col("rank") / block).cast("bigint"))
        .groupBy(user, "block")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
    )
