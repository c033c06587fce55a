"""Synthetic growth and negative feedback.

Every shuffle is an order on a seeded digest, so a result can be repeated
exactly in another engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.hashing import digest, draw
from tillwise.operators.curate import positive_pairs, unique_keys_only
from tillwise.operators.features import first_present, shift_years
from tillwise.operators.ranking import first_rows, global_rank, hash_rank
from tillwise.operators.skew import hot_keys, spread_join
from tillwise.operators.splits import chunk_of, time_chunks
from tillwise.scratch import discard, materialize, partitions_for, temporary

MAX_ROUNDS = 50


def _dealt(df: DataFrame, user: str, item: str, salt: str, position: str) -> list[DataFrame]:
    """(position, user) and (position, item): each value at its place in a shuffle of its column."""
    keys = df.select(user, item)
    return [
        hash_rank(keys, digest(f"{salt}-{tag}", user, item), user, item, name=position).select(position, c)
        for tag, c in (("user", user), ("item", item))
    ]


def shuffled_pairs(
    df: DataFrame, user: str, item: str, salt: str, position: str = "position"
) -> DataFrame:
    """(position, user, item) with both columns shuffled independently.

    Each column keeps its values and their counts; only the pairing is new.
    The two values of a place are put together by a join on the place, which
    both sides have once.  ``df`` holds distinct pairs.
    """
    users, items = _dealt(df, user, item, salt, position)
    return users.join(items, position).select(position, user, item)


def synthetic_rows(
    df: DataFrame, user: str, item: str, order: Sequence[str], salt: str
) -> DataFrame:
    """The table in its order, with the user and item columns shuffled.

    All other columns stay on their row; ``position`` is the row's place.
    """
    together = global_rank(df, *order, name="position").drop(user, item)
    for side in _dealt(df, user, item, salt, "position"):
        together = together.join(side, "position")
    return together.select("position", *df.columns)


def _check_room(df: DataFrame, user: str, item: str, size: int) -> None:
    """More distinct pairs cannot be made than users times items."""
    room = df.agg(F.count_distinct(F.col(user)) * F.count_distinct(F.col(item))).first()[0]
    if size > room:
        raise ValueError(f"{size} distinct pairs asked for, only {room} exist")


def grow(
    features: DataFrame, size: int, user: str = "customer_id", item: str = "product_id",
    first: str = "first_purchase", last: str = "last_purchase", max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Grow the feature table to ``size`` distinct pairs, in time order.

    Each round shuffles all pairs made so far, moves the dates of the copies
    by the span of the table, and keeps existing rows over synthetic ones.
    Every round ends in a written table.  Ids that go with the user or the
    item are looked up again at the end, and the span is recomputed.
    """
    order = [first, last, user, item]
    labels = [c for c in ("material", "normalized_customer_id") if c in features.columns]
    columns = [c for c in features.columns if c not in labels]
    _check_room(features, user, item, size)
    spark = features.sparkSession
    grown = materialize(features.select(*columns), "grow")
    n = grown.count()
    for step in range(1, max_rounds + 1):
        if n >= size:
            break
        with temporary(spark) as keep:
            made = synthetic_rows(grown, user, item, order, f"grow{step}")
            moved = shift_years(made, [first, last], *order, ends_of=grown)
            together = grown.select(*columns, F.lit(-1).cast("bigint").alias("_age")).unionByName(
                moved.select(*columns, F.col("position").alias("_age"))
            )
            # A number as order keeps the aggregate in its hash form.
            merged = first_present(
                together, [user, item], F.col("_age"), [c for c in columns if c not in (user, item)]
            )
            old, grown = grown, keep(merged.select(*columns), "grow")
        discard(old)
        before, n = n, grown.count()
        if n == before:
            raise ValueError(f"no new pair in round {step}; {n} of {size} rows made")
    if n < size:
        raise ValueError(f"{n} of {size} rows after {max_rounds} rounds")
    return _relabel(materialize(first_rows(grown, size, *order), "grown"), features, user, item)


def _relabel(grown: DataFrame, features: DataFrame, user: str, item: str) -> DataFrame:
    """Set the material of each item code and the code of each user again."""
    fixed = grown
    for key, label, other in ((item, "material", user), (user, "normalized_customer_id", item)):
        if label in features.columns:
            labels = features.groupBy(key).agg(F.any_value(label).alias(label))
            fixed = spread_join(fixed, labels, key, [other], hot_keys(grown, key))
    return fixed.withColumn(
        "time_diff_days", F.datediff("last_purchase", "first_purchase")
    ).select(*features.columns)


def negative_pairs(
    positives: DataFrame, size: int, user: str = "customer_id", item: str = "product_id",
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """Popularity-weighted negatives: ``size`` shuffled pairs that are no positives.

    A round shuffles the pairs at hand (first the positives, then the
    negatives so far), adds them, and drops every pair that came up twice or
    is a positive, by one grouping of all of them.  Where positives and negatives nearly fill the catalogue the
    rounds may stop gaining; that is an error, not a shorter table.  Returns (user, item, generation, position, place),
    oldest first; ``place`` is the place in that order.
    """
    keys = [user, item]
    known = materialize(positive_pairs(positives, user, item), "positives")
    have = known.count()
    room = known.agg(F.count_distinct(F.col(user)) * F.count_distinct(F.col(item))).first()[0]
    if size > room - have:
        raise ValueError(f"{size} negatives asked for, only {room - have} exist")
    pool = known.select(*keys, F.lit(0).alias("generation"), F.lit(0).cast("bigint").alias("position"))
    # Their copies in the grouping; a NULL is equal to no id.
    taken = known.where(F.col(user).isNotNull() & F.col(item).isNotNull()).select(
        *keys, F.lit(None).cast("int").alias("generation"), F.lit(None).cast("bigint").alias("position")
    )
    n = 0
    for step in range(1, max_rounds + 1):
        with temporary(positives.sparkSession) as keep:
            made = shuffled_pairs(pool, user, item, f"negative{step}").select(
                *keys, F.lit(step).alias("generation"), "position"
            )
            # From the second round on the pool itself holds no positive.
            together = made.unionByName(taken) if step == 1 else pool.unionByName(made).unionByName(taken)
            fresh = unique_keys_only(together, keys).where(F.col("generation").isNotNull())
            old, pool = pool, keep(fresh, "negatives")
        if step > 1:
            discard(old)
        n = pool.count()
        if n >= size:
            break
    if n < size:
        raise ValueError(f"{n} of {size} negatives after {max_rounds} rounds")
    return global_rank(pool, "generation", "position", name="place").where(F.col("place") < size)


def labelled_chunks(
    positives: DataFrame, negatives: DataFrame, n: int, positive_order: Sequence[str],
    user: str = "customer_id", item: str = "product_id",
) -> DataFrame:
    """Chunks of positives (label 1) with their share of the negatives (label 0).

    Both tables are cut in their own order into ``n`` even chunks.  Negatives
    that know their ``place`` need not be ranked again.
    """
    ones = time_chunks(positives, n, *positive_order).select(
        user, item, F.lit(1).alias("rating_type"), "chunk"
    )
    if "place" in negatives.columns:
        total = negatives.agg(F.count(F.lit(1))).scalar()
        cut = negatives.withColumn("chunk", chunk_of(F.col("place"), total, n))
    else:
        cut = time_chunks(negatives, n, "generation", "position")
    zeros = cut.select(user, item, F.lit(0).alias("rating_type"), "chunk")
    return ones.unionByName(zeros)


def ratio_negatives(
    pairs: DataFrame, ratio: float = 3, user: str = "customer_id", item: str = "product_id",
    salt: str = "ratio", exclude_positives: bool = False,
) -> DataFrame:
    """Positives (label 1.0) and ``ratio`` times as many (rounded down) drawn pairs (label 0.0).

    Rows are drawn with replacement by a seeded index, then the drawn items
    are shuffled among the draws.  A drawn pair may repeat, and may be a
    positive unless ``exclude_positives`` is set: then draws that hit one take
    an item that the user does not have, in one pass (see ``_from_unseen``);
    it is an error if such a user has every item.
    ``draw`` numbers the draws and is -1 for positives.

    A draw takes the user of its own row and the item of the row of the draw
    whose place in the shuffle it is, so only numbers are shuffled before both
    are looked up, and hits are marked where the drawn pairs are written.
    """
    numbered = materialize(
        hash_rank(pairs.select(user, item), digest(f"{salt}-row", user, item), user, item, name="row"),
        "rows",
    )
    count = numbered.count()

    def row_of(name: str) -> Column:
        # Never null, and said to be so: otherwise the joins work the digest out once more to check it.
        return F.coalesce(F.pmod(draw(digest(f"{salt}-draw", name)), F.lit(count)), F.lit(0))

    draws = pairs.sparkSession.range(int(count * ratio)).toDF("draw")
    places = hash_rank(draws, digest(f"{salt}-item", "draw"), "draw", name="place")
    rows = places.select(
        F.col("place").alias("draw"), row_of("place").alias("_user_row"), row_of("draw").alias("_item_row")
    )
    # The size of a task follows the draws, not a fixed number.
    parts = max(partitions_for(draws), partitions_for(numbered))
    zeros = rows
    for c, at in ((user, "_user_row"), (item, "_item_row")):
        # A task's rows of ``numbered`` are few, so the draws need not be sorted.
        one = numbered.select(F.col("row").alias(at), c).repartition(parts, at).hint("shuffle_hash")
        zeros = zeros.repartition(parts, at).join(one, at).drop(at)
    zeros = zeros.select("draw", user, item)
    if exclude_positives:
        known = pairs.select(user, item).distinct().withColumn("_hit", F.lit(True)).hint("shuffle_hash")
        marked = materialize(zeros.join(known, [user, item], "left"), "zeros")
        again = materialize(marked.where("_hit").select("draw", user), "again")
        drawn_again = materialize(_from_unseen(again, pairs, user, item, salt), "drawn-again")
        zeros = marked.where("_hit is null").select("draw", user, item).unionByName(drawn_again)
    return (
        pairs.select(user, item, F.lit(1.0).alias("label"), F.lit(-1).cast("bigint").alias("draw"))
        .unionByName(zeros.select(user, item, F.lit(0.0).alias("label"), "draw"))
    )


def _from_unseen(draws: DataFrame, pairs: DataFrame, user: str, item: str, salt: str) -> DataFrame:
    """For each (draw, user) an item that the user does not have, as likely as it is frequent in ``pairs``.

    Rows of the pairs lie on a line in the order of their items, so that an
    item takes up as much of it as it has rows.  A user's unseen items are
    ranges of the line; a seeded number below their total length is a place in
    one of them, and the item at that place is taken.  Only the users of the
    draws get ranges, and of the line only the ends of the items are kept.
    Ranges and draws of a user meet in steps of the mean length of its ranges,
    which makes two or three meetings a range however many ranges and draws a
    user has; items and places meet in the same way.
    """
    weights = pairs.groupBy(item).agg(F.count(F.lit(1)).alias("weight"))
    line = materialize(global_rank(weights, item, name="from", weight="weight"), "line")
    items = materialize(global_rank(line, item, name="code"), "items")
    n_items, end = items.agg(F.count(F.lit(1)), F.sum("weight")).first()
    of_draws = pairs.select(user, item).join(draws.select(user).distinct(), user, "left_semi")
    seen = materialize(of_draws.distinct(), "seen")
    coded = spread_join(seen, items.select(item, "code"), item, [user], hot_keys(seen, item))
    ranges = unseen_ranges(materialize(coded.select(user, "code"), "coded"), user, "code", n_items)
    first = items.select(F.col("code").alias("first_code"), "from")
    last = items.select(F.col("code").alias("last_code"), (F.col("from") + F.col("weight")).alias("to"))
    lengths = ranges.join(first, "first_code").join(last, "last_code").select(
        user, "first_code", "from", (F.col("to") - F.col("from")).alias("length")
    )
    placed = materialize(global_rank(lengths, user, "first_code", name="before", weight="length"), "ranges")
    totals = placed.groupBy(user).agg(
        F.min("before").alias("_start"), F.sum("length").alias("_total"),
        F.ceil(F.sum("length") / F.count(F.lit(1))).alias("_step"),
    )
    totals = materialize(totals, "totals")
    asked = spread_join(draws.select("draw", user), totals, user, ["draw"], hot_keys(draws, user), "left")
    number = draw(digest(f"{salt}-unseen", "draw"))
    asked = materialize(asked.withColumn("_number", F.pmod(number, F.col("_total"))), "asked")
    if not asked.where(F.col("_total").isNull()).isEmpty():
        raise ValueError("a user has every item, no negative exists")
    low = F.col("before") - F.col("_start")
    pieces = placed.join(totals, user).select(
        user, low.alias("_low"), "length", "from", _steps(low, F.col("length"), F.col("_step")).alias("_piece")
    )
    places = (
        asked.withColumn("_piece", F.floor(F.col("_number") / F.col("_step")))
        .join(pieces, [user, "_piece"])
        .where((F.col("_number") >= F.col("_low")) & (F.col("_number") < F.col("_low") + F.col("length")))
        .select("draw", user, (F.col("from") + F.col("_number") - F.col("_low")).alias("at"))
    )
    step = F.lit(max(1, -(-(end or 0) // max(1, n_items))))
    ends = items.select(item, "from", "weight", _steps(F.col("from"), F.col("weight"), step).alias("_piece"))
    return (
        places.withColumn("_piece", F.floor(F.col("at") / step))
        .join(ends, "_piece")
        .where((F.col("at") >= F.col("from")) & (F.col("at") < F.col("from") + F.col("weight")))
        .select("draw", user, item)
    )


def _steps(low: Column, length: Column, step: Column) -> Column:
    """A row for each step of the line that a piece of it touches."""
    return F.explode(F.sequence(F.floor(low / step), F.floor((low + length - 1) / step)))


def unseen_ranges(
    pairs: DataFrame, user: str, code: str, n_items: int, block: int = 65_536
) -> DataFrame:
    """Each user's complement of the catalogue, as ranges of item codes.

    Between two neighbouring items of a user lies one range of unseen codes,
    so the whole complement of users times items has at most one row per pair
    plus one per user: (user, first_code, last_code), both inclusive.
    Neighbours are found inside blocks of consecutive codes, and the ends of
    the blocks are joined up afterwards, so no user is gathered in one task.
    ``n_items`` is the size of the catalogue (codes 0..n_items-1); pairs are
    distinct.
    """
    cut = pairs.select(user, F.col(code).cast("bigint").alias("_code")).withColumn(
        "_block", F.floor(F.col("_code") / block).cast("bigint")
    )
    inside = Window.partitionBy(user, "_block").orderBy("_code")
    within = cut.select(
        user, (F.lag("_code").over(inside) + 1).alias("first_code"),
        (F.col("_code") - 1).alias("last_code"),
    )
    ends = cut.groupBy(user, "_block").agg(F.min("_code").alias("_min"), F.max("_code").alias("_max"))
    blocks = Window.partitionBy(user).orderBy("_block")
    between = ends.select(
        user,
        (F.coalesce(F.lag("_max").over(blocks), F.lit(-1).cast("bigint")) + 1).alias("first_code"),
        (F.col("_min") - 1).alias("last_code"),
    )
    after = ends.groupBy(user).agg(F.max("_max").alias("_max")).select(
        user, (F.col("_max") + 1).alias("first_code"),
        F.lit(n_items - 1).cast("bigint").alias("last_code"),
    )
    return (
        within.where(F.col("first_code").isNotNull())
        .unionByName(between)
        .unionByName(after)
        .where(F.col("first_code") <= F.col("last_code"))
    )


def expand_ranges(ranges: DataFrame, user: str, code: str, piece: int = 10_000) -> DataFrame:
    """The (user, code) rows of code ranges, one row per unseen item.

    For exporting the complement of chosen users.  A long range is cut into
    pieces that are spread over the tasks before they are written out.
    """
    pieces = ranges.select(
        user, "last_code",
        F.explode(F.sequence("first_code", "last_code", F.lit(piece).cast("bigint"))).alias("_from"),
    ).repartition(F.col(user), F.col("_from"))
    return pieces.select(
        user,
        F.explode(
            F.sequence("_from", F.least(F.col("_from") + piece - 1, F.col("last_code")))
        ).alias(code),
    )


def binary_matrix(
    df: DataFrame, user: str, item: str, prefix: str = "item_", most: int = 1_000
) -> DataFrame:
    """One row per user, one 0/1 column per item, for small catalogues.

    A catalogue of more than ``most`` items does not fit a row: use
    :func:`sparse_rows`, which holds any.
    """
    found = [r[0] for r in df.select(item).where(F.col(item).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} items; use sparse_rows instead")
    values = sorted(found)
    return (
        df.groupBy(user)
        .pivot(item, values)
        .agg(F.max(F.lit(1)))
        .select(user, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(f"{prefix}{v}") for v in values])
    )


def sparse_rows(df: DataFrame, user: str, code: str, block: int = 65_536) -> DataFrame:
    """The rows of the 0/1 matrix in sparse form: (user, block, codes), for any catalogue.

    ``codes`` are the columns of a user that hold a one, in order, as integer
    codes.  Block ``b`` holds the codes from ``b * block`` on, so that no list
    is longer than a block, however many items a user has.
    """
    cut = df.where(F.col(user).isNotNull() & F.col(code).isNotNull()).select(
        user, F.floor(F.col(code) / block).cast("bigint").alias("block"), F.col(code).cast("bigint").alias("code")
    )
    return cut.groupBy(user, "block").agg(F.array_sort(F.collect_set("code")).alias("codes"))
