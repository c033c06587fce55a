"""Chunks, train/test splits, folds and holdouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.hashing import digest
from tillwise.operators.curate import rows_seen_once
from tillwise.operators.features import heavy_users
from tillwise.operators.ranking import first_in_group, global_rank, hash_rank
from tillwise.scratch import materialize


def chunk_of(rank: Column, total: Column, n: int) -> Column:
    """Chunk 0..n-1 of a rank; the first ``total % n`` chunks are one longer."""
    size = F.floor(total / n)
    longer = total % n
    in_longer = longer * (size + 1)
    return (
        F.when(rank < in_longer, F.floor(rank / (size + 1)))
        .otherwise(longer + F.floor((rank - in_longer) / F.nullif(size, F.lit(0))))
        .cast("int")
    )


def time_chunks(df: DataFrame, n: int, *order: str, name: str = "chunk") -> DataFrame:
    """Cut the ordered table into ``n`` consecutive chunks of even size."""
    ranked = global_rank(df, *order, name="_rank")
    total = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn(name, chunk_of(F.col("_rank"), total, n)).drop("_rank")


def shuffled_chunks(
    df: DataFrame, n: int, keys: Sequence[str], salt: str, name: str = "chunk"
) -> DataFrame:
    """Shuffle by a seeded digest of the row key, then cut into even chunks."""
    ranked = hash_rank(df, digest(salt, *keys), *keys, name="_rank")
    total = df.agg(F.count(F.lit(1))).scalar()
    return ranked.withColumn(name, chunk_of(F.col("_rank"), total, n)).drop("_rank")


def random_split(
    df: DataFrame, ratio: float, keys: Sequence[str], salt: str = "split",
    name: str = "is_train",
) -> DataFrame:
    """Mark exactly ``int(n * ratio)`` rows as training rows, picked by digest."""
    ranked = hash_rank(df, digest(salt, *keys), *keys, name="_rank")
    taken = F.floor(df.agg(F.count(F.lit(1))).scalar() * F.lit(ratio))
    return ranked.withColumn(name, F.col("_rank") < taken).drop("_rank")


def hold_out(df: DataFrame, fold: int | None, column: str = "chunk") -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one rotation; ``None`` trains on everything."""
    if fold is None:
        return df, df.limit(0)
    return df.where(F.col(column) != fold), df.where(F.col(column) == fold)


def positives_only(df: DataFrame, label: str = "rating_type") -> DataFrame:
    return df.where(F.col(label) == 1)


def rotation_summary(
    df: DataFrame, fold: str, value: str, test_when: Column | None = None
) -> DataFrame:
    """Train and test size and mean of every rotation, from one aggregate.

    A rotation's training rows are all rows less its fold's, so the folds are
    summed once instead of the table being read once per rotation.
    ``test_when`` restricts the test rows, not the training rows.
    """
    kept = F.lit(True) if test_when is None else test_when
    folds = df.groupBy(F.col(fold).cast("bigint").alias("fold")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(value).alias("_sum"),
        F.count_if(kept).alias("test_rows"),
        F.avg(F.when(kept, F.col(value))).alias("test_mean"),
    )
    whole = folds.agg(F.struct(F.sum("_n").alias("n"), F.sum("_sum").alias("s"))).scalar()
    train = whole["n"] - F.col("_n")
    return folds.select(
        "fold", train.alias("train_rows"), "test_rows",
        F.try_divide(whole["s"] - F.col("_sum"), train).alias("train_mean"),
        "test_mean",
    )


def heavy_user_holdout(
    df: DataFrame, user: str, liked: Column, order: Sequence[str],
    more_than: int = 20, per_user: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): the first liked rows of each heavy user go to the test.

    Heavy users have more than ``more_than`` liked rows.  A row that occurs
    twice in the full table is in neither part of the training rows.
    """
    likes = df.where(liked)
    heavy = heavy_users(likes, user, more_than).select(user)
    # First rows first: that prunes before the shuffle and leaves few rows to join.
    firsts = first_in_group(likes, user, per_user, *order)
    test = materialize(firsts.join(heavy, user, "left_semi").select(*df.columns), "holdout")
    return rows_seen_once(df, test), test
