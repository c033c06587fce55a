"""Matrix factorisation and pairwise ranking, fitted by full-batch steps.

The model is one long table (side, id, factors, bias) with side ``u`` for users
and ``i`` for items and an array of factors.  A step is one Spark job: the
ratings meet both sides, every row sends its gradient to its user and its item,
the gradients are averaged with map-side combination, and the new model is
written.  A gradient travels in pieces of at most ``PIECE`` numbers, each an
ordinary aggregate column, so that the plan of a step does not grow with the
rank.  All rows of a step see the same model, so the result does not depend on
row order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.hashing import unit
from tillwise.functions.scores import array_dot, log_loss, sigmoid, triplet_loss
from tillwise.operators.skew import hot_keys, spread_join
from tillwise.scratch import discard, materialize, temporary


#: Numbers of a gradient that are averaged as columns of one row.
PIECE = 32


def start_model(
    users: DataFrame, items: DataFrame, rank: int, salt: str = "start", scale: float = 1.0
) -> DataFrame:
    """Seeded start factors in [-scale/2, scale/2), biases zero.

    ``users`` and ``items`` hold one distinct id per row in their first column,
    of one type.
    """
    places = F.sequence(F.lit(0), F.lit(rank - 1))

    def side(ids: DataFrame, tag: str) -> DataFrame:
        key = F.col(ids.columns[0])
        kind = ids.schema[0].dataType
        return ids.select(
            F.lit(tag).alias("side"),
            (key if isinstance(kind, T.StringType) else key.cast("bigint")).alias("id"),
            F.transform(
                places,
                lambda k: (unit(F.md5(F.concat(F.lit(f"{salt}-{tag}"), k.cast("string"), F.lit(":"), key.cast("string")))) - 0.5) * F.lit(scale),
            ).alias("factors"),
            F.lit(0.0).alias("bias"),
        )

    return side(users, "u").unionByName(side(items, "i"))


def side_of(model: DataFrame, side: str, key: str, prefix: str) -> DataFrame:
    """One side of the model as (key, prefix, prefix_bias)."""
    return model.where(F.col("side") == side).select(
        F.col("id").alias(key), F.col("factors").alias(prefix), F.col("bias").alias(f"{prefix}_bias")
    )


def as_arrays(model: DataFrame, side: str, key: str) -> DataFrame:
    """One side of the model as (key, factors, bias), the form scoring reads."""
    return model.where(F.col("side") == side).select(F.col("id").alias(key), "factors", "bias")


def wide(model: DataFrame, rank: int) -> DataFrame:
    """The model with one column per factor: (side, id, f0.., bias)."""
    return model.select("side", "id", *[F.get("factors", F.lit(k)).alias(f"f{k}") for k in range(rank)], "bias")


def _score(p: str, q: str, offset: float) -> Column:
    """Biased score of two sides; a side that the model does not know adds nothing."""
    zero = F.lit(0.0)
    both = F.coalesce(array_dot(F.col(p), F.col(q)), zero)
    return F.lit(offset) + F.coalesce(F.col(f"{p}_bias"), zero) + F.coalesce(F.col(f"{q}_bias"), zero) + both


def predict(
    rows: DataFrame, model: DataFrame, user: str, item: str, offset: float = 0.0, name: str = "score",
) -> DataFrame:
    """Add the biased score of each (user, item) row.

    No row is lost: with an id outside the model the score is the offset and
    the bias of the other side, if that is known.
    """
    scored = spread_join(rows, side_of(model, "u", user, "_p"), user, [item], hot_keys(rows, user), "left")
    scored = spread_join(scored, side_of(model, "i", item, "_q"), item, [user], hot_keys(rows, item), "left")
    return scored.select(*rows.columns, _score("_p", "_q", offset).alias(name))


@dataclass(frozen=True)
class Settings:
    """How a step moves the model.

    ``link`` is ``identity`` for ratings (squared error) or ``logit`` for 0/1
    labels (log loss on the sigmoid of the score).
    """

    rank: int = 8
    rate: float = 0.01
    penalty: float = 0.02
    bias_penalty: float = 0.02
    learn_bias: bool = True
    link: str = "identity"


def _pieces(rank: int) -> list[int]:
    return list(range(0, rank, PIECE))


def _message(side: str, key: str, gradient: Column, bias: Column, n: Column, rank: int, *extra: Column) -> Column:
    """An array of rows (side, id, piece, n, g0.., g_bias, extra); the bias goes with the first piece.

    ``gradient`` and ``bias`` are sums over ``n`` rows of the step.
    """
    width = min(rank, PIECE)

    def piece(start: int) -> Column:
        first = start == 0
        return F.struct(
            F.lit(side).alias("side"),
            F.col(key).alias("id"),
            F.lit(start).alias("piece"),
            n.cast("double").alias("n"),
            *[F.get(gradient, F.lit(start + k)).alias(f"g{k}") for k in range(width)],
            (bias if first else F.lit(None).cast("double")).alias("g_bias"),
            *[(e if first else F.lit(None).cast("double")).alias(f"loss{n}") for n, e in enumerate(extra)],
        )

    return F.array(*[piece(start) for start in _pieces(rank)])


def _apply(model: DataFrame, messages: DataFrame, s: Settings, extra: list[Column]) -> DataFrame:
    """Average the messages per (side, id) and move the model."""
    width = min(s.rank, PIECE)
    n = F.nullif(F.sum("n"), F.lit(0.0))
    summed = messages.groupBy("side", "id", "piece").agg(
        F.array(*[F.sum(f"g{k}") / n for k in range(width)]).alias("g"), (F.sum("g_bias") / n).alias("g_bias"), *extra
    )
    names = [c for c in summed.columns if c.startswith("_")]
    # A few pieces an id; the last one is filled up with nulls.
    each = F.array_sort(F.collect_list(F.struct("piece", "g")))
    moved = summed.groupBy("side", "id").agg(
        F.slice(F.flatten(F.transform(each, lambda x: x["g"])), 1, s.rank).alias("g"),
        F.max("g_bias").alias("g_bias"),
        *[F.max(c).alias(c) for c in names],
    )
    joined = model.join(moved, ["side", "id"], "left")

    def step(now: Column, gradient: Column, penalty: float) -> Column:
        # Ids without training rows stay where they are.
        return F.coalesce(now + F.lit(s.rate) * (gradient - F.lit(penalty) * now), now)

    new_bias = step(F.col("bias"), F.col("g_bias"), s.bias_penalty) if s.learn_bias else F.col("bias")
    new = F.zip_with("factors", "g", lambda now, g: step(now, g, s.penalty))
    return joined.select(
        "side", "id", F.coalesce(new, F.col("factors")).alias("factors"), new_bias.alias("bias"), *names
    )


class Factorization:
    """Biased matrix factorisation of (user, item, value) rows.

    ``ratings`` is a written table, since every step reads it.  ``held_out``
    marks rows that are scored but not learned from.  The hot users and items
    are found once and reused in every step.
    """

    def __init__(
        self, ratings: DataFrame, user: str, item: str, value: str, settings: Settings,
        offset: float | None = None, held_out: Column | None = None,
    ):
        self.settings = settings
        held = F.lit(False) if held_out is None else held_out
        self.rows = ratings.select(
            F.col(user).alias("user"),
            F.col(item).alias("item"),
            F.col(value).cast("double").alias("value"),
            held.alias("held_out"),
        )
        if offset is None:
            offset = self.rows.where(~F.col("held_out")).agg(F.avg("value")).first()[0]
        self.offset = offset
        self.hot_users = hot_keys(self.rows, "user")
        self.hot_items = hot_keys(self.rows, "item")

    def start(self, salt: str = "start", scale: float = 1.0) -> DataFrame:
        users, items = self.rows.select("user").distinct(), self.rows.select("item").distinct()
        return materialize(start_model(users, items, self.settings.rank, salt, scale), "model")

    def scored(self, model: DataFrame) -> DataFrame:
        """The rows with both factor vectors, the prediction, error and loss."""
        s = self.settings
        rows = spread_join(self.rows, side_of(model, "u", "user", "p"), "user", ["item"], self.hot_users)
        rows = spread_join(rows, side_of(model, "i", "item", "q"), "item", ["user"], self.hot_items)
        raw = _score("p", "q", self.offset)
        predicted = sigmoid(raw) if s.link == "logit" else raw
        rows = rows.withColumn("predicted", predicted).withColumn(
            "error", F.col("value") - F.col("predicted")
        )
        loss = (
            log_loss(F.col("value"), F.col("predicted"))
            if s.link == "logit" else F.col("error") * F.col("error")
        )
        return rows.withColumn("loss", loss)

    def step(self, model: DataFrame) -> DataFrame:
        """One full-batch step; also carries the losses of the model it started from."""
        s = self.settings
        learned = ~F.col("held_out")
        error = F.when(learned, F.col("error"))
        rows = self.scored(model)
        to_user = F.transform("q", lambda x: error * x)
        to_item = F.transform("p", lambda x: error * x)
        train = F.when(learned, F.col("loss"))
        test = F.when(~learned, F.col("loss"))
        none = F.lit(None).cast("double")
        # Gradients are worked out once a row, then cut into pieces.
        one = F.when(learned, F.lit(1.0))
        rows = rows.select("user", "item", error.alias("_error"), one.alias("_one"), to_user.alias("_gu"), to_item.alias("_gi"), train.alias("_train"), test.alias("_test"))
        messages = rows.select(
            F.inline(
                F.concat(
                    _message("u", "user", F.col("_gu"), F.col("_error"), F.col("_one"), s.rank, F.col("_train"), F.col("_test")),
                    _message("i", "item", F.col("_gi"), F.col("_error"), F.col("_one"), s.rank, none, none),
                )
            )
        )
        losses = [
            f(c).alias(f"_{tag}_{name}")
            for c, name in (("loss0", "train_loss"), ("loss1", "test_loss")) for tag, f in (("sum", F.sum), ("n", F.count))
        ]
        return _apply(model.select("side", "id", "factors", "bias"), messages, s, losses)

    def epochs(self, model: DataFrame, n: int) -> Iterator[tuple[int, DataFrame, float, float]]:
        """Run ``n`` steps; yields (epoch, model, train loss, test loss) after each.

        The losses of a model fall out of the step that starts from it, so
        only the last model needs a pass of its own.  A model is deleted when
        the next one is asked for; the last stays.
        """
        current = materialize(self.step(model), "model")
        for epoch in range(1, n + 1):
            if epoch < n:
                following = materialize(self.step(current), "model")
                row = following.agg(*[F.sum(c) for c in (
                    "_sum_train_loss", "_n_train_loss", "_sum_test_loss", "_n_test_loss")]).first()
            else:
                following = None
                learned = ~F.col("held_out")
                row = materialize(self.scored(current).agg(
                    F.sum(F.when(learned, F.col("loss"))).alias("train"), F.count_if(learned).alias("n_train"),
                    F.sum(F.when(~learned, F.col("loss"))).alias("test"), F.count_if(~learned).alias("n_test"),
                ), "losses").first()
            yield epoch, current, _ratio(row[0], row[1]), _ratio(row[2], row[3])
            if following is not None:
                discard(current)
            current = following


def _ratio(total: float | None, n: int | None) -> float | None:
    return None if not n or total is None else total / n


class PairwiseRanking:
    """Pairwise ranking: a user's positive should score above a negative.

    ``rounds(epoch)`` gives the (user, positive, negative) rows of an epoch.
    Hot ids are found in the first triplets and reused: they steer how rows are
    dealt over tasks, not the result.
    """

    def __init__(self, rounds: Callable[[int], DataFrame], user: str, settings: Settings):
        self.rounds, self.user, self.settings = rounds, user, settings
        self.hot: dict[str, DataFrame | None] | None = None

    def scored(self, model: DataFrame, triplets: DataFrame) -> DataFrame:
        base = triplets.select(F.col(self.user).alias("user"), "positive", "negative")
        rows = base
        if self.hot is None:
            self.hot = {key: hot_keys(base, key) for key in ("user", "positive", "negative")}
        for key, tag, prefix, other in (
            ("user", "u", "p", "positive"), ("positive", "i", "q", "user"), ("negative", "i", "r", "user"),
        ):
            rows = spread_join(
                rows, side_of(model, tag, key, prefix), key, [other], self.hot[key]
            )
        return (
            rows.withColumn("above", array_dot(F.col("p"), F.col("q")) + F.col("q_bias"))
            .withColumn("under", array_dot(F.col("p"), F.col("r")) + F.col("r_bias"))
            .withColumn("loss", triplet_loss(F.col("above"), F.col("under")))
        )

    def step(self, model: DataFrame, epoch: int = 1) -> DataFrame:
        """One full-batch step down the mean of 1 - sigmoid(positive - negative)."""
        return self._moved(model, materialize(self.rounds(epoch), "triplets"))

    def _moved(self, model: DataFrame, triplets: DataFrame) -> DataFrame:
        s = self.settings
        rows = self.scored(model, triplets)
        pull = F.col("loss") * (F.lit(1.0) - F.col("loss"))
        none = F.lit(None).cast("double")
        rows = rows.select(
            "user", "positive", "negative", "loss", pull.alias("_pull"), (-pull).alias("_push"),
            F.zip_with("q", "r", lambda a, b: pull * (a - b)).alias("_gu"),
            F.transform("p", lambda a: pull * a).alias("_gp"),
            F.transform("p", lambda a: -pull * a).alias("_gn"),
        )
        messages = rows.select(
            F.inline(
                F.concat(
                    _message("u", "user", F.col("_gu"), F.lit(0.0), F.lit(1.0), s.rank, F.col("loss")),
                    _message("i", "positive", F.col("_gp"), F.col("_pull"), F.lit(1.0), s.rank, none),
                    _message("i", "negative", F.col("_gn"), F.col("_push"), F.lit(1.0), s.rank, none),
                )
            )
        )
        losses = [F.sum("loss0").alias("_sum_train_loss"), F.count("loss0").alias("_n_train_loss")]
        return _apply(model.select("side", "id", "factors", "bias"), messages, s, losses)

    def epochs(self, model: DataFrame, n: int) -> Iterator[tuple[int, DataFrame, float]]:
        """Run ``n`` steps; yields (epoch, model, mean loss the step started from).

        A model is deleted when the next one is written; the last stays.
        """
        for epoch in range(1, n + 1):
            triplets = materialize(self.rounds(epoch), "triplets")
            before, model = model, materialize(self._moved(model, triplets), "model")
            discard(triplets)
            if epoch > 1:
                discard(before)
            total, rows = model.agg(F.sum("_sum_train_loss"), F.sum("_n_train_loss")).first()
            yield epoch, model, _ratio(total, rows)


class WholeRanking:
    """Pairwise ranking over every triplet of a user's liked and other items.

    A triplet (u, p, n) pulls with w = l (1 - l), l its loss, and its gradient
    is w (q_p - q_n) for the user, w x_u for p and -w x_u for n.  So a step needs
    of all triplets no more than the sums of w by (user, item), and these are
    the row and column sums of small matrices: blocks of a user's liked items
    meet blocks of its other items, and a meeting leaves one row per item.
    ``rated`` holds distinct (user, item) rows, ``liked`` tells the sides.
    """

    def __init__(self, rated: DataFrame, user: str, item: str, liked: Column, settings: Settings, block: int = 1_024):
        self.settings, self.block = settings, block
        rows = rated.select(F.col(user).alias("user"), F.col(item).alias("item"), liked.alias("liked"))
        sides = rows.groupBy("user").agg(F.count_if("liked").alias("n_liked"), F.count_if(~F.col("liked")).alias("n_other"))
        sides = sides.where("n_liked > 0 and n_other > 0")
        rows = spread_join(rows, sides, "user", ["item"], hot_keys(rows, "user"))
        parts = F.ceil(F.when(F.col("liked"), F.col("n_liked")).otherwise(F.col("n_other")) / block)
        part = F.pmod(F.xxhash64("item"), parts).alias("part")
        self.rows = materialize(rows.select("user", "item", "liked", part), "rated")
        self.hot_users, self.hot_items = hot_keys(self.rows, "user"), hot_keys(self.rows, "item")

    def _with_factors(self, rows: DataFrame, model: DataFrame) -> DataFrame:
        rows = spread_join(rows, side_of(model, "u", "user", "p"), "user", ["item"], self.hot_users)
        return spread_join(rows, side_of(model, "i", "item", "q"), "item", ["user"], self.hot_items)

    def sums(self, model: DataFrame) -> DataFrame:
        """(user, item, liked, pull, loss, n): of all triplets of a user with an item the sum of w, of the losses, and how many."""
        scored = self._with_factors(self.rows, model)
        scored = scored.select("user", "item", "liked", "part", (array_dot(F.col("p"), F.col("q")) + F.col("q_bias")).alias("score"))
        blocks = materialize(
            scored.groupBy("user", "liked", "part").agg(F.array_sort(F.collect_list(F.struct("item", "score"))).alias("rows")), "blocks"
        )
        liked = blocks.where("liked").select("user", F.col("rows").alias("above"))
        other = blocks.where("not liked").select("user", F.col("rows").alias("below"))
        kinds = {c: self.rows.schema[c].dataType.simpleString() for c in ("user", "item")}

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    above, below = batch.column("above")[row].values, batch.column("below")[row].values
                    far = above.field("score").to_numpy()[:, None] - below.field("score").to_numpy()[None, :]
                    loss = 1.0 - 1.0 / (1.0 + np.exp(-far))
                    pull = loss * (1.0 - loss)
                    n, m = far.shape
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("user").take(pa.array(np.full(n + m, row))),
                            pa.concat_arrays([above.field("item"), below.field("item")]),
                            pa.array(np.arange(n + m) < n),
                            pa.array(np.concatenate([pull.sum(axis=1), -pull.sum(axis=0)])),
                            pa.array(np.concatenate([loss.sum(axis=1), np.zeros(m)])),
                            pa.array(np.concatenate([np.full(n, m), np.full(m, n)]).astype(np.int64)),
                        ],
                        names=["user", "item", "liked", "pull", "loss", "n"],
                    )

        met = liked.join(other, "user").mapInArrow(
            meet, f"user {kinds['user']}, item {kinds['item']}, liked boolean, pull double, loss double, n bigint"
        )
        return met.groupBy("user", "item", "liked").agg(*[F.sum(c).alias(c) for c in ("pull", "loss", "n")])

    def step(self, model: DataFrame, sums: DataFrame | None = None) -> DataFrame:
        """One full-batch step down the mean loss of all triplets."""
        s = self.settings
        rows = self._with_factors(self.sums(model) if sums is None else sums, model)
        of_user = F.when(F.col("liked"), F.col("n")).otherwise(F.lit(0))
        none = F.lit(None).cast("double")
        rows = rows.select(
            "user", "item", "pull", "n", of_user.cast("double").alias("_n"), F.when(F.col("liked"), F.col("loss")).alias("_loss"),
            F.transform("q", lambda x: F.col("pull") * x).alias("_gu"), F.transform("p", lambda x: F.col("pull") * x).alias("_gi"),
        )
        messages = rows.select(
            F.inline(
                F.concat(
                    _message("u", "user", F.col("_gu"), F.lit(0.0), F.col("_n"), s.rank, F.col("_loss"), F.col("_n")),
                    _message("i", "item", F.col("_gi"), F.col("pull"), F.col("n"), s.rank, none, none),
                )
            )
        )
        losses = [F.sum("loss0").alias("_sum_train_loss"), F.sum("loss1").alias("_n_train_loss")]
        return _apply(model.select("side", "id", "factors", "bias"), messages, s, losses)

    def loss(self, model: DataFrame) -> tuple[float | None, int]:
        """Mean loss of all triplets, and how many there are."""
        total, n = self.sums(model).where("liked").agg(F.sum("loss"), F.coalesce(F.sum("n"), F.lit(0))).first()
        return _ratio(total, n), n

    def epochs(self, model: DataFrame, n: int) -> Iterator[tuple[int, DataFrame, float | None]]:
        """Run ``n`` steps; yields (epoch, model, mean loss of all triplets the step started from)."""
        spark = model.sparkSession
        for epoch in range(1, n + 1):
            with temporary(spark) as keep:
                before, model = model, keep(self.step(model), "model")
            if epoch > 1:
                discard(before)
            total, rows = model.agg(F.sum("_sum_train_loss"), F.sum("_n_train_loss")).first()
            yield epoch, model, _ratio(total, rows)
