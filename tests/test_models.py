import math
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillwise.functions.scores import network_probability as network_column
from tillwise.operators import evaluation
from tillwise.plans import factorization as mf
from tillwise.plans import learners, scoring
from tillwise.scratch import discard, materialize

U, I = "customer_id", "product_id"
RNG = np.random.default_rng(3)
NU, NI, RANK = 23, 41, 3
P, Q = RNG.normal(size=(NU, RANK)), RNG.normal(size=(NI, RANK))
BU, BI = RNG.normal(size=NU), RNG.normal(size=NI)
Q[5] = Q[6]
BI[5] = BI[6]  # a tie for every user
SCORES = P @ Q.T + BU[:, None] + BI[None, :] + 0.5


def side(spark, key, matrix, biases):
    rows = [(n, matrix[n].tolist(), float(biases[n])) for n in range(len(matrix))]
    return materialize(spark.createDataFrame(rows, f"{key} bigint, factors array<double>, bias double"))


@pytest.fixture(scope="module")
def users(spark):
    return side(spark, U, P, BU)


@pytest.fixture(scope="module")
def items(spark):
    return side(spark, I, Q, BI)


def best(u, k, gone=(), below=np.inf):
    s = np.round(SCORES[u], 9)
    order = sorted((i for i in range(NI) if i not in gone and s[i] < below), key=lambda i: (-s[i], i))
    return order[:k]


def listed(df):
    out = {}
    for r in df.orderBy(U, "position").collect():
        out.setdefault(r[U], []).append(r[I])
    return out


@pytest.mark.parametrize("slice_bytes", [10**9, 5 * 8 * 9])
@pytest.mark.parametrize("k", [1, 4, 100])
def test_top_n_equals_brute_force_with_ties(users, items, slice_bytes, k):
    got = listed(scoring.top_n(users, items, k, offset=0.5, slice_bytes=slice_bytes))
    assert got == {u: best(u, k) for u in range(NU)}


@pytest.mark.parametrize("slice_bytes", [10**9, 5 * 8 * 9])
def test_top_n_leaves_out_bought_items_and_saturated_scores(spark, users, items, slice_bytes):
    gone = {(0, i) for i in range(NI)} | {(u, best(u, 1)[0]) for u in range(1, 10)}
    bought = spark.createDataFrame(sorted(gone), f"{U} bigint, {I} bigint")
    got = listed(scoring.top_n(users, items, 3, offset=0.5, exclude=bought, below=1.0, slice_bytes=slice_bytes))
    want = {u: best(u, 3, {i for v, i in gone if v == u}, 1.0) for u in range(NU)}
    assert got == {u: l for u, l in want.items() if l}


@pytest.mark.parametrize("slice_bytes", [10**9, 5 * 8 * 9])
def test_excluded_items_outside_the_catalogue_change_nothing(spark, users, items, slice_bytes):
    gone = [(u, i) for u in range(NU) for i in (-5, NI, NI + 50)] + [(0, best(0, 1)[0])]
    some = items.where(f"{I} % 3 <> 1")
    gone += [(u, i) for u in range(NU) for i in range(NI) if i % 3 == 1]
    bought = spark.createDataFrame(gone, f"{U} bigint, {I} bigint")
    got = listed(scoring.top_n(users, some, 3, offset=0.5, exclude=bought, slice_bytes=slice_bytes))
    out = {i for i in range(NI) if i % 3 == 1}
    assert got == {u: best(u, 3, out | ({best(0, 1)[0]} if u == 0 else set())) for u in range(NU)}


@pytest.mark.parametrize("slice_bytes", [10**9, 5 * 8 * 9])
def test_score_summary(users, items, slice_bytes):
    got = {r[U]: r for r in scoring.score_summary(users, items, offset=0.5, slice_bytes=slice_bytes).collect()}
    for u in range(NU):
        row = got[u]
        assert row.n_items == NI
        assert (row.mean_score, row.least_score, row.best_score) == pytest.approx(
            (SCORES[u].mean(), SCORES[u].min(), SCORES[u].max())
        )


@pytest.mark.parametrize("slice_bytes", [10**9, 5 * 8 * 9])
def test_nearest_equals_brute_force(users, items, slice_bytes):
    got = scoring.nearest(users, items.repartition(4), 5, U, I, slice_bytes=slice_bytes)
    got = {u: l for u, l in listed(got).items()}
    plain = SCORES - 0.5
    for u in range(NU):
        s = np.round(plain[u], 9)
        assert got[u] == sorted(range(NI), key=lambda i: (-s[i], i))[:5]


def naive_auc(u, true):
    other = [i for i in range(NI) if i not in true]
    s = np.round(SCORES[u], 9)
    wins = [(s[t] > s[o]) + 0.5 * (s[t] == s[o]) for t in true for o in other]
    return float(np.mean(wins))


@pytest.mark.parametrize("slice_bytes", [10**9, 5 * 8 * 9])
def test_auc_equals_all_pairs_with_ties_and_a_hot_user(spark, users, items, slice_bytes):
    truth = {(u, (u * 5 + j) % NI) for u in range(1, 12) for j in range(3)} | {(2, 5), (3, 6)}
    truth |= {(0, i) for i in range(35)}  # most of the catalogue
    truth |= {(13, i) for i in range(NI)}  # no untrue item: no AUC
    df = spark.createDataFrame(sorted(truth), f"{U} bigint, {I} bigint")
    places = scoring.true_item_places(df, users, items, offset=0.5, slice_bytes=slice_bytes)
    got = evaluation.mean_auc(places, NI).first()
    want = [naive_auc(u, {i for v, i in truth if v == u}) for u in range(12)]
    assert got.users == 12
    assert got.auc == pytest.approx(np.mean(want))


def test_confusion_by_hand(spark):
    predicted = spark.createDataFrame([(0, 1), (0, 2), (1, 1)], f"{U} int, {I} int")
    real = spark.createDataFrame([(0, 1), (0, 1), (2, 3)], f"{U} int, {I} int")  # one pair twice
    users, items = spark.range(4).toDF(U), spark.range(5).toDF(I)
    row = evaluation.topk_confusion(predicted, real, users, items).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 2, 1, 16)
    assert row.tp + row.fp + row.fn + row.tn == 20
    assert (row.precision, row.recall, row.hit_rate) == pytest.approx((1 / 3, 1 / 2, 1 / 4))
    both = evaluation.topk_confusion(
        predicted, real, users, items, truths={"a_": F.col(U) == 0, "b_": F.lit(True)}
    )
    row = both.first()
    assert (row.a_tp, row.a_fn, row.a_tn, row.b_tp, row.b_fn, row.b_tn) == (1, 0, 17, 1, 1, 16)
    assert [r.fn for r in evaluation.fold_rows(both, ["a_", "b_"]).collect()] == [0, 1]
    none = evaluation.topk_confusion(predicted.limit(0), real, users, items).first()
    assert none.precision is None and none.recall == 0 and none.hit_rate == 0


def test_map_at_k_by_hand(spark):
    predicted = spark.createDataFrame(
        [(0, 7, 1), (0, 8, 2), (0, 9, 3), (1, 7, 1)], f"{U} int, {I} int, position int"
    )
    truth = spark.createDataFrame([(0, 7), (0, 9), (1, 8), (2, 1)], f"{U} int, {I} int")
    row = evaluation.map_at_k(predicted, truth, 3).first()
    assert row.users == 3
    assert row.map_at_k == pytest.approx(((1 + 2 / 3) / 2 + 0 + 0) / 3)
    capped = evaluation.map_at_k(predicted, truth, 1).first()
    assert capped.map_at_k == pytest.approx(1 / 3)


def test_errors_binary_metrics_and_fold_average(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.6), (1.0, 0.2), (0.0, 0.1)], "y double, p double")
    row = evaluation.mean_error(df, "y", "p").first()
    assert (row.mae, row.mse) == pytest.approx((0.4, (0.01 + 0.36 + 0.64 + 0.01) / 4))
    row = evaluation.binary_metrics(df, "y", "p").first()
    assert (row.accuracy, row.tp, row.fp, row.tn, row.fn) == (0.5, 1, 1, 1, 1)
    assert row.log_loss == pytest.approx(-np.mean(np.log([0.9, 0.4, 0.2, 0.9])))
    folds = spark.createDataFrame([(0.5, 1.0), (0.7, 3.0)], "a double, b double")
    assert tuple(evaluation.fold_average(folds, ["a", "b"]).first()) == pytest.approx((0.6, 2.0, 2))


def planted(spark):
    true_p, true_q = RNG.normal(size=(30, 2)), RNG.normal(size=(25, 2))
    rows = [
        (u, i, float(3 + true_p[u] @ true_q[i]), bool((u * 7 + i * 3) % 5 == 0))
        for u in range(30) for i in range(25)
    ]
    return spark.createDataFrame(rows, "u bigint, i bigint, r double, test boolean")


def numpy_step(rows, p, q, bu, bi, g, s):
    errors = {(r.u, r.i): r.r - (g + bu[r.u] + bi[r.i] + p[r.u] @ q[r.i]) for r in rows if not r.test}
    new_p, new_q, new_bu, new_bi = p.copy(), q.copy(), bu.copy(), bi.copy()
    for u in range(len(p)):
        mine = [(e, i) for (v, i), e in errors.items() if v == u]
        new_p[u] += s.rate * (np.mean([e * q[i] for e, i in mine], axis=0) - s.penalty * p[u])
        new_bu[u] += s.rate * (np.mean([e for e, _ in mine]) - s.bias_penalty * bu[u])
    for i in range(len(q)):
        mine = [(e, u) for (u, j), e in errors.items() if j == i]
        new_q[i] += s.rate * (np.mean([e * p[u] for e, u in mine], axis=0) - s.penalty * q[i])
        new_bi[i] += s.rate * (np.mean([e for e, _ in mine]) - s.bias_penalty * bi[i])
    return new_p, new_q, new_bu, new_bi


def arrays(model, rank):
    frame = model.select("side", "id", "factors", "bias").toPandas().sort_values(["side", "id"])
    split = [frame[frame.side == x] for x in "ui"]
    assert {len(f) for f in frame.factors} == {rank}
    return [np.array(s.factors.tolist()) for s in split] + [s.bias.to_numpy() for s in split]


def test_two_steps_equal_numpy_and_the_loss_falls(spark):
    df = materialize(planted(spark))
    rows = df.collect()
    s = mf.Settings(rank=2, rate=0.2, penalty=0.01, bias_penalty=0.01)
    fit = mf.Factorization(df, "u", "i", "r", s, held_out=F.col("test"))
    start = fit.start()
    p, q, bu, bi = arrays(start, 2)
    for _ in range(2):
        p, q, bu, bi = numpy_step(rows, p, q, bu, bi, fit.offset, s)
    history = list(fit.epochs(start, 2))
    for got, want in zip(arrays(history[-1][1], 2), (p, q, bu, bi), strict=True):
        assert np.allclose(got, want)
    predicted = fit.offset + bu[:, None] + bi[None, :] + p @ q.T
    train = np.mean([(r.r - predicted[r.u, r.i]) ** 2 for r in rows if not r.test])
    test = np.mean([(r.r - predicted[r.u, r.i]) ** 2 for r in rows if r.test])
    assert history[-1][2:] == pytest.approx((train, test))
    assert history[1][2] < history[0][2]
    kept, gone = (Path(m.inputFiles()[0].removeprefix("file:")).exists() for m in (history[-1][1], history[0][1]))
    assert kept and not gone


def test_only_tables_of_the_application_are_discarded(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        discard(spark.read.parquet(str(tmp_path / "other")))
    assert spark.read.parquet(str(tmp_path / "other")).count() == 3


def test_biases_can_be_left_out_and_unseen_ids_stay(spark):
    df = spark.createDataFrame([(0, 0, 1.0, False), (1, 1, 2.0, True)], "u int, i int, r double, test boolean")
    fit = mf.Factorization(df, "u", "i", "r", mf.Settings(rank=2, learn_bias=False), held_out=F.col("test"))
    start = fit.start()
    before, after = arrays(start, 2), arrays(fit.step(start), 2)
    assert np.all(after[2] == 0) and np.all(after[3] == 0)
    assert np.array_equal(before[0][1], after[0][1])
    assert not np.array_equal(before[0][0], after[0][0])


def test_steps_with_split_hot_users_give_the_same_model(spark):
    df = materialize(planted(spark))
    s = mf.Settings(rank=2, rate=0.2)
    plain = mf.Factorization(df, "u", "i", "r", s)
    split = mf.Factorization(df, "u", "i", "r", s)
    split.hot_users = spark.createDataFrame([(0, 4), (7, 3)], "user bigint, _fan int")
    split.hot_items = spark.createDataFrame([(2, 5)], "item bigint, _fan int")
    start = plain.start()
    for a, b in zip(arrays(plain.step(start), 2), arrays(split.step(start), 2), strict=True):
        assert np.allclose(a, b)


def test_logistic_link_learns(spark):
    rows = [(u, i, float((u < 5) == (i < 5))) for u in range(10) for i in range(10)]
    df = materialize(spark.createDataFrame(rows, "u int, i int, y double"))
    fit = mf.Factorization(df, "u", "i", "y", mf.Settings(rank=2, rate=4.0, penalty=0.0, link="logit"), offset=0.0)
    losses = [train for _, _, train, _ in fit.epochs(fit.start(), 6)]
    assert losses[-1] < losses[0]


def test_pairwise_ranking_loss_falls(spark):
    from tillwise.operators.triplets import RatedTriplets

    rows = [(u, i, float((u + i) % 2 * 5)) for u in range(8) for i in range(8)]
    rated = materialize(spark.createDataFrame(rows, "u bigint, i bigint, r double"))
    made = RatedTriplets(rated, "u", "i", F.col("r") > 3)
    ranker = mf.PairwiseRanking(lambda e: made.rounds([0, 1]), "u", mf.Settings(rank=2, rate=3.0, penalty=0.0))
    start = materialize(mf.start_model(rated.select("u").distinct(), rated.select("i").distinct(), 2))
    history = list(ranker.epochs(start, 4))
    assert history[-1][2] < history[0][2]
    assert start.count() == history[-1][1].count() == 16  # the caller's start stays


def test_retrieval_beats_chance_on_two_blocks(spark):
    rows = [(u, i, 1.0) for u in range(20) for i in range(20) if (u % 2) == (i % 2) and (u + i) % 3]
    df = materialize(spark.createDataFrame(rows, f"{U} int, {I} int, n double"))
    users, items = learners.retrieval_factors(df, U, I, "n", rank=4)
    top = scoring.top_n(users, items, 5)
    same = top.where(F.col(U) % 2 == F.col(I) % 2).count() / top.count()
    assert same > 0.9


def test_network_learns_the_blocks(spark):
    rows = [(u, i, float((u % 2) == (i % 2))) for u in range(12) for i in range(12)]
    df = spark.createDataFrame(rows, f"{U} bigint, {I} bigint, label double")
    signs = [[1.0, 0.2], [-1.0, 0.2]]
    users = spark.createDataFrame([(u, signs[u % 2], 0.0) for u in range(12)], f"{U} bigint, factors array<double>, bias double")
    items = spark.createDataFrame([(i, signs[i % 2], 0.0) for i in range(12)], f"{I} bigint, factors array<double>, bias double")
    crossed = learners.crossed_features(df, users, items, U, I)
    network = learners.fit_network(crossed, "label", 2, hidden=(5,), rounds=60)
    out = learners.network_probability(network, crossed)
    row = evaluation.binary_metrics(out, "label", "probability").first()
    assert row.accuracy > 0.95
    # The blockwise forward pass gives the probabilities of the fitted model.
    top = learners.network_top_n(network, materialize(users), materialize(items), 12, U, I)
    both = top.join(out, [U, I])
    assert both.count() == 144
    assert both.agg(F.max(F.abs(F.col("score") - F.col("probability")))).first()[0] < 1e-8


@pytest.mark.parametrize("odd", [None, math.nan, math.inf])
def test_summary_leaves_out_blocks_and_changes_nothing(spark, odd):
    """Items whose lengths fall off steeply; with a number that is not finite every pair of blocks is met."""
    rng = np.random.default_rng(6)
    q = rng.normal(size=(400, 4)) * np.exp(-np.arange(400) / 40)[:, None]
    p, b, c = rng.normal(size=(60, 4)), rng.normal(size=60), rng.normal(size=400) * 0.01
    if odd is not None:
        q[300, 1] = odd
    users, items = side(spark, U, p, b), side(spark, I, q, c)
    met = {}
    few = scoring.score_summary(users, items, offset=0.25, slice_bytes=7 * 8 * 20, met=met).orderBy(U).collect()
    whole = scoring.score_summary(users, items, offset=0.25).orderBy(U).collect()
    assert bool(met) == (odd is None) and (odd is not None or met["joined"] < met["possible"] / 2)
    with np.errstate(invalid="ignore"):
        scores = p @ q.T + b[:, None] + c + 0.25
    for one, other, s in zip(few, whole, scores, strict=True):
        assert one.n_items == other.n_items == 400
        if odd is None:
            assert list(one)[2:] == pytest.approx([s.mean(), s.min(), s.max()])
            assert list(one)[2:] == pytest.approx(list(other)[2:])
        else:
            assert not math.isfinite(one.mean_score) and not math.isfinite(other.mean_score)


@pytest.mark.parametrize("k", [1, 7])
def test_bounds_leave_out_blocks_and_change_nothing(spark, k):
    """Lengths that fall off steeply: most pairs of blocks are not joined, and the table is the same."""
    rng = np.random.default_rng(4)
    q = rng.normal(size=(400, 4)) * np.exp(-np.arange(400) / 40)[:, None]
    q[200:230] = q[180]  # equal items over the edge of a block
    p = rng.normal(size=(60, 4))
    users = side(spark, U, p, rng.normal(size=60) * 0.01)
    items = side(spark, I, q, rng.normal(size=400) * 0.01)
    gone = spark.createDataFrame([(u, i) for u in range(0, 60, 7) for i in range(0, 30)], f"{U} bigint, {I} bigint")
    met = {}
    some = {"offset": 0.25, "exclude": gone, "below": 3.0, "slice_bytes": 7 * 8 * 20}
    pruned = scoring.top_n(users, items, k, met=met, **some)
    plain = scoring.top_n(users, items, k, prune=False, **some)
    whole = scoring.top_n(users, items, k, **(some | {"slice_bytes": 10**9}))
    want = sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, pruned.collect())) == sorted(map(tuple, plain.collect())) == want
    assert met["joined"] < met["possible"] * (0.5 if k == 1 else 0.67) and len(want) == 60 * k


def test_ids_may_be_texts(spark):
    name = lambda tag, n: f"{tag}-{n:03d}ü"
    users = materialize(spark.createDataFrame([(name("u", u), P[u].tolist(), float(BU[u])) for u in range(NU)], f"{U} string, factors array<double>, bias double"))
    items = materialize(spark.createDataFrame([(name("i", i), Q[i].tolist(), float(BI[i])) for i in range(NI)], f"{I} string, factors array<double>, bias double"))
    bought = spark.createDataFrame([(name("u", u), name("i", best(u, 1)[0])) for u in range(5)] + [("nobody", "nothing")], f"{U} string, {I} string")
    for size in (10**9, 5 * 8 * 9):
        got = listed(scoring.top_n(users, items, 3, offset=0.5, exclude=bought, slice_bytes=size))
        assert got == {name("u", u): [name("i", i) for i in best(u, 3, {best(u, 1)[0]} if u < 5 else ())] for u in range(NU)}
        truth = spark.createDataFrame([(name("u", u), name("i", (u * 5) % NI)) for u in range(NU)], f"{U} string, {I} string")
        places = {r[U]: r for r in scoring.true_item_places(truth, users, items, offset=0.5, slice_bytes=size).collect()}
        for u in range(NU):
            s = np.round(SCORES[u], 9)
            row = places[name("u", u)]
            assert (row.below, row.equal) == ((s < s[(u * 5) % NI]).sum(), (s == s[(u * 5) % NI]).sum())
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0)], "u string, i string, r double")
    fit = mf.Factorization(materialize(rows), "u", "i", "r", mf.Settings(rank=2, rate=0.1))
    *_, (_, model, _, _) = fit.epochs(fit.start(), 2)
    assert {(r.side, r.id) for r in model.collect()} == {("u", "a"), ("u", "b"), ("i", "x"), ("i", "y")}


@pytest.mark.parametrize("rank", [50, 350])
def test_a_step_at_full_rank_equals_numpy(spark, rank):
    """The ranks of full models: gradients in several pieces, planned in a moment."""
    import time

    df = materialize(planted(spark).where("u < 6 and i < 5"))
    rows = df.collect()
    s = mf.Settings(rank=rank, rate=0.2, penalty=0.01, bias_penalty=0.01)
    fit = mf.Factorization(df, "u", "i", "r", s, held_out=F.col("test"))
    start = fit.start()
    before = arrays(start, rank)
    began = time.perf_counter()
    step = fit.step(start)
    step._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 10
    want = numpy_step(rows, *before, fit.offset, s)
    for got, expected in zip(arrays(step, rank), want, strict=True):
        assert np.allclose(got, expected)


def test_predictions_keep_rows_with_unknown_ids(spark):
    model = spark.createDataFrame(
        [("u", 1, [1.0, 2.0], 0.5), ("i", 7, [3.0, 0.5], 0.25)], "side string, id bigint, factors array<double>, bias double"
    )
    rows = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (2, 8), (None, 7)], "u bigint, i bigint")
    got = {(r.u, r.i): r.score for r in mf.predict(rows, model, "u", "i", offset=3.0).collect()}
    assert got == {(1, 7): 7.75, (1, 8): 3.5, (2, 7): 3.25, (2, 8): 3.0, (None, 7): 3.25}


def dense_implicit(rows, start, rank, rounds, alpha, penalty):
    """Items' start factors to user and item factors by whole matrices."""
    users, items = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    y = np.array([start[i] for i in items])
    x = None
    for _ in range(rounds):
        for own, other, at in ((users, items, 0), (items, users, 1)):
            z = y if at == 0 else x
            gram = z.T @ z
            out = []
            for o in own:
                mine = [r for r in rows if r[at] == o]
                v = np.array([z[other.index(r[1 - at])] for r in mine])
                c = alpha * np.array([r[2] for r in mine])
                left = gram + (v * c[:, None]).T @ v + penalty * len(mine) * np.eye(rank)
                out.append(np.linalg.solve(left, ((1 + c)[:, None] * v).sum(axis=0)))
            if at == 0:
                x = np.array(out)
            else:
                y = np.array(out)
    return dict(zip(users, x, strict=True)), dict(zip(items, y, strict=True))


@pytest.mark.parametrize("hot", [False, True])
def test_implicit_factors_equal_dense_solves(spark, hot):
    """Ids beyond 2**31; with ``hot`` the user and the item that hold half of all rows are cut over tasks."""
    rng = np.random.default_rng(8)
    big = 2**40
    rows = [(big, big + i, float(rng.integers(1, 9))) for i in range(30)]
    rows += [(big + u, big + int(i), float(rng.integers(1, 9))) for u in range(1, 12) for i in rng.choice(30, 4, replace=False)]
    rows += [(big + u, big + 1, 1.0) for u in range(12, 40)]
    df = spark.createDataFrame(rows, "u bigint, i bigint, s double").repartition(5)
    fit = learners.Implicit(df, "u", "i", "s", rank=3, alpha=0.5, penalty=0.2)
    if hot:
        fit.hot = {
            "user": spark.createDataFrame([(big, 4)], "user bigint, _fan int"),
            "item": spark.createDataFrame([(big + 1, 3), (big + 2, 2)], "item bigint, _fan int"),
        }
    start = {r.item: r.factors for r in fit.start("item").collect()}
    users, items = fit.fit(2)
    want = dense_implicit(rows, start, 3, 2, 0.5, 0.2)
    for table, key, expected in ((users, "u", want[0]), (items, "i", want[1])):
        got = {r[key]: r.factors for r in table.collect()}
        assert got.keys() == expected.keys()
        for k, v in got.items():
            assert np.allclose(v, expected[k])
    named = learners.Implicit(df.select(F.col("u").cast("string"), F.concat(F.lit("x"), "i").alias("i"), "s"), "u", "i", "s", rank=2)
    assert named.fit(1)[0].count() == len(want[0])


@pytest.mark.parametrize("below", [None, 0.2])
def test_boxes_find_the_best_as_all_scores_do(below):
    rng = np.random.default_rng(6)
    q = np.round(rng.normal(size=(3000, 3)), 1)  # many equal scores
    q[7], bias = np.nan, np.round(rng.normal(size=3000), 1)
    p, shift = np.round(rng.normal(size=(40, 3)), 1), np.round(rng.normal(size=40), 1)
    gone = np.array([(u, i) for u in range(0, 40, 3) for i in range(u, 3000, 7)]).T
    boxes = scoring.Boxes(scoring.Block(pa.array(np.arange(3000)), q, bias))
    scores = np.round(p @ q.T + bias + shift[:, None], 9)
    scores[:, 7] = scores[tuple(gone)] = -np.inf
    if below is not None:
        scores[scores >= below] = -np.inf
    for k in (1, 6, 200):
        row, at, score, position = boxes.search(p, shift, k, np.full(40, -np.inf), below, gone)
        want = [np.lexsort((np.arange(3000), -s))[: min(k, np.isfinite(s).sum())] for s in scores]
        assert [at[row == u].tolist() for u in range(40)] == [w.tolist() for w in want]
        assert position.tolist() == [n + 1 for w in want for n in range(len(w))]
        assert np.round(score, 9) == pytest.approx(np.concatenate([s[w] for s, w in zip(scores, want, strict=True)]), abs=2e-9)


@pytest.mark.parametrize("below", [None, 1.0])
def test_single_precision_loses_no_item_at_an_edge(below, monkeypatch):
    """Scores that single precision cannot tell from the bound or the k-th one are worked out, however large the biases are."""
    rng = np.random.default_rng(9)
    p, q = rng.normal(size=(300, 5)), rng.normal(size=(2_000, 5))
    q[:600] = q[0] + rng.normal(size=(600, 5)) * 1e-8
    q[600:900] = q[0]
    shift = 1.0 - p @ q[0] + rng.choice([0.0, 1e-9, -1e-9, 3e-8], size=300)
    shift[:40] += 1e5 - p[:40] @ q[0]
    biases = np.zeros(2_000)
    biases[1_000:] = -1e5
    block = scoring.Block(pa.array(np.arange(2_000)), q, biases)
    monkeypatch.setattr(scoring, "ROWS_IN_SINGLE", 1)
    row, place, _, position = scoring.Boxes(block).search(p, shift, 20, np.full(300, -np.inf), below)
    rounded = np.round(np.einsum("ij,kj->ik", p, q) + biases + shift[:, None], 9)
    for r in range(300):
        fit = np.flatnonzero(rounded[r] < (np.inf if below is None else below))
        want = fit[np.lexsort((fit, -rounded[r, fit]))][:20]
        got = place[row == r][np.argsort(position[row == r])]
        assert rounded[r, got] == pytest.approx(rounded[r, want], abs=2e-9)
        assert len(got) == len(want)


def test_excluded_places_meet_no_items(spark, users, items, monkeypatch):
    """A row with an item block is not shuffled once more to meet the excluded places."""
    met, joined = [], scoring.Catalogue.joined
    monkeypatch.setattr(scoring.Catalogue, "joined", lambda self, others, n: met.append(others.columns) or joined(self, others, n))
    bought = spark.createDataFrame([(1, 1)], f"{U} bigint, {I} bigint")
    scoring.top_n(users, items, 3, exclude=bought, slice_bytes=5 * 8 * 9)
    assert len(met) == 2 and all("gone" in columns for columns in met)


@pytest.mark.parametrize("steep", [0.5, 30.0])
def test_screened_network_scores_are_the_dense_ones(steep):
    """Also where the network saturates and many rounded probabilities are equal."""
    rng = np.random.default_rng(8)
    layers = [(rng.normal(size=(b, a)) * steep, rng.normal(size=b)) for a, b in ((9, 12), (12, 5), (5, 2))]
    scorer = scoring.network_probability(layers)
    items = scoring.Block(pa.array(np.arange(2500)), np.round(rng.normal(size=(2500, 3)), 1), np.zeros(2500))
    items.factors[11] = np.nan
    rows = scoring.Block(pa.array(np.arange(6)), rng.normal(size=(6, 3)), np.zeros(6))
    rows.factors[5] = np.nan
    gone = np.array([(u, i) for u in range(4) for i in range(u, 2500, 5)]).T
    for below in (None, 1.0, 0.6):
        for reach in (np.full(6, -np.inf), np.full(6, 0.55)):
            some = (rows, items, scorer, 7, reach, below, gone)
            for a, b in zip(scoring._screened(*some), scoring._dense(*some), strict=True):
                assert a.tolist() == pytest.approx(b.tolist(), abs=2e-9)
    assert len(scoring._screened(rows, items, scorer, 7, np.full(6, -np.inf), None, gone)[0]) == 35


def test_places_are_counted_like_sorted_scores(monkeypatch):
    """Scores in bins, with equal ones, thresholds at both ends and bins too narrow to tell."""
    rng = np.random.default_rng(3)
    spread = rng.normal(size=20_000)
    spread[:500] = spread[500]
    for scores in (spread, spread * 1e-9, np.full(50, 0.25), np.append(spread, np.inf)):
        own = np.round(np.concatenate([scores[:40], [scores.min(), scores[:50].max() + 1]]), 9)
        ordered = np.sort(np.round(scores, 9))
        left = np.searchsorted(ordered, own, "left")
        below, equal = scoring._places(scores.copy(), own)
        assert below.tolist() == left.tolist() and equal.tolist() == (np.searchsorted(ordered, own, "right") - left).tolist()
    sorted_ones, sort = [], np.sort
    monkeypatch.setattr(scoring.np, "sort", lambda a, **k: sorted_ones.append(len(a)) or sort(a, **k))
    scoring._places(spread, np.round(spread[1000:1010], 9))
    assert sum(sorted_ones) < 2_000  # not all 20,000


def test_places_are_told_by_single_precision(monkeypatch):
    """Only scores near a given one are worked out in double precision; all counts are those of sorted scores."""
    rng = np.random.default_rng(5)
    wide, ties = rng.random((20_000, 4)) - 0.5, np.round(rng.random((20_000, 4)), 1)
    endless = wide.copy()
    endless[7, 1] = np.inf
    for factors in (wide, ties, wide * 1e-12, wide * 1e200, endless, wide[:1], wide[:0]):
        block = scoring.Block(pa.array(np.arange(len(factors))), factors, np.round(rng.random(len(factors)), 2))
        rows, shift = np.vstack([rng.random((3, 4)) + 0.1, np.zeros((1, 4))]), np.array([0.5, -1.0, 0.0, 2.0])
        scores = [factors @ p + block.biases + b for p, b in zip(rows, shift, strict=True)]
        own = [np.round(np.append(s[:30], [-9.0, 0.7, 9.0]), 9) for s in scores]
        for (below, equal), s, o in zip(scoring._Places(block).count(rows, shift, own), scores, own, strict=True):
            ordered = np.sort(np.round(s, 9))
            left = np.searchsorted(ordered, o, "left")
            assert below.tolist() == left.tolist()
            assert equal.tolist() == (np.searchsorted(ordered, o, "right") - left).tolist()
    block, sorted_ones, sort = scoring.Block(pa.array(np.arange(20_000)), wide, np.zeros(20_000)), [], np.sort
    own = [np.round(wide[:20] @ wide[0], 9)]
    monkeypatch.setattr(scoring.np, "sort", lambda a, **k: sorted_ones.append(len(a)) or sort(a, **k))
    list(scoring._Places(block).count(wide[:1], np.zeros(1), own))
    assert sum(sorted_ones) < 200  # not all 20,000


def test_network_column_works_on_batches_of_rows(spark):
    """As plain Python, row by row; NULLs and other lengths give NULL."""
    layers = [[[0.5, -1.0, 0.25], [2.0, 0.1, 0.0], [-0.3, 0.7, -1.0]], [[1.0, -2.0, 0.5, 0.1], [0.3, 0.4, -0.5, 0.0]]]
    rows = [[1.0, 2.0], None, [0.5, None], [3.0], [1.0, 2.0, 3.0], [], [-900.0, 900.0], [0.0, 0.0]]
    df = spark.createDataFrame([(n, x) for n, x in enumerate(rows)], "n int, x array<double>").repartition(1).select(
        "n", network_column("x", layers).alias("p"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()

    def sigmoid(x):
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

    def plain(x):
        if x is None or len(x) != 2 or None in x:
            return None
        h = [sigmoid(sum(a * b for a, b in zip(w, [*x, 1.0], strict=True))) for w in layers[0]]
        no, yes = (sum(a * b for a, b in zip(w, [*h, 1.0], strict=True)) for w in layers[1])
        return sigmoid(yes - no)

    for r in df.collect():
        want = plain(rows[r.n])
        assert r.p == (None if want is None else pytest.approx(want, abs=1e-12))
