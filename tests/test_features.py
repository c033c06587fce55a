import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.functions import ratings, scores
from tillwise.operators import features


def d(y, m=1, day=1):
    return dt.date(y, m, day)


@pytest.fixture(scope="module")
def purchases(spark):
    return spark.createDataFrame(
        [
            ("b", "y", 2.0, d(2020, 1, 5)), ("b", "y", 3.0, d(2020, 1, 1)), ("a", "z", 1.0, d(2021)),
            ("a", "x", None, d(2021)), (None, "x", 4.0, d(2021)), ("c", None, 4.0, d(2021)),
        ],
        "customer_id string, material string, quantity double, calday date",
    )


def test_interaction_features(purchases):
    got = {(r.customer_id, r.material): r for r in features.interaction_features(purchases).collect()}
    assert set(got) == {("a", "x"), ("a", "z"), ("b", "y")}  # NULL keys form no group
    by = got[("b", "y")]
    assert (by.transaction_count, by.quantity_sum, by.time_diff_days) == (2, 5.0, 4)
    assert (by.normalized_customer_id, by.product_id) == (1, 2)
    assert got[("a", "x")].transaction_count == 0  # counts present quantities only


def test_customer_material_quantity(purchases):
    got = sorted(tuple(r) for r in features.customer_material_quantity(purchases.dropna()).collect())
    assert got == [("a", "z", 0, 1.0), ("b", "y", 1, 5.0)]


def test_first_present_value_per_column(spark):
    df = spark.createDataFrame(
        [(1, 0, None, "a"), (1, 1, 5, None), (1, 2, 6, "b"), (2, 0, None, None)], "k int, o int, x int, y string"
    )
    got = sorted(tuple(r) for r in features.first_present(df, ["k"], F.col("o"), ["x", "y"]).collect())
    assert got == [(1, 5, "a"), (2, None, None)]


def test_profile(spark):
    rows = [(i, d(2020, 1, i + 1), s) for i, s in enumerate([0, 5, -2, 7])]
    df = spark.createDataFrame(rows, "n int, first_purchase date, time_diff_days int")
    got = features.profile(df, "first_purchase", "n").first()
    assert tuple(got) == (d(2020, 1, 1), d(2020, 1, 2), d(2020, 1, 4), 2, 4, 2, 1, 1)


def test_shift_years_uses_each_columns_own_difference(spark):
    rows = [(0, d(2018), d(2018)), (1, d(2019), d(2020, 2, 29)), (2, d(2020, 2, 29), d(2021))]
    df = spark.createDataFrame(rows, "n int, a date, b date")
    got = [tuple(r) for r in features.shift_years(df, ["a", "b"], "n").orderBy("n").collect()]
    assert got == [
        (0, d(2019), d(2019)), (1, d(2020), d(2021, 2, 28)), (2, d(2021, 2, 28), d(2022))
    ]


@pytest.mark.parametrize(
    "values", [[0, 25, 50, 75, 100], [1, 1, 2, 3, 9, 10], [5, 5, 5], [0.1, 0.2, 0.30000000000000004, 0.5]]
)
def test_equal_width_bins_match_pandas(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    low, high = (df.agg(f("x")).scalar() for f in (F.min, F.max))
    got = {r.x: r.b for r in df.select("x", ratings.equal_width_bin(F.col("x"), low, high).alias("b")).collect()}
    want = dict(zip(map(float, values), pd.cut(pd.Series(values), bins=4, labels=[1, 2, 3, 4]).astype(int), strict=True))
    assert got == want


def test_equal_width_ratings(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 10.0, 4), (5, 100.0, 8)], "transaction_count int, quantity_sum double, time_diff_days int")
    got = features.equal_width_ratings(df).orderBy("transaction_count").collect()
    assert [r.rating for r in got] == pytest.approx([1 / 3, 2 * 1 * 1 / 3, 64 / 3])


def test_quartile_places_and_composite_rating(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (5,)], "v int")
    got = [r[0] for r in df.orderBy("v").select(ratings.quartile_place(F.col("v"), (1, 2, 4))).collect()]
    assert got == [1, 2, 3, 4]
    row = df.limit(1).select(
        ratings.composite_rating(F.lit(3), F.lit(10.0)).alias("a"),
        ratings.composite_rating(F.lit(3), F.lit(10.0), F.lit(9.0)).alias("b"),
    ).first()
    assert (row.a, row.b) == (3.5, 9.0)


@pytest.mark.parametrize(
    "values,q", [([1, 2, 3, 4, 5, 6, 7, 8], 4), ([1, 1, 1, 1, 2], 4), ([1, 2], 4), ([3.5, 1.25, 9, 9, 9, 2, 7], 5), ([4], 4)]
)
def test_quantile_histogram_matches_pandas(spark, values, q):
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(3)
    got = [r.n for r in features.quantile_histogram(df, {"x": q}).orderBy("bin").collect()]
    edges = features.quantile_edges(features.value_counts(df, ["x"]), {"x": q}).first().edges
    want = np.unique(np.quantile(np.array(values, float), np.arange(q + 1) / q))
    assert np.allclose(edges, want)
    if len(want) > 1:
        cut = pd.qcut(pd.Series(values, dtype=float), q=q, duplicates="drop")
        assert got == list(cut.value_counts(sort=False))


def test_item_lists_come_in_bounded_blocks(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 5), (2, 5)], "u int, i int")
    got = {(r.u, r.block): r["items"] for r in features.item_lists(df, "u", "i", block=4).collect()}
    assert got == {(1, 0): [0, 1, 2, 3], (1, 1): [4, 5, 6, 7], (1, 2): [8, 9], (2, 0): [5]}


def test_heavy_users(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(2,)], "u int")
    assert [tuple(r) for r in features.heavy_users(df, "u", 2).collect()] == [(1, 3)]


def test_scores_and_formats(spark):
    one = spark.range(1)
    row = one.select(
        scores.biased_score([F.lit(1.0), F.lit(2.0)], [F.lit(3.0), F.lit(4.0)], F.lit(0.5), F.lit(0.25), F.lit(1.0)).alias("s"),
        scores.array_dot(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("d"),
        scores.triplet_loss(F.lit(1.0), F.lit(1.0)).alias("t"),
        scores.two_decimals(F.lit(0.125)).alias("a"), scores.two_decimals(F.lit(0.375)).alias("b"),
        scores.nine_decimals(F.lit(0.5)).alias("n"),
        scores.log_loss(F.lit(1.0), F.lit(0.0)).alias("l"),
    ).first()
    assert (row.s, row.d, row.t, row.a, row.b, row.n) == (12.75, 11.0, 0.5, 0.12, 0.38, "0.500000000")
    assert row.l == pytest.approx(-np.log(1e-7))
