import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillwise.functions.hashing import digest
from tillwise.operators import encode, ranking, skew, splits


def test_global_rank_is_the_sorted_position_with_one_hot_leading_key(spark):
    keys = [(0 if i % 3 else i, i) for i in range(1000)]
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame(keys, "a int, b int").repartition(7)
    got = {(r.a, r.b): r["rank"] for r in ranking.global_rank(df, "a", "b").collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys))}


def test_global_rank_spreads_a_hot_leading_key(spark):
    """Equal leading keys are cut between partitions because the whole key orders them."""
    df = spark.range(20000).select(F.lit(1).alias("hot"), "id")
    parts = df.repartitionByRange(8, "hot", "id").select(F.spark_partition_id().alias("p"))
    sizes = [r["count"] for r in parts.groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 6000


def test_running_weight(spark):
    df = spark.createDataFrame([(3, 5), (1, 2), (2, 4)], "v int, n int")
    got = {r.v: r.before for r in ranking.global_rank(df, "v", name="before", weight="n").collect()}
    assert got == {1: 0, 2: 2, 3: 6}


def test_global_rank_of_nothing(spark):
    assert ranking.global_rank(spark.range(0), "id").count() == 0


def test_hash_rank_is_the_digest_order(spark):
    import hashlib

    df = spark.range(500)
    got = {r.id: r["rank"] for r in ranking.hash_rank(df, digest("s", "id"), "id").collect()}
    order = sorted(range(500), key=lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest())
    assert got == {v: n for n, v in enumerate(order)}


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_hash_rank_over_ranges_has_no_window_over_the_rows(spark, parts):
    """However many ranges, the order is that of the digest, and rows are sorted by a number."""
    import hashlib

    df = spark.range(3000)
    ranked = ranking.hash_rank(df, digest("s", "id"), "id", parts=parts)
    got = {r.id: r["rank"] for r in ranked.collect()}
    order = sorted(range(3000), key=lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest())
    assert got == {v: n for n, v in enumerate(order)}
    assert "row_number" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_hash_rank_of_equal_digests_goes_by_the_ties(spark):
    df = spark.range(50)
    got = {r.id: r["rank"] for r in ranking.hash_rank(df, F.md5(F.lit("same")), "id", parts=4).collect()}
    assert got == {n: n for n in range(50)}


@pytest.mark.parametrize("block", [1, 7, 65_536])
def test_block_rank_cuts_a_hot_group(spark, block):
    rows = [(0, 3 * i) for i in range(200)] + [(u, i) for u in range(1, 6) for i in range(u)]
    df = spark.createDataFrame(rows, "u int, i int")
    got = {(r.u, r.i): r["rank"] for r in ranking.block_rank(df, "u", "i", block=block).collect()}
    want = {}
    for u in range(6):
        for n, i in enumerate(sorted(i for v, i in rows if v == u)):
            want[(u, i)] = n
    assert got == want


def test_top_k_ties_short_groups_and_order(spark):
    df = spark.createDataFrame(
        [(1, 10, 0.5), (1, 11, 0.9), (1, 12, 0.5), (1, 13, 0.1), (2, 10, 0.2)], "u int, i int, s double"
    )
    got = sorted((r.u, r.position, r.i) for r in ranking.top_k(df, "u", "s", 3, "i").collect())
    assert got == [(1, 1, 11), (1, 2, 10), (1, 3, 12), (2, 1, 10)]


def test_top_k_is_pruned_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("u"), F.col("id").alias("i"), F.rand(1).alias("s"))
    plan = ranking.top_k(df, "u", "s", 2, "i")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_first_rows_both_ways(spark, monkeypatch):
    df = spark.range(50).repartition(5)
    assert [r.id for r in ranking.first_rows(df, 3, "id").orderBy("id").collect()] == [0, 1, 2]
    big = ranking.first_rows(df.select(F.col("id")), 100_001, "id")
    assert big.count() == 50


def test_codes_follow_first_appearance(spark):
    df = spark.createDataFrame(
        [("b", "z"), ("a", "y"), ("a", "x"), ("c", "x"), ("b", "a")], "customer string, material string"
    )
    frame = pd.DataFrame(df.collect(), columns=df.columns).sort_values(["customer", "material"])
    want = dict(zip(frame.material, pd.factorize(frame.material)[0], strict=True))
    got = {r.material: r.code for r in encode.codes_by_appearance(df, "material", "customer", "code").collect()}
    assert got == want == {"x": 0, "y": 1, "a": 2, "z": 3}
    users = {r.customer: r.code for r in encode.codes_by_value(df, "customer", "code").collect()}
    assert users == {"a": 0, "b": 1, "c": 2}


def test_lookup_with_and_without_unknown(spark):
    df = spark.createDataFrame([("a", 1), ("q", 2), (None, 3)], "k string, n int")
    codes = spark.createDataFrame([("a", 0)], "k string, code bigint")
    got = {r.n: r.code for r in encode.lookup(df, codes, "k", "code", spread="n").collect()}
    assert got == {1: 0, 2: None, 3: None}
    got = {r.n: r.code for r in encode.lookup(df, codes, "k", "code", spread="n", unknown=9).collect()}
    assert got == {1: 0, 2: 9, 3: 9}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_plain_join_and_splits_the_hot_key(spark, how, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 1000)
    left = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 500 != 1, F.col("id") % 500 + 100).alias("k"), "id",
    )
    right = spark.range(700).where("id != 150").select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = skew.hot_keys(left, "k")
    assert [tuple(r) for r in hot.collect()] == [(7, 10)]
    got = skew.spread_join(left, right, "k", ["id"], hot, how)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_small_tables_have_no_hot_keys(spark):
    assert skew.hot_keys(spark.range(10), "id") is None


@pytest.mark.parametrize("n,k", [(13, 5), (10, 5), (3, 5), (0, 5), (101, 7)])
def test_chunks_are_cut_like_array_split(spark, n, k):
    got = splits.time_chunks(spark.range(n), k, "id")
    sizes = {r.chunk: r["count"] for r in got.groupBy("chunk").count().collect()}
    want = {c: len(a) for c, a in enumerate(np.array_split(np.arange(n), k)) if len(a)}
    assert sizes == want
    if n:
        firsts = {r.chunk: r.m for r in got.groupBy("chunk").agg(F.min("id").alias("m")).collect()}
        assert firsts == {c: a[0] for c, a in enumerate(np.array_split(np.arange(n), k)) if len(a)}


def test_random_split_has_the_exact_size_and_is_repeatable(spark):
    df = spark.range(103)
    one = splits.random_split(df, 0.8, ["id"])
    two = splits.random_split(df.repartition(9), 0.8, ["id"])
    marks = {r.id: r.is_train for r in one.collect()}
    assert sum(marks.values()) == int(103 * 0.8)
    assert marks == {r.id: r.is_train for r in two.collect()}


def test_shuffled_chunks_partition_the_rows(spark):
    got = splits.shuffled_chunks(spark.range(52), 5, ["id"], "s")
    sizes = sorted(r["count"] for r in got.groupBy("chunk").count().collect())
    assert sizes == [10, 10, 10, 11, 11]


def test_hold_out_rotates_and_can_hold_nothing(spark):
    df = spark.range(10).select("id", (F.col("id") % 5).alias("chunk"))
    seen = []
    for fold in range(5):
        train, test = splits.hold_out(df, fold)
        assert train.count() == 8
        seen += [r.id for r in test.collect()]
    assert sorted(seen) == list(range(10))
    train, test = splits.hold_out(df, None)
    assert (train.count(), test.count()) == (10, 0)


def test_rotation_summary(spark):
    df = spark.createDataFrame([(0, 1.0, 1), (0, 3.0, 0), (1, 5.0, 1)], "f int, v double, ok int")
    got = {r.fold: r for r in splits.rotation_summary(df, "f", "v", F.col("ok") == 1).collect()}
    assert (got[0].train_rows, got[0].test_rows, got[0].train_mean, got[0].test_mean) == (1, 1, 5.0, 1.0)
    assert (got[1].train_rows, got[1].test_rows, got[1].train_mean, got[1].test_mean) == (2, 1, 2.0, 5.0)


def test_heavy_user_holdout(spark):
    rows = [(1, i, 5.0, i) for i in range(4)] + [(2, i, 5.0, 10 + i) for i in range(2)] + [(1, 9, 1.0, 20)]
    df = spark.createDataFrame(rows, "u int, m int, r double, n int")
    train, test = splits.heavy_user_holdout(df, "u", F.col("r") > 4, ["n"], more_than=3)
    assert sorted((r.u, r.m) for r in test.collect()) == [(1, 0), (1, 1)]
    assert sorted((r.u, r.m) for r in train.collect()) == [(1, 2), (1, 3), (1, 9), (2, 0), (2, 1)]
