import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from tillwise.operators import sampling, triplets
from tillwise.scratch import materialize


@pytest.fixture(scope="module")
def small(spark):
    rows = [(u, i) for u in range(20) for i in range(30) if (u * 7 + i * 3) % 5 == 0]
    return materialize(spark.createDataFrame(rows, "customer_id bigint, product_id bigint"))


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_shuffled_pairs_keep_both_marginals(small):
    made = sampling.shuffled_pairs(small, "customer_id", "product_id", "s").collect()
    base = small.collect()
    assert len(made) == len(base)
    for c in ("customer_id", "product_id"):
        assert collections.Counter(r[c] for r in made) == collections.Counter(r[c] for r in base)
    assert [r.position for r in sorted(made)] == list(range(len(base)))
    assert {(r.customer_id, r.product_id) for r in made} != as_set(small, "customer_id", "product_id")


def test_negatives_are_disjoint_distinct_and_exactly_as_many(small):
    n = small.count()
    made = sampling.negative_pairs(small, n)
    got = as_set(made, "customer_id", "product_id")
    assert made.count() == len(got) == n
    assert not got & as_set(small, "customer_id", "product_id")


def test_negatives_come_in_the_order_of_their_place(small):
    made = sampling.negative_pairs(small, 100).collect()
    order = sorted(made, key=lambda r: (r.generation, r.position))
    assert [r.place for r in order] == list(range(100))
    by_place = sampling.labelled_chunks(small, sampling.negative_pairs(small, 100), 3, ["customer_id", "product_id"])
    ranked = sampling.labelled_chunks(small, sampling.negative_pairs(small, 100).drop("place"), 3, ["customer_id", "product_id"])
    assert as_set(by_place, *by_place.columns) == as_set(ranked, *by_place.columns)


def test_few_negatives(small):
    made = sampling.negative_pairs(small, 3)
    assert made.count() == 3
    assert not as_set(made, "customer_id", "product_id") & as_set(small, "customer_id", "product_id")


def test_more_negatives_than_exist_is_an_error(small):
    with pytest.raises(ValueError, match="exist"):
        sampling.negative_pairs(small, 10_000)


def test_labelled_chunks(small):
    n = small.count()
    made = sampling.labelled_chunks(
        small, sampling.negative_pairs(small, n), 5, ["customer_id", "product_id"]
    )
    sizes = {(r.chunk, r.rating_type): r["count"] for r in made.groupBy("chunk", "rating_type").count().collect()}
    assert sum(v for (_, t), v in sizes.items() if t == 1) == n
    assert sum(v for (_, t), v in sizes.items() if t == 0) == n
    assert max(v for (_, t), v in sizes.items() if t == 1) - min(v for (_, t), v in sizes.items() if t == 1) <= 1


def test_ratio_negatives_keep_the_drawn_items(small):
    n = small.count()
    rows = sampling.ratio_negatives(small, 3).collect()
    zeros = [r for r in rows if r.label == 0]
    assert len(rows) == 4 * n and len(zeros) == 3 * n
    assert sorted(r.draw for r in zeros) == list(range(3 * n))
    clean = materialize(sampling.ratio_negatives(small, 3, exclude_positives=True).where("label = 0"))
    assert sorted(r.draw for r in clean.collect()) == list(range(3 * n))
    assert sampling.ratio_negatives(small, 1.5).where("label = 0").count() == int(1.5 * n)
    assert not as_set(clean, "customer_id", "product_id") & as_set(small, "customer_id", "product_id")


@pytest.mark.parametrize("block", [4, 65_536])
def test_unseen_ranges_expand_to_the_complement(spark, small, block):
    ranges = sampling.unseen_ranges(small, "customer_id", "product_id", 30, block=block)
    got = sampling.expand_ranges(ranges, "customer_id", "product_id", piece=3)
    seen = as_set(small, "customer_id", "product_id")
    want = {(u, i) for u in {u for u, _ in seen} for i in range(30)} - seen
    assert got.count() == len(want)
    assert as_set(got, "customer_id", "product_id") == want


def test_unseen_ranges_of_a_user_who_has_everything(spark):
    df = spark.range(5).select(F.lit(1).alias("u"), F.col("id").alias("i"))
    assert sampling.unseen_ranges(df, "u", "i", 5).count() == 0


def test_grow_reaches_the_size_and_keeps_existing_rows(spark, folder):
    from tillwise.operators.features import interaction_features
    from tillwise.sources.tables import interactions

    base = materialize(interaction_features(interactions(spark, folder)))
    n = base.count()
    made = sampling.grow(base, n + 500)
    assert made.count() == n + 500
    keys = made.groupBy("customer_id", "product_id").count()
    assert keys.agg(F.max("count")).first()[0] == 1
    labels = base.select("product_id", "material").distinct()
    assert made.join(labels, ["product_id", "material"], "left_anti").count() == 0
    codes = base.select("customer_id", "normalized_customer_id").distinct()
    assert made.join(codes, ["customer_id", "normalized_customer_id"], "left_anti").count() == 0


def test_grow_refuses_the_impossible(spark, folder):
    from tillwise.plans.queries import _written_pairs

    with pytest.raises(ValueError, match="exist"):
        sampling.grow(_written_pairs(spark, folder), 10**9)


def test_binary_matrix(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (2, 7)], "u int, i int")
    out = sampling.binary_matrix(df, "u", "i", "k_")
    assert out.columns == ["u", "k_5", "k_7"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 0), (2, 0, 1)]
    with pytest.raises(ValueError, match="more than 1"):
        sampling.binary_matrix(df, "u", "i", most=1)


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(u, i, float((u + i * i) % 7)) for u in range(6) for i in range(12) if (u + i) % 3]
    rows += [(50, i, 9.0) for i in range(4)] + [(51, i, 0.0) for i in range(4)]  # one-sided users
    return spark.createDataFrame(rows, "u bigint, i bigint, r double")


def test_all_rounds_are_all_rated_triplets_once(rated):
    made = triplets.RatedTriplets(rated, "u", "i", F.col("r") > 3)
    got = [
        (r.u, r.positive, r.negative) for batch in made.batches(3) for r in batch.collect()
    ]
    rows = rated.collect()
    want = {
        (a.u, a.i, b.i) for a in rows for b in rows if a.u == b.u and a.r > 3 and not b.r > 3
    }
    assert len(got) == len(set(got)) == len(want)
    assert set(got) == want
    counts = triplets.triplet_counts(rated, "u", "i", F.col("r") > 3)
    assert counts.agg(F.sum("triplets")).first()[0] == len(want)
    assert counts.where("u >= 50").count() == 0


def test_whole_triplets_are_the_numbered_sides(rated):
    got = triplets.RatedTriplets(rated, "u", "i", F.col("r") > 3).whole().collect()
    sides = {}
    for r in got:
        sides.setdefault(r.u, ([], []))[0 if r.liked else 1].append(r)
    rows = rated.collect()
    want = {(a.u, a.i, b.i) for a in rows for b in rows if a.u == b.u and a.r > 3 and not b.r > 3}
    assert {(u, a.i, b.i) for u, (x, y) in sides.items() for a in x for b in y} == want
    for x, y in sides.values():
        assert {r.positives for r in x + y} == {len(x)} and {r.negatives for r in x + y} == {len(y)}
        assert sorted(r.place for r in x) == list(range(len(x))) and sorted(r.place for r in y) == list(range(len(y)))


def test_wrapped_rounds_keep_every_user_with_both_sides(rated):
    made = triplets.RatedTriplets(rated, "u", "i", F.col("r") > 3)
    both = {r.u for r in triplets.triplet_counts(rated, "u", "i", F.col("r") > 3).collect()}
    for epoch in (1, 2, 5, 17, 60):
        rows = made.rounds(range(4 * (epoch - 1), 4 * epoch), wrap=True).collect()
        assert {r.u for r in rows} == both
        assert len({(r.u, r.positive, r.negative) for r in rows}) == len(rows)


def test_whole_catalogue_triplets(small):
    few = materialize(small.where("customer_id < 4"))
    got = triplets.catalogue_whole(few, "customer_id", "product_id", 30).collect()
    seen = as_set(few, "customer_id", "product_id")
    assert {(r.customer_id, r.first_code) for r in got if r.seen} == seen
    unseen = {(r.customer_id, c) for r in got if not r.seen for c in range(r.first_code, r.last_code + 1)}
    assert unseen == {(u, n) for u in {u for u, _ in seen} for n in range(30)} - seen
    assert all(r.n_seen + r.n_unseen == 30 for r in got)


def test_a_round_gives_each_positive_one_negative(rated):
    made = triplets.RatedTriplets(rated, "u", "i", F.col("r") > 3)
    one = made.rounds([0])
    assert one.count() == made.positives.count() == one.select("u", "positive").distinct().count()


def test_all_catalogue_rounds_are_all_unseen_combinations(small):
    few = small.where("customer_id < 4")
    made = triplets.catalogue_rounds(few, "customer_id", "product_id", 30, range(1, 30))
    got = [(r.customer_id, r.positive, r.negative) for r in made.collect()]
    seen = as_set(few, "customer_id", "product_id")
    want = {(u, p, n) for u, p in seen for n in range(30) if (u, n) not in seen}
    assert len(got) == len(want) and set(got) == want


def test_no_plan_holds_a_cross_join(rated, small):
    plans = [
        triplets.RatedTriplets(rated, "u", "i", F.col("r") > 3).rounds([0, 1]),
        triplets.catalogue_rounds(small, "customer_id", "product_id", 30, [1]),
        sampling.unseen_ranges(small, "customer_id", "product_id", 30),
        sampling.shuffled_pairs(small, "customer_id", "product_id", "s"),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_unseen_draws_of_a_user_with_nearly_everything(spark):
    """One item is left to user 0, and it is rare: one pass finds it for every draw."""
    rows = [(0, i) for i in range(59)] + [(u, i) for u in range(1, 30) for i in range(0, 50, 2)] + [(30, 59)]
    pairs = materialize(spark.createDataFrame(rows, "customer_id bigint, product_id bigint"))
    got = sampling.ratio_negatives(pairs, 3, exclude_positives=True).where("label = 0").collect()
    assert sorted(r.draw for r in got) == list(range(3 * len(rows)))
    assert not {(r.customer_id, r.product_id) for r in got} & set(rows)
    mine = [r.product_id for r in got if r.customer_id == 0]
    assert len(mine) > 50 and set(mine) == {59}
    whole = spark.createDataFrame(rows + [(0, 59)], "customer_id bigint, product_id bigint")
    with pytest.raises(ValueError, match="every item"):
        sampling.ratio_negatives(materialize(whole), 3, exclude_positives=True)


def test_unseen_draws_follow_the_frequency_of_the_items(spark):
    rows = [(u, 0) for u in range(400)] + [(u, 1) for u in range(100)] + [(1000, 2)]
    pairs = materialize(spark.createDataFrame(rows, "customer_id bigint, product_id bigint"))
    got = sampling._from_unseen(
        spark.range(20_000).select(F.col("id").alias("draw"), F.lit(1000).cast("bigint").alias("customer_id")),
        pairs, "customer_id", "product_id", "s",
    )
    counts = {r.product_id: r["count"] for r in got.groupBy("product_id").count().collect()}
    assert set(counts) == {0, 1} and abs(counts[0] / 20_000 - 0.8) < 0.02


def test_sparse_rows_hold_any_catalogue_in_bounded_lists(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("u"), (F.col("id") * 3).alias("i"))
    df = df.unionAll(df.limit(10)).unionAll(spark.createDataFrame([(None, 1), (1, None)], "u bigint, i bigint"))
    rows = sampling.sparse_rows(df, "u", "i", block=100).collect()
    assert max(len(r.codes) for r in rows) <= 100
    assert all(r.codes == sorted(set(r.codes)) and {c // 100 for c in r.codes} == {r.block} for r in rows)
    assert {(r.u, c) for r in rows for c in r.codes} == {(n % 2, 3 * n) for n in range(5000)}


def test_large_input_is_shuffled_in_more_parts(spark, monkeypatch):
    """A task's share of a shuffle is bounded by the input, and the session keeps its own number."""
    from tillwise import scratch

    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    rows = materialize(spark.range(20_000).select("id", F.md5(F.col("id").cast("string")).alias("text")))
    monkeypatch.setattr(scratch, "BYTES_A_PARTITION", 20_000)
    needed = -(-scratch.input_bytes(rows) // 20_000)
    assert needed > int(before) and scratch.partitions_for(rows) == needed
    adaptive = "spark.sql.adaptive.enabled"
    spark.conf.set(adaptive, "false")
    try:
        written = materialize(rows.groupBy("id").agg(F.max("text").alias("text")))
    finally:
        spark.conf.set(adaptive, "true")
    assert len(written.inputFiles()) == needed and written.count() == 20_000
    assert spark.conf.get(key) == before
    with pytest.raises(Exception, match="asked for"):
        materialize(rows.groupBy("id").agg(F.max(F.raise_error(F.lit("asked for"))).alias("x")))
    assert spark.conf.get(key) == before


def test_unseen_draws_are_worked_out_for_their_users_alone(spark, monkeypatch):
    """Ranges of the users of the draws only, and a result that is read from written tables without a shuffle."""
    rows = [(u, i) for u in range(30) for i in range(40) if (u * 7 + i) % 3 == 0] + [(99, 1), (None, 2), (98, None)] * 2
    pairs = materialize(spark.createDataFrame(rows, "customer_id bigint, product_id bigint"))
    asked, ranges = [], sampling.unseen_ranges
    monkeypatch.setattr(sampling, "unseen_ranges", lambda df, *a: asked.append(as_set(df, "customer_id")) or ranges(df, *a))
    draws = spark.range(500).select(F.col("id").alias("draw"), (F.col("id") % 2 * 5).alias("customer_id"))
    got = sampling._from_unseen(draws, pairs, "customer_id", "product_id", "s").collect()
    assert asked == [{(0,), (5,)}]
    weights = {}
    for _, i in rows:
        weights[i] = weights.get(i, 0) + 1
    for r in got:
        mine = [i for i in sorted(weights, key=lambda i: (i is not None, i)) if (r.customer_id, i) not in rows]
        place = int(hashlib.md5(f"s-unseen:{r.draw}".encode()).hexdigest()[:15], 16) % sum(weights[i] for i in mine)
        for i in mine:
            if place < weights[i]:
                break
            place -= weights[i]
        assert r.product_id == i
    assert len(got) == 500
    whole = sampling.ratio_negatives(pairs, 3, exclude_positives=True)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert not {tuple(r) for r in whole.where("label = 0").select("customer_id", "product_id").collect() if None not in r} & set(rows)
