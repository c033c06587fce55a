"""One query per operator, over whole test tables.

Every function takes (spark, folder) and returns a DataFrame whose columns
carry the same names as the SQL in :mod:`tillwise.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.ratings import COUNT_CUTS, QUANTITY_CUTS, composite_rating, quartile_place
from tillwise.functions.scores import (
    array_dot,
    network_probability,
    nine_decimals,
    sigmoid,
    two_decimals,
)
from tillwise.operators import curate as cu
from tillwise.operators import encode, evaluation, features, ranking, sampling, splits, triplets
from tillwise.plans import crossval, learners, scoring
from tillwise.plans import factorization as mf
from tillwise.scratch import materialize, new_path
from tillwise.sources import readers, sinks, tables
from tillwise.streaming import running

USER, ITEM = "customer_id", "product_id"
TIME_ORDER = ["first_purchase", "last_purchase", USER, ITEM]
LIKED_ABOVE = 25.0
RANK = 8

Query = Callable[[SparkSession, str], DataFrame]


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Features per (customer_id, product_id), the part key standing for the product."""
    bought = tables.interactions(spark, folder).withColumnRenamed("material", ITEM)
    return features.purchase_summary(bought, USER, ITEM)


def _written_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return materialize(_pairs(spark, folder), "pairs")


def _chunked_pairs(spark: SparkSession, folder: str, n: int = 5) -> DataFrame:
    return splits.time_chunks(_pairs(spark, folder), n, *TIME_ORDER)


def _liked() -> Column:
    return F.col("quantity_sum") > LIKED_ABOVE


def _fixed_factors(pairs: DataFrame, rank: int = RANK, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Seeded factors for every user and item of the pairs, as scoring reads them."""
    model = materialize(
        mf.start_model(pairs.select(USER).distinct(), pairs.select(ITEM).distinct(), rank, scale=scale),
        "factors",
    )
    return mf.as_arrays(model, "u", USER), mf.as_arrays(model, "i", ITEM)


def _text(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({d: F.col(d).cast("string") for d in dates})


# -- files -------------------------------------------------------------------

def transactions_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The raw transactions written as CSV with decimal commas and quoted texts, and read back."""
    raw = tables.raw_transactions(spark, folder)
    path = new_path(spark, "csv")
    quoted = F.concat(F.lit('"'), "material_text", F.lit('", '), F.col("matl_group"))
    sinks.write_csv(
        raw.withColumns(
            {"quantity": F.translate(F.col("quantity").cast("string"), ".", ","), "material_text": quoted}
        ),
        path,
    )
    back = readers.read_transactions(spark, path)
    return back.select(*[F.col(c).alias(c.lower()) for c in back.columns])


def chunk_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs written as one folder of files a chunk, and read back."""
    path = new_path(spark, "chunks")
    sinks.write_chunks(splits.time_chunks(_written_pairs(spark, folder), 5, *TIME_ORDER), path)
    back = spark.read.parquet(path)
    return back.select(USER, ITEM, "quantity_sum", F.col("chunk").cast("bigint").alias("chunk"))


def renamed_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs written as CSV under other names, and read back by position."""
    path = new_path(spark, "csv")
    pairs = _pairs(spark, folder).select(F.col(USER).alias("a"), F.col(ITEM).alias("b"), F.col("quantity_sum").alias("c"))
    sinks.write_csv(pairs, path)
    return readers.read_renamed(spark, path, _schema(f"{USER} bigint, {ITEM} bigint, quantity_sum double"))


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _ratings_file(spark: SparkSession, folder: str) -> str:
    """Counts of the pairs as a headerless, tab-separated Latin-1 file with text ids."""
    path = new_path(spark, "ratings")
    rows = _pairs(spark, folder).select(
        F.concat(F.lit("ü"), USER), F.concat(F.lit("é"), ITEM), "transaction_count", F.unix_date("first_purchase")
    )
    rows.write.option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)
    return path


def ratings_tsv(spark: SparkSession, folder: str) -> DataFrame:
    return readers.read_ratings_tsv(spark, _ratings_file(spark, folder))


def binary_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Every rating becomes one."""
    return readers.read_ratings_tsv(spark, _ratings_file(spark, folder), rating=1.0)


def labelled_pair_files(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled pairs in the five-column layout; ids stay text, the label becomes an integer."""
    path = new_path(spark, "csv")
    sinks.write_csv(
        _pairs(spark, folder).select(
            F.format_string("%08d", USER).alias("customer"), F.col(USER).alias("number"),
            F.concat(F.lit("m, "), ITEM).alias("part"), F.col(ITEM).alias("product"), _liked().cast("double").alias("label"),
        ),
        path,
    )
    back = readers.read_pairs(spark, path, labelled=True)
    return back.withColumn("rating_type", F.col("rating_type").cast("bigint"))


def chunk_csv(spark: SparkSession, folder: str) -> DataFrame:
    """One CSV file set a chunk, all read in one scan with the chunk number of the name."""
    root = new_path(spark, "chunks")
    chunked = materialize(_chunked_pairs(spark, folder), "chunked")
    paths = [f"{root}/set_{n}.csv" for n in range(5)]
    for n, path in enumerate(paths):
        sinks.write_csv(chunked.where(F.col("chunk") == n).select(USER, ITEM, "quantity_sum"), path)
    back = readers.read_chunks(spark, paths, _schema(f"{USER} bigint, {ITEM} bigint, quantity_sum double"))
    return back.withColumn("chunk", F.col("chunk").cast("bigint"))


def appended_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Liked and other pairs appended to one table one after the other."""
    path = new_path(spark, "appended")
    pairs = _written_pairs(spark, folder)
    for some in (_liked(), ~_liked()):
        sinks.append_rows(pairs.where(some).select(USER, ITEM, "quantity_sum"), path)
    return spark.read.parquet(path)


def stored_model(spark: SparkSession, folder: str) -> DataFrame:
    """The newest of two saved versions of a model, scaled by its stored setting."""
    path = new_path(spark, "model")
    pairs = _written_pairs(spark, folder)
    users, items = pairs.select(USER).distinct(), pairs.select(ITEM).distinct()
    sinks.save_model(mf.start_model(users, items, SMALL.rank, "older"), path, rank=SMALL.rank, scale=9.0)
    sinks.save_model(mf.start_model(users, items, SMALL.rank), path, rank=SMALL.rank, scale=2.0)
    model, settings = sinks.load_model(spark, path)
    grown = F.transform("factors", lambda x: x * F.lit(settings["scale"]))
    return _rounded_model(model.withColumn("factors", grown), settings["rank"])


def run_records(spark: SparkSession, folder: str) -> DataFrame:
    """A record for each rating threshold, appended one by one and read back."""
    path = new_path(spark, "runs")
    pairs = _written_pairs(spark, folder)
    for least in (0, 25):
        row = pairs.where(F.col("quantity_sum") > least).agg(F.count(F.lit(1)).alias("n"), F.avg("quantity_sum").alias("mean")).first()
        sinks.append_run(spark, path, {"least": least}, {"n": row["n"], "mean": row["mean"]})
    runs = spark.read.schema("config string, metrics map<string,double>").json(path)
    return runs.select("config", F.col("metrics")["n"].cast("bigint").alias("n"), F.round(F.col("metrics")["mean"], 6).alias("mean"))


# -- curation and features -------------------------------------------------

def curate_ds1(spark: SparkSession, folder: str) -> DataFrame:
    return _text(cu.curate(tables.raw_transactions(spark, folder)), "calday")


def curate_ds2(spark: SparkSession, folder: str) -> DataFrame:
    return _text(cu.curate_without_zeros(tables.raw_transactions(spark, folder)), "calday")


def mcq(spark: SparkSession, folder: str) -> DataFrame:
    clean = cu.curate_without_zeros(tables.raw_transactions(spark, folder))
    return features.customer_material_quantity(clean)


def _clean_features(spark: SparkSession, folder: str) -> DataFrame:
    clean = cu.curate_without_zeros(tables.raw_transactions(spark, folder))
    return features.interaction_features(clean)


def interaction_features(spark: SparkSession, folder: str) -> DataFrame:
    out = _text(_clean_features(spark, folder), "first_purchase", "last_purchase")
    return out.withColumn("time_diff_days", F.col("time_diff_days").cast("bigint"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Raw transactions to coded, time-ordered feature chunks."""
    chunked = splits.time_chunks(_clean_features(spark, folder), 5, *TIME_ORDER)
    out = _text(chunked, "first_purchase", "last_purchase")
    return out.withColumns(
        {c: F.col(c).cast("bigint") for c in ("time_diff_days", "chunk")}
    )


def global_mean(spark: SparkSession, folder: str) -> DataFrame:
    rating = composite_rating(F.col("transaction_count"), F.col("quantity_sum"))
    return _pairs(spark, folder).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(rating), 6).alias("mean_rating")
    )


def dataset_profile(spark: SparkSession, folder: str) -> DataFrame:
    out = features.profile(_written_pairs(spark, folder), *TIME_ORDER)
    out = _text(out, "first_day", "second_day", "last_day")
    return out.withColumn("period_days", F.col("period_days").cast("bigint"))


def first_non_null(spark: SparkSession, folder: str) -> DataFrame:
    """Blanked quantities and flags: the first present value of each, in row order."""
    raw = tables.raw_transactions(spark, folder).withColumn(
        "flag", F.when(F.col("is_accessory"), F.col("matl_group"))
    )
    order = F.struct("calday", "doc_number_text", "is_accessory", F.coalesce("quantity", F.lit(-1000.0)))
    return features.first_present(raw, ["customer_id", "material"], order, ["quantity", "flag"])


def quantile_histogram(spark: SparkSession, folder: str) -> DataFrame:
    out = features.quantile_histogram(
        _pairs(spark, folder), {"transaction_count": 4, "quantity_sum": 4, "time_diff_days": 5}
    )
    return out.select(
        "name", F.col("bin").cast("bigint").alias("bin"), F.round("low", 6).alias("low"),
        F.round("high", 6).alias("high"), "n",
    )


def equal_width_rating(spark: SparkSession, folder: str) -> DataFrame:
    out = features.equal_width_ratings(_written_pairs(spark, folder))
    return out.select(
        USER, ITEM,
        *[F.col(f"normalized_{c}").cast("bigint").alias(f"normalized_{c}")
          for c in ("transaction_count", "quantity_sum", "time_diff_days")],
        F.round("rating", 6).alias("rating"),
    )


def quartile_rating(spark: SparkSession, folder: str) -> DataFrame:
    count, quantity = F.col("transaction_count"), F.col("quantity_sum")
    return _pairs(spark, folder).select(
        USER, ITEM,
        quartile_place(count, COUNT_CUTS).cast("bigint").alias("count_place"),
        quartile_place(quantity, QUANTITY_CUTS).cast("bigint").alias("quantity_place"),
        composite_rating(count, quantity).alias("rating"),
    )


def shift_years(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    out = features.shift_years(pairs, ["first_purchase", "last_purchase"], *TIME_ORDER)
    return _text(out.select(USER, ITEM, "first_purchase", "last_purchase"), "first_purchase", "last_purchase")


# -- splits ----------------------------------------------------------------

def time_chunks(spark: SparkSession, folder: str) -> DataFrame:
    out = _chunked_pairs(spark, folder).select(USER, ITEM, "first_purchase", "chunk")
    return _text(out, "first_purchase").withColumn("chunk", F.col("chunk").cast("bigint"))


def random_split(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder).select(USER, ITEM)
    out = splits.random_split(pairs, 0.8, [USER, ITEM])
    return out.withColumn("is_train", F.col("is_train").cast("bigint"))


def holdout_heavy_users(spark: SparkSession, folder: str) -> DataFrame:
    rated = (
        tables.table(spark, folder, "lineitem")
        .join(tables.table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("o_custkey").alias("user"), F.col("l_partkey").alias("movie"),
            F.col("l_quantity").alias("rating"), "l_orderkey", "l_linenumber", "l_extendedprice",
        )
    )
    order = ["l_orderkey", "l_linenumber", "movie", "rating", "l_extendedprice"]
    train, test = splits.heavy_user_holdout(rated, "user", F.col("rating") > LIKED_ABOVE, order)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    liked = _written_pairs(spark, folder).where(_liked())
    out = features.item_lists(liked, USER, ITEM, block=16)
    return out.select(
        USER, "block", F.size("items").cast("bigint").alias("n"),
        F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"),
    )


def cv_folds(spark: SparkSession, folder: str) -> DataFrame:
    out = splits.rotation_summary(_chunked_pairs(spark, folder), "chunk", "quantity_sum")
    return out.withColumns({c: F.round(c, 6) for c in ("train_mean", "test_mean")})


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    negatives = sampling.negative_pairs(pairs, 2 * pairs.count(), USER, ITEM)
    return sampling.labelled_chunks(pairs, negatives, 5, TIME_ORDER, USER, ITEM)


def cv_posneg_folds(spark: SparkSession, folder: str) -> DataFrame:
    labelled = _labelled(spark, folder)
    out = splits.rotation_summary(
        labelled, "chunk", "rating_type", test_when=F.col("rating_type") == 1
    )
    return out.withColumns({c: F.round(c, 6) for c in ("train_mean", "test_mean")})


# -- catalogues, codes, pair sets -----------------------------------------

def catalogues(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    users = cu.vocabulary([pairs], USER).select(F.lit("user").alias("kind"), F.col(USER).alias("id"))
    items = cu.sorted_distinct(pairs, ITEM).select(F.lit("item").alias("kind"), F.col(ITEM).alias("id"))
    return users.unionByName(items)


def cardinalities(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of the first half of the purchases, taken in time order."""
    pairs = _written_pairs(spark, folder)
    half = ranking.first_rows(pairs, pairs.count() // 2, *TIME_ORDER)
    return half.agg(
        (F.max(USER) + 1).alias("user_rows"), (F.max(ITEM) + 1).alias("item_rows"),
        F.count_distinct(F.col(USER)).alias("users"), F.count_distinct(F.col(ITEM)).alias("items"),
        F.count(F.lit(1)).alias("pairs"),
    )


def oov_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Users of later chunks looked up in the vocabulary of the first."""
    chunked = materialize(_chunked_pairs(spark, folder, 50), "chunked")
    codes = encode.codes_by_value(chunked.where(F.col("chunk") == 0), USER, "code")
    later = chunked.where(F.col("chunk") > 0).select(USER, ITEM)
    return encode.lookup(later, codes, USER, "code", spread=ITEM, unknown=-1)


def positive_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return cu.positive_pairs(tables.interactions(spark, folder), "customer_id", "material")


def complement(spark: SparkSession, folder: str) -> DataFrame:
    """The whole complement of users times items, as ranges of item codes."""
    pairs = _written_pairs(spark, folder).select(USER, ITEM)
    codes = encode.codes_by_value(pairs, ITEM, "code")
    coded = encode.lookup(pairs, codes, ITEM, "code", spread=USER)
    return sampling.unseen_ranges(coded, USER, "code", codes.count())


# -- sampling --------------------------------------------------------------

def rated_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """All triplets of rated items, as numbered sides."""
    return triplets.RatedTriplets(_pairs(spark, folder), USER, ITEM, _liked()).whole()


def triplet_counts(spark: SparkSession, folder: str) -> DataFrame:
    return triplets.triplet_counts(_pairs(spark, folder), USER, ITEM, _liked())


def catalogue_triplets(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder).select(USER, ITEM)
    codes = encode.codes_by_value(pairs, ITEM, "code")
    coded = materialize(
        encode.lookup(pairs, codes, ITEM, "code", spread=USER).select(USER, "code"), "coded"
    )
    return triplets.catalogue_whole(coded, USER, "code", codes.count())


def synthetic_pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    out = sampling.synthetic_rows(pairs, USER, ITEM, TIME_ORDER, "synthetic")
    out = out.select("position", USER, ITEM, "first_purchase", "quantity_sum")
    return _text(out, "first_purchase")


def _grown(spark: SparkSession, folder: str) -> DataFrame:
    coded = materialize(
        features.interaction_features(tables.interactions(spark, folder)), "features"
    )
    return sampling.grow(coded, 2 * coded.count(), USER, ITEM)


def grown_dataset(spark: SparkSession, folder: str) -> DataFrame:
    out = _text(_grown(spark, folder), "first_purchase", "last_purchase")
    return out.withColumn("time_diff_days", F.col("time_diff_days").cast("bigint"))


def tt_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs only, in time-ordered chunks."""
    coded = features.interaction_features(tables.interactions(spark, folder))
    chunked = splits.time_chunks(coded, 5, *TIME_ORDER)
    return chunked.select(
        USER, "normalized_customer_id", "material", ITEM, F.col("chunk").cast("bigint").alias("chunk")
    )


def negative_feedback(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    made = sampling.negative_pairs(pairs, 2 * pairs.count(), USER, ITEM)
    return made.select(USER, ITEM, F.col("generation").cast("bigint").alias("generation"), "position")


def ncf_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(spark, folder).withColumns(
        {c: F.col(c).cast("bigint") for c in ("rating_type", "chunk")}
    )


def ratio_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.ratio_negatives(_written_pairs(spark, folder), 3, USER, ITEM)


def ratio_negatives_unseen(spark: SparkSession, folder: str) -> DataFrame:
    """As ratio_negatives, but no draw is a pair."""
    return sampling.ratio_negatives(_written_pairs(spark, folder), 3, USER, ITEM, exclude_positives=True)


def binary_matrix(spark: SparkSession, folder: str) -> DataFrame:
    out = sampling.binary_matrix(tables.events(spark, folder), "user_id", "item", "k_")
    return out.select("user_id", *[F.col(c).cast("bigint").alias(c) for c in out.columns[1:]])


def sparse_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The whole 0/1 matrix of customers and products, in rows of at most 512 columns."""
    out = sampling.sparse_rows(_written_pairs(spark, folder), USER, ITEM, block=512)
    return out.select(USER, "block", F.size("codes").cast("bigint").alias("ones"), F.concat_ws(",", F.col("codes").cast("array<string>")).alias("codes"))


# -- models ----------------------------------------------------------------

SMALL = mf.Settings(rank=4, rate=0.05, penalty=0.02, bias_penalty=0.02)
#: Factors and epochs of the cross-validated model, the numbers of the original.
SVD, SVD_EPOCHS = mf.Settings(rank=50, rate=0.05, penalty=0.02, bias_penalty=0.02), 1


def _rounded_model(model: DataFrame, rank: int) -> DataFrame:
    columns = mf.wide(model, rank)
    return columns.select("side", "id", *[F.round(c, 6).alias(c) for c in columns.columns[2:]])


def _ratings(spark: SparkSession, folder: str) -> DataFrame:
    rated = features.equal_width_ratings(_written_pairs(spark, folder))
    split = splits.random_split(rated.select(USER, ITEM, "rating"), 0.8, [USER, ITEM])
    return materialize(split, "ratings")


def mf_step(spark: SparkSession, folder: str) -> DataFrame:
    fit = mf.Factorization(
        _ratings(spark, folder), USER, ITEM, "rating", SMALL, held_out=~F.col("is_train")
    )
    return _rounded_model(materialize(fit.step(fit.start()), "model"), SMALL.rank)


def mf_epochs(spark: SparkSession, folder: str) -> DataFrame:
    fit = mf.Factorization(
        _ratings(spark, folder), USER, ITEM, "rating", SMALL, held_out=~F.col("is_train")
    )
    rows = [(e, train, test) for e, _, train, test in fit.epochs(fit.start(), 2)]
    out = spark.createDataFrame(rows, "epoch bigint, mse double, test_mse double")
    return out.select("epoch", *[F.round(c, 6).alias(c) for c in ("mse", "test_mse")])


def logistic_step(spark: SparkSession, folder: str) -> DataFrame:
    labelled = materialize(
        sampling.ratio_negatives(_written_pairs(spark, folder), 3, USER, ITEM), "labelled"
    )
    settings = mf.Settings(rank=4, rate=0.5, link="logit", learn_bias=False)
    fit = mf.Factorization(labelled, USER, ITEM, "label", settings, offset=0.0)
    return _rounded_model(materialize(fit.step(fit.start()), "model"), settings.rank)


def _bpr(spark: SparkSession, folder: str) -> tuple[mf.PairwiseRanking, DataFrame]:
    pairs = _written_pairs(spark, folder)
    made = triplets.RatedTriplets(pairs, USER, ITEM, _liked())
    ranker = mf.PairwiseRanking(
        lambda epoch: made.rounds(range(4 * (epoch - 1), 4 * epoch), wrap=True), USER, mf.Settings(rank=4, rate=0.5)
    )
    start = materialize(
        mf.start_model(pairs.select(USER).distinct(), pairs.select(ITEM).distinct(), 4), "model"
    )
    return ranker, start


def bpr_step(spark: SparkSession, folder: str) -> DataFrame:
    ranker, start = _bpr(spark, folder)
    return _rounded_model(materialize(ranker.step(start), "model"), 4)


def bpr_loss(spark: SparkSession, folder: str) -> DataFrame:
    ranker, start = _bpr(spark, folder)
    losses = ranker.scored(start, materialize(ranker.rounds(1), "triplets")).agg(
        F.round(F.avg("loss"), 6).alias("loss"), F.count(F.lit(1)).alias("triplets")
    )
    return materialize(losses, "losses")


def _whole_bpr(spark: SparkSession, folder: str) -> tuple[mf.WholeRanking, DataFrame]:
    pairs = _written_pairs(spark, folder)
    ranker = mf.WholeRanking(pairs, USER, ITEM, _liked(), mf.Settings(rank=4, rate=0.5))
    return ranker, materialize(mf.start_model(pairs.select(USER).distinct(), pairs.select(ITEM).distinct(), 4), "model")


def bpr_epoch(spark: SparkSession, folder: str) -> DataFrame:
    """One step over every triplet of liked and other products."""
    ranker, start = _whole_bpr(spark, folder)
    return _rounded_model(materialize(ranker.step(start), "model"), 4)


def bpr_epoch_loss(spark: SparkSession, folder: str) -> DataFrame:
    ranker, start = _whole_bpr(spark, folder)
    losses = ranker.sums(start).where("liked").agg(
        F.round(F.sum("loss") / F.sum("n"), 6).alias("loss"), F.sum("n").alias("triplets")
    )
    return materialize(losses, "losses")


def svd_cross_validation(spark: SparkSession, folder: str) -> DataFrame:
    rated = features.equal_width_ratings(_written_pairs(spark, folder))
    rows = materialize(
        splits.shuffled_chunks(rated.select(USER, ITEM, "rating"), 5, [USER, ITEM], "folds"), "folds"
    )
    out = crossval.cross_validate(rows, USER, ITEM, "rating", "chunk", SVD, epochs=SVD_EPOCHS)
    return out.select(*[
        F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes
    ])


def als_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of least-squares factors on the held-out fifth of the ratings."""
    rated = _ratings(spark, folder)
    train = rated.where("is_train").select(
        F.col(USER).cast("int").alias(USER), F.col(ITEM).cast("int").alias(ITEM), "rating"
    )
    users, items, offset = learners.rating_factors(train, USER, ITEM, "rating")
    p = users.select(USER, F.col("factors").alias("p"))
    q = items.select(ITEM, F.col("factors").alias("q"))
    held_out = rated.where(~F.col("is_train")).join(p, USER, "left").join(q, ITEM, "left")
    # Ids without factors are scored by the mean alone.
    dot = F.coalesce(array_dot(F.col("p"), F.col("q")), F.lit(0.0))
    scored = held_out.withColumn("predicted", dot + offset)
    return materialize(evaluation.mean_error(scored, "rating", "predicted"), "errors")


def als_topn(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    users, items = learners.retrieval_factors(pairs, USER, ITEM, "quantity_sum", rank=16)
    return scoring.top_n(users, items, 10, USER, ITEM)


def _network(spark: SparkSession, folder: str):
    """Factors of the pairs, and a network fitted to pairs and drawn negatives."""
    pairs = _written_pairs(spark, folder)
    labelled = materialize(
        sampling.ratio_negatives(pairs, 3, USER, ITEM).drop("draw"), "labelled"
    )
    users, items = learners.retrieval_factors(pairs, USER, ITEM, "quantity_sum", rank=8)
    rows = materialize(
        learners.crossed_features(labelled, users, items, USER, ITEM), "crossed"
    )
    network = learners.fit_network(rows, "label", 8)
    return pairs, users, items, rows, network


def ncf_two_stage(spark: SparkSession, folder: str) -> DataFrame:
    *_, rows, network = _network(spark, folder)
    return learners.network_probability(network, rows)


def ncf_topn(spark: SparkSession, folder: str) -> DataFrame:
    """Five best items per user by the network, bought and saturated ones left out."""
    pairs, users, items, _, network = _network(spark, folder)
    return learners.network_top_n(network, users, items, 5, USER, ITEM, exclude=pairs, below=1.0)


#: Sizes of a small network with fixed weights, from (p, q, p * q) to two outputs.
NETWORK = (3 * RANK, 8, 4, 2)


def fixed_layers() -> list[list[list[float]]]:
    """Seeded weights: for each layer and output the weights and, last, the intercept."""
    return [
        [[((53 * n + 31 * j + 17 * k) % 97) / 97 - 0.5 for k in range(n_in + 1)] for j in range(n_out)]
        for n, (n_in, n_out) in enumerate(zip(NETWORK, NETWORK[1:], strict=False))
    ]


def network_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The forward pass of a network with fixed weights over all pairs."""
    pairs = _written_pairs(spark, folder)
    users, items = _fixed_factors(pairs)
    rows = learners.crossed_arrays(pairs.select(USER, ITEM), users, items, USER, ITEM)
    return rows.select(USER, ITEM, F.round(network_probability("features", fixed_layers()), 6).alias("probability"))


# -- scoring and evaluation -----------------------------------------------

def score_all(spark: SparkSession, folder: str) -> DataFrame:
    users, items = _fixed_factors(_written_pairs(spark, folder))
    out = scoring.score_summary(users, items, USER, ITEM)
    return out.select(USER, "n_items", *[F.round(c, 6).alias(c) for c in ("mean_score", "least_score", "best_score")])


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each label against all vectors."""
    vectors = tables.vectors(spark, folder)
    width = 64
    means = vectors.groupBy("label").agg(
        F.array(*[F.avg(F.col("factors")[k]) for k in range(width)]).alias("factors")
    ).select(F.col("label").cast("bigint").alias("query_id"), "factors", F.lit(0.0).alias("bias"))
    out = scoring.nearest(materialize(means, "queries"), vectors, 10, "query_id", "vec_id")
    return out.select(
        "query_id", "vec_id", F.round("score", 6).alias("score"), F.col("position").cast("bigint").alias("position")
    )


def topn_table(spark: SparkSession, folder: str) -> DataFrame:
    """Five best items per user, not yet bought, with a score below 1."""
    pairs = _written_pairs(spark, folder)
    users, items = _fixed_factors(pairs, scale=4.0)
    out = scoring.top_n(users, items, 5, USER, ITEM, exclude=pairs, below=1.0)
    return out.select(
        USER, ITEM, F.col("position").cast("bigint").alias("position"), nine_decimals(F.col("score")).alias("score")
    )


def _top10(pairs: DataFrame, k: int = 10) -> DataFrame:
    users, items = _fixed_factors(pairs)
    return materialize(scoring.top_n(users, items, k, USER, ITEM), "top")


def _predicted(pairs: DataFrame, rows: DataFrame, rank: int = RANK) -> DataFrame:
    """Rows with the score of the fixed factors."""
    model = materialize(
        mf.start_model(pairs.select(USER).distinct(), pairs.select(ITEM).distinct(), rank), "factors"
    )
    return mf.predict(rows, model, USER, ITEM)


def regression_error(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    rating = composite_rating(F.col("transaction_count"), F.col("quantity_sum"))
    scored = _predicted(pairs, pairs.select(USER, ITEM, rating.alias("rating"))).withColumn(
        "rounded", two_decimals(F.round(F.col("score") + 3.0, 9))
    )
    out = evaluation.mean_error(
        scored, "rating", "rounded",
        {"mae": F.abs, "mse": lambda e: e * e, "worst_share": lambda e: F.when(F.abs(e) > 1, 1.0).otherwise(0.0)},
    )
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    labelled = materialize(sampling.ratio_negatives(pairs, 3, USER, ITEM), "labelled")
    scored = _predicted(pairs, labelled).withColumn("probability", F.round(sigmoid(F.col("score")), 9))
    out = evaluation.binary_metrics(scored, "label", "probability")
    return materialize(out, "metrics").withColumns({c: F.round(c, 6) for c in ("accuracy", "log_loss")})


def _confusion(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    chunked = materialize(_chunked_pairs(spark, folder), "chunked")
    return chunked, _top10(chunked)


def _rounded_confusion(df: DataFrame) -> DataFrame:
    shares = [c for c in df.columns if c.endswith(("precision", "recall", "hit_rate"))]
    return df.withColumns({c: F.round(c, 6) for c in shares})


def topk_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Top 10 against the last fold, and against all folds (prefix full_)."""
    chunked, best = _confusion(spark, folder)
    users, items = chunked.select(USER).distinct(), chunked.select(ITEM).distinct()
    truths = {"": F.col("chunk") == 4, "full_": F.lit(True)}
    return _rounded_confusion(
        evaluation.topk_confusion(best, chunked, users, items, USER, ITEM, truths)
    )


def fold_average(spark: SparkSession, folder: str) -> DataFrame:
    chunked, best = _confusion(spark, folder)
    users, items = chunked.select(USER).distinct(), chunked.select(ITEM).distinct()
    truths = {f"fold{f}_": F.col("chunk") == f for f in range(5)}
    wide = evaluation.topk_confusion(best, chunked, users, items, USER, ITEM, truths)
    out = evaluation.fold_average(evaluation.fold_rows(wide, list(truths)), evaluation.METRICS)
    return out.select(*[F.round(c, 6).alias(c) if c != "folds" else F.col(c) for c in out.columns])


def auc(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    users, items = _fixed_factors(pairs)
    places = scoring.true_item_places(pairs.where(_liked()), users, items, USER, ITEM)
    out = evaluation.mean_auc(places, items.count(), USER)
    return out.withColumn("auc", F.round("auc", 6))


def map_at_k(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _written_pairs(spark, folder)
    out = evaluation.map_at_k(_top10(pairs, 100), pairs.where(_liked()), 100, USER, ITEM)
    return out.withColumn("map_at_k", F.round("map_at_k", 6))


# -- streaming -------------------------------------------------------------

def _event_stream(spark: SparkSession, folder: str, batches: int = 6) -> DataFrame:
    """All events as a stream of several micro-batches, a file each, in the order of their ids."""
    events = tables.table(spark, folder, "events")
    path = new_path(spark, "events")
    least, most = events.agg(F.min("event_id"), F.max("event_id")).first()
    width = (most - least) // batches + 1
    for n in range(batches):
        part = events.where(F.col("event_id").between(least + n * width, least + (n + 1) * width - 1))
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_mean(spark: SparkSession, folder: str) -> DataFrame:
    """The running mean after all micro-batches; the records of the first ones have been put together."""
    target, checkpoint = new_path(spark, "stream-mean"), new_path(spark, "stream-checkpoint")
    query = running.running_mean(_event_stream(spark, folder), "value", target, checkpoint, compact=3)
    query.awaitTermination()
    return running.latest_mean(spark, target).select("n", F.round("mean", 6).alias("mean"))


def stream_ids(spark: SparkSession, folder: str) -> DataFrame:
    target, checkpoint = new_path(spark, "stream-ids"), new_path(spark, "stream-checkpoint")
    query = running.grow_codes(
        _event_stream(spark, folder), "user_id", "event_id", target, checkpoint, buckets=8, compact=3
    )
    query.awaitTermination()
    return running.read_codes(spark, target, "user_id", "bigint")


def all_queries() -> dict[str, Query]:
    found = [
        transactions_csv, chunk_files, renamed_csv, ratings_tsv, binary_feedback, labelled_pair_files, chunk_csv,
        appended_pairs, stored_model, run_records, flagship, curate_ds1, curate_ds2, mcq, interaction_features, global_mean, dataset_profile,
        first_non_null, quantile_histogram, equal_width_rating, quartile_rating, shift_years,
        time_chunks, random_split, holdout_heavy_users, ground_truth, cv_folds, cv_posneg_folds,
        catalogues, cardinalities, oov_lookup, positive_pairs, complement, rated_triplets,
        triplet_counts, catalogue_triplets, synthetic_pairs, grown_dataset, tt_dataset,
        negative_feedback, ncf_dataset, ratio_negatives, ratio_negatives_unseen, binary_matrix, sparse_matrix, mf_step, mf_epochs,
        logistic_step, bpr_step, bpr_loss, bpr_epoch, bpr_epoch_loss, network_scores, svd_cross_validation, als_ratings, als_topn, ncf_two_stage, ncf_topn, score_all, vector_topk,
        topn_table, regression_error, binary_metrics, topk_confusion, fold_average, auc, map_at_k,
        stream_mean, stream_ids,
    ]
    return {f.__name__: f for f in found}
