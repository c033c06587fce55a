import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal
from tillwise.plans.oracles import all_oracles
from tillwise.plans.queries import all_queries
from tillwise.scratch import materialize, scratch_root, temporary

SLOW = {"ncf_two_stage", "ncf_topn", "als_topn", "als_ratings"}
# Two growth rounds and three negative rounds are what the SQL spells out; the smallest
# tables need other numbers of rounds.
OTHER_ROUNDS = {"cv_posneg_folds", "grown_dataset", "negative_feedback", "ncf_dataset"}


@pytest.fixture(scope="module")
def duck(folder):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def test_every_query_but_the_learned_ones_has_sql():
    assert set(all_queries()) - set(all_oracles()) == SLOW
    assert set(all_oracles()) <= set(all_queries())
    assert set(all_queries()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(all_oracles()) - OTHER_ROUNDS))
def test_query_equals_sql(spark, duck, folder, name):
    import pandas as pd

    got = entry.queries()[name](spark, folder).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


@pytest.mark.parametrize(
    "name",
    ["interaction_features", "oov_lookup", "complement", "rated_triplets", "bpr_step", "mf_step", "auc",
     "binary_metrics"],
)
def test_query_with_every_heavy_key_split_equals_sql(spark, duck, folder, name, monkeypatch):
    """Every user and item above 30 rows counts as hot and is dealt over salts."""
    import pandas as pd

    from tillwise.operators import skew

    monkeypatch.setattr(skew, "SMALL_BYTES", 0)
    monkeypatch.setattr(skew, "HOT_ROWS", 30)
    got = entry.queries()[name](spark, folder).toPandas()
    want = duck.execute(entry.oracle_sql()[name]).fetchdf()
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False)


def test_written_tables_lie_below_the_shared_folder(spark):
    table = materialize(spark.range(3))
    assert all(scratch_root(spark) in f for f in table.inputFiles())
    assert table.count() == 3


def test_temporary_tables_are_deleted_and_kept_ones_stay(spark):
    import os

    def folder_of(df):
        return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))

    with temporary(spark) as outer:
        with temporary(spark) as keep:
            gone = folder_of(materialize(spark.range(3)))
            kept = keep(spark.range(4))
            stays = outer(spark.range(5))
        assert not os.path.exists(gone)
        assert kept.count() == 4
        inner = folder_of(kept)
    assert not os.path.exists(inner)
    assert stays.count() == 5


def test_cross_validation_fits_all_factors(spark, folder, monkeypatch):
    from tillwise.plans import queries

    asked = {}

    def spy(rows, *columns, folds=5, epochs=1, k=10):
        asked.update(rank=columns[4].rank, folds=folds, epochs=epochs, k=k)
        return rows

    monkeypatch.setattr(queries.crossval, "cross_validate", spy)
    queries.svd_cross_validation(spark, folder)
    assert asked == {"rank": 50, "folds": 5, "epochs": 1, "k": 10}
