import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.sources import readers, sinks
from tillwise.streaming import running


def test_transactions_with_decimal_comma_and_bad_lines(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        "DOC_NUMBER_TEXT,CALDAY,MATERIAL,MATERIAL_TEXT,MATL_GROUP,QUANTITY,is_accessory,CUSTOMER_ID\n"
        '1,20200101,m1,pump,g,"1,5",True,c1\n'
        "2,20200102,m2,pump,g,,False,c2\n"
        "3,20200103,m3,pump,g,7,False,c3,too,long\n"
        "4,20200104,m4,pump,g,notanumber,False,c4\n"
        "5,20200105,m5,pump,g,-3,False,c5\n"
        '6,20200106,"m,6",pump,g,"2,25"\n'
    )
    got = readers.read_transactions(spark, str(path)).orderBy("DOC_NUMBER_TEXT").collect()
    assert [(r.DOC_NUMBER_TEXT, r.QUANTITY, r.is_accessory) for r in got] == [
        ("1", 1.5, True), ("2", None, False), ("5", -3.0, False), ("6", 2.25, None)
    ]
    # The same lines, whichever columns are read.
    assert readers.read_transactions(spark, str(path)).select("QUANTITY").count() == 4
    assert readers.read_transactions(spark, str(path)).count() == 4


def test_quotes_inside_texts_and_short_bad_lines(spark, tmp_path):
    import pandas as pd

    path = tmp_path / "raw.csv"
    path.write_text(
        "DOC_NUMBER_TEXT,CALDAY,MATERIAL,MATERIAL_TEXT,MATL_GROUP,QUANTITY,is_accessory,CUSTOMER_ID\n"
        '1,20200101,m1,"x, ""y"", z",g,"1,5",True,c1\n'
        "2,20200102,m2,pump,g,bad\n"
        '3,20200102,m2,"a ""b"", c",g,"2,5"\n'
    )
    got = readers.read_transactions(spark, str(path)).orderBy("DOC_NUMBER_TEXT").collect()
    assert [(r.DOC_NUMBER_TEXT, r.MATERIAL_TEXT, r.QUANTITY) for r in got] == [
        ("1", 'x, "y", z', 1.5), ("3", 'a "b", c', 2.5)
    ]
    texts = ['x, "y", z', "plain", 'a "b"', "c\\d, e"]
    frame = pd.DataFrame({"u": range(4), "t": texts})
    frame.to_csv(tmp_path / "p.csv", index=False)
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    assert [r.s for r in readers.read_renamed(spark, str(tmp_path / "p.csv"), schema).orderBy("n").collect()] == texts
    sinks.write_csv(spark.createDataFrame(frame).coalesce(1), str(tmp_path / "out"))
    back = pd.read_csv(next((tmp_path / "out").glob("part-*")))
    assert back.sort_values("u").t.tolist() == texts


def test_renamed_by_position(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("A,B\n1,2\n")
    schema = T.StructType([T.StructField("u", T.IntegerType()), T.StructField("i", T.IntegerType())])
    assert [tuple(r) for r in readers.read_renamed(spark, str(path), schema).collect()] == [(1, 2)]


def test_latin_1_tab_separated_ratings(spark, tmp_path):
    path = tmp_path / "u.data"
    path.write_bytes("ü1\t5\t3\t881250949\nb\t6\t1.5\t881250950\n".encode("latin-1"))
    assert [tuple(r) for r in readers.read_ratings_tsv(spark, str(path)).collect()] == [("ü1", "5", 3.0), ("b", "6", 1.5)]
    assert {r.rating for r in readers.read_ratings_tsv(spark, str(path), rating=1).collect()} == {1.0}


def test_pair_files_with_and_without_labels(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("a,b,c,d,e\n007,1,m,2,1.0\n008,1,m,2,x\n")
    assert [tuple(r) for r in readers.read_pairs(spark, str(path), labelled=True).collect()] == [("007", "m", 1), ("008", "m", None)]
    path.write_text("a,b\n007,m\n")
    assert [tuple(r) for r in readers.read_pairs(spark, str(path), labelled=False).collect()] == [("007", "m")]


def test_chunk_files_keep_their_number(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"set_{n}.csv").write_text(f"x\n{n * 10}\n")
    schema = T.StructType([T.StructField("x", T.IntegerType())])
    got = readers.read_chunks(spark, [str(tmp_path / f"set_{n}.csv") for n in (1, 2)], schema)
    assert sorted(tuple(r) for r in got.collect()) == [(10, 1), (20, 2)]


def test_csv_and_chunk_sinks_write_every_row_once(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("chunk"))
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(r.id for r in back.collect()) == list(range(100))
    sinks.write_chunks(df, str(tmp_path / "chunks"), files_per_chunk=2)
    back = spark.read.parquet(str(tmp_path / "chunks"))
    assert {r.chunk: r["count"] for r in back.groupBy("chunk").count().collect()} == {c: 20 for c in range(5)}
    assert sorted(p.name for p in (tmp_path / "chunks").glob("chunk=*")) == [f"chunk={c}" for c in range(5)]


def test_append_catalogues_models_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (1, 3)], "u int, i int")
    for _ in range(2):
        sinks.append_rows(df, str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 4
    sinks.write_catalogues(df, "u", "i", str(tmp_path / "cat"))
    assert spark.read.parquet(str(tmp_path / "cat" / "users")).count() == 1
    assert spark.read.parquet(str(tmp_path / "cat" / "items")).count() == 2
    model = spark.createDataFrame([("u", 1, 0.5, 0.0), ("i", 2, 0.25, 0.1)], "side string, id bigint, f0 double, bias double")
    sinks.save_model(model, str(tmp_path / "model"), rank=1, rate=0.1)
    back, settings = sinks.load_model(spark, str(tmp_path / "model"))
    assert settings == {"rank": 1, "rate": 0.1}
    assert sorted(tuple(r) for r in back.select(*model.columns).collect()) == sorted(tuple(r) for r in model.collect())
    for n in range(2):
        sinks.append_run(spark, str(tmp_path / "runs"), {"epochs": n}, {"mse": n / 2})
    runs = spark.read.schema("config string, metrics map<string,double>").json(str(tmp_path / "runs"))
    assert sorted((r.config, r.metrics["mse"]) for r in runs.collect()) == [('{"epochs": 0}', 0.0), ('{"epochs": 1}', 0.5)]


def split_events(spark, folder, tmp_path, files):
    target = str(tmp_path / f"in{files}")
    events = spark.read.parquet(f"{folder}/events.parquet")
    n = events.count()
    for f in range(files):
        part = events.where((F.col("event_id") >= n * f // files) & (F.col("event_id") < n * (f + 1) // files))
        part.coalesce(1).write.mode("append").parquet(target)
    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(target)
    )
    return events, stream


@pytest.mark.parametrize("files", [1, 5])
def test_running_mean_equals_batch(spark, folder, tmp_path, files):
    events, stream = split_events(spark, folder, tmp_path, files)
    out = str(tmp_path / "out")
    running.running_mean(stream, "value", out, str(tmp_path / "cp")).awaitTermination()
    got = running.latest_mean(spark, out).first()
    want = events.agg(F.count("value"), F.avg("value")).first()
    assert got.n == want[0] and got["mean"] == pytest.approx(want[1])
    assert running.read_running_mean(spark, out).count() == files


@pytest.mark.parametrize("files", [1, 5])
def test_codes_are_dense_in_order_of_first_sight(spark, folder, tmp_path, files):
    events, stream = split_events(spark, folder, tmp_path, files)
    out = str(tmp_path / "codes")
    running.grow_codes(stream, "user_id", "event_id", out, str(tmp_path / "cp")).awaitTermination()
    got = {r.user_id: r.code for r in running.read_codes(spark, out, "user_id", "bigint").collect()}
    seen = list(dict.fromkeys(r.user_id for r in events.orderBy("event_id").collect()))
    assert got == {u: n for n, u in enumerate(seen)}


def test_a_batch_that_runs_again_gives_the_same_codes(spark, tmp_path):
    out = str(tmp_path / "codes")
    captured = {}

    class Writer:
        def foreachBatch(self, f):
            captured["f"] = f
            return self

        def __getattr__(self, _):
            return lambda *a, **k: self

    class Stream:
        dtypes = [("k", "string"), ("o", "int")]
        writeStream = Writer()

    running.grow_codes(Stream(), "k", "o", out, "unused")
    one = spark.createDataFrame([("b", 1), ("a", 2), (None, 3)], "k string, o int")
    two = spark.createDataFrame([("a", 4), ("z", 5), ("c", 6)], "k string, o int")
    for batch, number in ((one, 0), (two, 1), (two, 1), (one, 0), (two, 1)):
        captured["f"](batch, number)
    got = {r.k: r.code for r in running.read_codes(spark, out, "k", "string").collect()}
    assert got == {"b": 0, "a": 1, "z": 2, "c": 3}


def test_a_failed_save_leaves_the_old_model(spark, tmp_path):
    path = str(tmp_path / "model")
    model = spark.createDataFrame([("u", 1, [0.5], 0.0)], "side string, id bigint, factors array<double>, bias double")
    with pytest.raises(ValueError, match="no published"):
        sinks.load_model(spark, path)
    assert sinks.save_model(model, path, rank=1) == 1
    broken = model.withColumn("bias", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.save_model(broken, path, rank=2)
    back, settings = sinks.load_model(spark, path)
    assert settings == {"rank": 1} and back.count() == 1
    # A model that was read from the path can be saved there again.
    for n in (2, 3, 4):
        newer = sinks.load_model(spark, path)[0].select("side", "id", "factors", F.lit(float(n)).alias("bias"))
        assert sinks.save_model(newer, path, rank=n) == n
    back, settings = sinks.load_model(spark, path)
    assert settings == {"rank": 4} and back.first().bias == 4.0
    assert sinks.versions(spark, path) == [3, 4] and sinks.load_model(spark, path, 3)[1] == {"rank": 3}


def test_state_of_many_batches_stays_in_few_folders(spark, folder, tmp_path):
    """Seven micro-batches, put together every third: the same mean and codes, few folders, only touched buckets read."""
    events, stream = split_events(spark, folder, tmp_path, 7)
    means, codes = str(tmp_path / "means"), str(tmp_path / "codes")
    running.running_mean(stream, "value", means, str(tmp_path / "cp1"), compact=3).awaitTermination()
    running.grow_codes(stream, "user_id", "event_id", codes, str(tmp_path / "cp2"), buckets=4, compact=3).awaitTermination()
    want = events.agg(F.count("value"), F.avg("value")).first()
    got = running.latest_mean(spark, means).first()
    assert got.n == want[0] and got["mean"] == pytest.approx(want[1])
    assert [r.batch for r in running.read_running_mean(spark, means).orderBy("batch").collect()] == list(range(7))
    seen = list(dict.fromkeys(r.user_id for r in events.orderBy("event_id").collect()))
    assert {r.user_id: r.code for r in running.read_codes(spark, codes, "user_id", "bigint").collect()} == {u: n for n, u in enumerate(seen)}
    for target in (means, codes):
        chain = running.segments(spark, target)
        assert [(s.first, s.last) for s in chain] == [(0, 5), (6, 6)]
    assert len(list((tmp_path / "codes").glob("0-5-*/bucket=*/*.parquet"))) <= 4
    assert running.segments(spark, codes)[-1].end == len(seen)
