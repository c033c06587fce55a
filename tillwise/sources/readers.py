"""Text sources with declared schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the transaction export.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("DOC_NUMBER_TEXT", T.StringType()),
        T.StructField("CALDAY", T.StringType()),
        T.StructField("MATERIAL", T.StringType()),
        T.StructField("MATERIAL_TEXT", T.StringType()),
        T.StructField("MATL_GROUP", T.StringType()),
        T.StructField("QUANTITY", T.DecimalType(20, 6)),
        T.StructField("is_accessory", T.BooleanType()),
        T.StructField("CUSTOMER_ID", T.StringType()),
    ]
)


def read_transactions(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType = RAW_SCHEMA
) -> DataFrame:
    """CSV with a header and decimal commas; malformed lines are dropped.

    A line with too many fields or an unreadable value is malformed; a line
    with too few is filled up with NULL.  Doubled quotes inside a quoted text
    are one quote.  Decimal columns carry the comma (a
    locale setting) and come out as doubles.  Bad lines are told by the record
    column, not by a drop mode, so the choice of columns cannot change them.
    """
    bad = "_corrupt_record"
    rows = (
        spark.read.schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())]))
        .option("header", True)
        .option("locale", "de")
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", bad)
        .csv(path)
    )
    unquoted = F.regexp_replace(bad, '"[^"]*"', "")
    fields = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit(""))) + 1
    decimals = [f.name for f in schema if isinstance(f.dataType, T.DecimalType)]
    # Of a short line the values that are there must be readable all the same.
    plain = ", ".join(f"`{f.name}` string" for f in schema)
    there = F.from_csv(bad, plain, {"escape": '"'})
    unread = reduce(
        lambda a, b: a | b,
        [(F.length(F.coalesce(there[f.name], F.lit(""))) > 0) & F.col(f.name).isNull() for f in schema],
    )
    # A value nobody asks for is not parsed, and so not found to be bad.  This
    # condition always holds; it asks for every column.
    parsed = F.length(F.concat_ws("", *[F.col(f.name).cast("string") for f in schema])) >= 0
    return (
        rows.where((F.col(bad).isNull() | ((fields < len(schema)) & ~unread)) & parsed)
        .drop(bad)
        .withColumns({c: F.col(c).cast("double") for c in decimals})
    )


def read_renamed(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType
) -> DataFrame:
    """CSV whose header line is replaced, by position, with the schema's names."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("escape", '"')
        .csv(path)
    )


def read_ratings_tsv(
    spark: SparkSession, path: str | Sequence[str], rating: float | None = None
) -> DataFrame:
    """Tab-separated, headerless, Latin-1 (user, movie, rating, time); time is left out.

    With ``rating`` every row gets that constant: explicit to implicit feedback.
    """
    schema = "user_id string, movie_id string, rating double, unix_timestamp bigint"
    rows = (
        spark.read.schema(schema).option("sep", "\t").option("encoding", "ISO-8859-1").csv(path)
    ).select("user_id", "movie_id", "rating")
    return rows if rating is None else rows.withColumn("rating", F.lit(float(rating)))


def read_pairs(
    spark: SparkSession, path: str | Sequence[str], labelled: bool
) -> DataFrame:
    """Chunk files of pairs; ids stay text, the label becomes an integer.

    ``labelled`` selects the five-column layout with a label, else the layout
    with the two ids only.
    """
    names = (
        ["customer_id", "normalized_customer_id", "material", "product_id", "rating_type"]
        if labelled else ["customer_id", "material"]
    )
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = read_renamed(spark, path, schema)
    if not labelled:
        return rows
    label = F.col("rating_type").try_cast("double").cast("int")
    return rows.select("customer_id", "material", label.alias("rating_type"))


def read_chunks(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType,
    number: str = r"_(\d+)\.csv", name: str = "chunk",
) -> DataFrame:
    """Several chunk files in one scan, with the chunk number of the file name."""
    found = F.regexp_extract(F.input_file_name(), number, 1)
    return read_renamed(spark, list(paths), schema).withColumn(name, found.try_cast("int"))
