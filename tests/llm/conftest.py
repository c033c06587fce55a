import pytest


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    long = "word " * 40_000 + "x" * 50_000
    rows = [
        (1, "the of and", "en", "s", 1, "a", 9.0),
        (1, "the of and", "en", "s", 1, "a", 9.0),
        (2, "", None, None, None, None, None),
        (3, None, "en", "s", 1, "a", 9.0),
        (None, "no id here", "en", None, 1, "a", 9.0),
        (None, None, None, None, None, None, None),
        (4, long, "en", "s", 1, "a", 9.0),
        (5, " \t\n", "en", "s", 1, "a", 9.0),
        (6, "Ünï \u2028 日本語 \x1c 😀 <|endoftext|> ▁▁", "en", "s", 1, "a", 9.0),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
    )


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.where("false")
