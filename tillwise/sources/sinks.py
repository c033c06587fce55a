"""Sinks; every row is written once, by the tasks that hold it."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.sources import folders


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in every part file; quotes inside a text are doubled."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_chunks(
    df: DataFrame, path: str, chunk: str = "chunk", files_per_chunk: int | None = None,
    rows_per_file: int = 1_000_000,
) -> None:
    """One folder per chunk, its rows dealt over several tasks by a row hash.

    Without ``files_per_chunk`` the largest chunk gets a file for every
    ``rows_per_file`` rows, and the others as many.
    """
    if files_per_chunk is None:
        largest = df.groupBy(chunk).count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
        files_per_chunk = -(-largest // rows_per_file)
    dealt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_chunk))
    df.repartition(F.col(chunk), dealt).write.partitionBy(chunk).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append triplets or negative pairs to a parquet table."""
    df.write.mode("append").parquet(path)


def write_catalogues(df: DataFrame, user: str, item: str, path: str) -> None:
    """The distinct users and items of a table, one table each."""
    for name, column in (("users", user), ("items", item)):
        df.select(column).distinct().write.mode("overwrite").parquet(f"{path}/{name}")


def save_model(model: DataFrame, path: str, **settings: Any) -> int:
    """A factor table and the settings it was fitted with, as a new version; gives its number.

    The factors are written first and the version is published last, by the
    settings, which is one committed write.  A save that fails before leaves
    the version before it in force.  That one is kept, older ones are deleted.
    """
    spark = model.sparkSession
    known = versions(spark, path)
    number = known[-1] + 1 if known else 1
    model.write.mode("overwrite").partitionBy("side").parquet(f"{path}/factors/{number}")
    row = spark.createDataFrame([(json.dumps(settings, sort_keys=True),)], "settings string")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/published/{number}")
    for old in known[:-1]:
        folders.delete(spark, f"{path}/published/{old}")
        folders.delete(spark, f"{path}/factors/{old}")
    return number


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions of a model, oldest first."""
    return sorted(int(name) for name in folders.finished(spark, f"{path}/published"))


def load_model(spark: SparkSession, path: str, version: int | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """The newest published version, or the one asked for."""
    known = versions(spark, path)
    if not known or version not in (None, *known):
        raise ValueError(f"no published version {version or ''} in {path}")
    number = known[-1] if version is None else version
    text = spark.read.schema("settings string").json(f"{path}/published/{number}").first()[0]
    return spark.read.parquet(f"{path}/factors/{number}"), json.loads(text)


def append_run(
    spark: SparkSession, path: str, config: Mapping[str, Any], metrics: Mapping[str, float]
) -> None:
    """One line per run: the configuration and what it reached."""
    row = [(json.dumps(dict(config), sort_keys=True), {k: float(v) for k, v in metrics.items()})]
    spark.createDataFrame(row, "config string, metrics map<string,double>").write.mode(
        "append"
    ).json(path)
