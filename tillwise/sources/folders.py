"""Folders of finished tables below a path, on whatever file system Spark writes to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` whose write has been committed."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n in names if fs.exists(done(f"{path}/{n}/_SUCCESS")))


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)
