"""Tables written between the stages of a job.

A written table cuts the lineage, survives the loss of executors, and gives
the optimizer a real size for the joins that follow.  Everything goes below
the shared folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PARTITIONS = "spark.sql.shuffle.partitions"
#: Bytes of the files read for each partition of a shuffle.
BYTES_A_PARTITION = 8 * 1024 * 1024


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application below the shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tillwise-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tillwise-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str = "table") -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once and go on from the written copy."""
    return _write(df, label, _scopes()[-1:])


def _write(df: DataFrame, label: str, owners: list[list[str]]) -> DataFrame:
    path = new_path(df.sparkSession, label)
    for owner in owners:
        owner.append(path)
    with _enough_partitions(df):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _enough_partitions(df: DataFrame) -> Iterator[None]:
    """Inside, shuffles have as many partitions as the input of ``df`` asks for; the setting is put back.

    With a fixed number a task's share grows with the tables until sorts and
    hash tables spill.  Adaptive execution merges what turns out small.
    """
    conf = df.sparkSession.conf
    set_before = conf.get(PARTITIONS)
    needed = -(-input_bytes(df) // BYTES_A_PARTITION)
    if needed <= int(set_before):
        yield
        return
    conf.set(PARTITIONS, str(needed))
    try:
        yield
    finally:
        conf.set(PARTITIONS, set_before)


def partitions_for(df: DataFrame) -> int:
    """Partitions for a shuffle of all rows of ``df`` that nothing merges afterwards."""
    spark = df.sparkSession
    fewest = min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism)
    return max(1, fewest, -(-input_bytes(df) // BYTES_A_PARTITION))


_local = threading.local()


def _scopes() -> list[list[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """Delete at the end the tables written inside, so that loops do not fill the folder.

    Gives ``keep``, which writes a table that stays (until the end of an
    enclosing block).  Nothing else made inside may be used afterwards.
    """
    scopes = _scopes()
    enclosing = scopes[-1:]
    mine: list[str] = []
    scopes.append(mine)

    def keep(df: DataFrame, label: str = "table") -> DataFrame:
        return _write(df, label, enclosing)

    try:
        yield keep
    finally:
        scopes.pop()
        for path in mine:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Delete the written table that ``df`` reads; it may not be used afterwards."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if scratch_root(spark).rsplit("/", 1)[-1] not in folder:
            raise ValueError(f"{folder} is no table of this application")
        _delete(spark, folder)


def drop_all(spark: SparkSession) -> None:
    """Delete the application's folder; no written table may be used afterwards."""
    _delete(spark, scratch_root(spark))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; exact file size for a written table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Size of all files that ``df`` reads; what has no known size adds nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(n).stats().sizeInBytes())) for n in range(leaves.size())]
    return sum(size for size in sizes if size < 1 << 60)
