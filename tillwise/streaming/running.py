"""A running mean and a growing id dictionary over a stream.

Both keep their state as segments: folders that cover a range of micro-batches
and count only when their write is committed.  A micro-batch reads segments of
earlier batches and writes its own, so a batch that is run again gives the same
result.  Every ``COMPACT`` batches the segments before the running one are put
together, so that their number stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tillwise.operators.ranking import global_rank
from tillwise.scratch import materialize, temporary
from tillwise.sources import folders

#: Micro-batches after which segments are put together, and buckets of a dictionary.
COMPACT, BUCKETS = 16, 64


@dataclass(frozen=True, order=True)
class Segment:
    """A folder with what the batches ``first`` to ``last`` added; ``end`` counts all up to them."""

    first: int
    last: int
    end: int

    @property
    def name(self) -> str:
        return f"{self.first}-{self.last}-{self.end}"


def segments(spark: SparkSession, target: str, before: int | None = None) -> list[Segment]:
    """Committed segments that together cover all batches, or those below ``before``, each once."""
    known = [Segment(*map(int, name.split("-"))) for name in folders.finished(spark, target)]
    chain: list[Segment] = []
    at = 0
    while fitting := [s for s in known if s.first == at and (before is None or s.last < before)]:
        chain.append(max(fitting, key=lambda s: s.last))
        at = chain[-1].last + 1
    return chain


def _paths(target: str, chain: list[Segment]) -> list[str]:
    return [f"{target}/{s.name}" for s in chain]


def _compact(spark: SparkSession, target: str, batch: int, every: int, put: Callable[[list[Segment], str], None]) -> None:
    """Put the segments before ``batch`` together; they go when the new one is committed."""
    chain = segments(spark, target, batch)
    if batch % every or len(chain) < 2:
        return
    whole = Segment(0, chain[-1].last, chain[-1].end)
    put(chain, f"{target}/{whole.name}")
    for path in _paths(target, chain):
        folders.delete(spark, path)


# -- running mean ------------------------------------------------------------

MEANS = "batch bigint, n bigint, total double"


def running_mean(stream: DataFrame, value: str, target: str, checkpoint: str, compact: int = COMPACT) -> StreamingQuery:
    """One record (count and sum) of every micro-batch; they merge to the mean of all rows so far."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        row = batch.agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("total"))
        row = row.select(F.lit(batch_id).cast("bigint").alias("batch"), "n", "total")
        row.coalesce(1).write.mode("overwrite").parquet(f"{target}/{Segment(batch_id, batch_id, 0).name}")

        def put(chain: list[Segment], path: str) -> None:
            spark.read.schema(MEANS).parquet(*_paths(target, chain)).coalesce(1).write.mode("overwrite").parquet(path)

        _compact(spark, target, batch_id, compact, put)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _records(spark: SparkSession, target: str) -> DataFrame:
    paths = _paths(target, segments(spark, target))
    return spark.read.schema(MEANS).parquet(*paths) if paths else spark.createDataFrame([], MEANS)


def read_running_mean(spark: SparkSession, target: str) -> DataFrame:
    """(batch, n, mean) after every micro-batch."""
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # a row for each batch
    n, total = F.sum("n").over(upto), F.sum("total").over(upto)
    return _records(spark, target).select("batch", n.alias("n"), F.try_divide(total, n).alias("mean"))


def latest_mean(spark: SparkSession, target: str) -> DataFrame:
    """(n, mean) of all rows so far."""
    both = _records(spark, target).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"))
    return both.select("n", F.try_divide("total", "n").alias("mean"))


# -- id dictionary -----------------------------------------------------------


def grow_codes(
    stream: DataFrame, key: str, order: str, target: str, checkpoint: str, code: str = "code",
    buckets: int = BUCKETS, compact: int = COMPACT,
) -> StreamingQuery:
    """Give every id that was not seen before the next free code.

    The dictionary is stored in hash buckets of the id, and a micro-batch reads
    the buckets of its own ids only.  Inside a batch, new ids are numbered by
    their first ``order`` value; how many codes are taken is in the name of the
    last segment.
    """
    kind = dict(stream.dtypes)[key]
    schema = f"`{key}` {kind}, `{code}` bigint, bucket int"

    def read(spark: SparkSession, chain: list[Segment]) -> DataFrame:
        # Folders of one table each: their parts are the buckets.
        found = spark.createDataFrame([], schema)
        for path in _paths(target, chain):
            found = found.unionByName(spark.read.schema(schema).parquet(path))
        return found

    def assign(batch: DataFrame, batch_id: int) -> None:
        with temporary(batch.sparkSession):
            write(batch.sparkSession, batch, batch_id)

    def write(spark: SparkSession, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        seen = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
        seen = materialize(seen.withColumn("bucket", bucket), "seen")
        chain = segments(spark, target, batch_id)
        start = chain[-1].end if chain else 0
        if chain:
            touched = [r[0] for r in seen.select("bucket").distinct().collect()]  # numbers below ``buckets``
            known = read(spark, chain).where(F.col("bucket").isin(touched))
            seen = seen.join(known.select(key, "bucket"), [key, "bucket"], "left_anti")
        fresh = materialize(global_rank(seen, "_first", key, name=code), "fresh")
        end = start + fresh.count()
        rows = fresh.select(key, (F.col(code) + F.lit(start)).cast("bigint").alias(code), "bucket")
        # A batch that is run again may have left its folder.
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{target}/{Segment(batch_id, batch_id, end).name}"
        )

        def put(chain: list[Segment], path: str) -> None:
            read(spark, chain).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

        _compact(spark, target, batch_id, compact, put)

    return (
        stream.writeStream.foreachBatch(assign)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_codes(spark: SparkSession, target: str, key: str, kind: str, code: str = "code") -> DataFrame:
    """(key, code) of all ids so far."""
    schema = f"`{key}` {kind}, `{code}` bigint"
    found = spark.createDataFrame([], schema)
    for path in _paths(target, segments(spark, target)):
        found = found.unionByName(spark.read.schema(schema).parquet(path).select(key, code))
    return found
