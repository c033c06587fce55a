"""Connected components of a table of links, by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.scratch import materialize, temporary


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
    ).first()
    return int(row[0]), int(row[1])


def _large(links: DataFrame) -> DataFrame:
    """Every node passes its smallest neighbour (or itself) on to its greater neighbours."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the smallest of them; links go from greater to smaller."""
    least = materialize(links.groupBy("a").agg(F.min("b").alias("m")), "least")
    near = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it is connected to.

    Links of a node with itself and null ends are skipped.  Every round writes
    its links; a round that changes nothing ends the loop, and then all links
    lead from a node to its root.
    """
    spark = links.sparkSession
    now = materialize(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = _state(now)
    while state[0]:
        with temporary(spark) as keep:
            after = keep(_small(materialize(_large(now), "large")), "links")
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
