"""Exact top-k by inner product, as a Voronoi join of queries and data.

Queries and data are grouped by their nearest pivot.  Summaries bound every
score between a group of queries and a group of data: with the pivots p and r,
the radius s of the queries around p and the radius t of the data around r, no
score exceeds p.r + |p| t + s |r| + s t.  A lower bound of the k-th best score
of every query comes from its scores against a bounded sample; the smallest
of a query group holds for the group.  A data row goes to those query groups
only whose bounds, of its group and then of its own (p.x + s |x|), reach that
score, and each meeting of a block of queries and a block of data is solved
on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.scratch import materialize

K = 10
#: Vectors that pivots and lower bounds are taken from, and data pivots among them.
SAMPLE = 2_048
PIVOTS = 64
#: Query pivots, at least and per so many queries.
QUERY_PIVOTS, QUERIES_A_PIVOT = 8, 1_024
#: Queries and data rows of a block.
QUERY_BLOCK, DATA_BLOCK = 1_024, 32_768
#: Exact in doubles below this.
EXACT = float(2**53)
LONG = 2**63 - 1


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component; null for a vector with a null or non-finite component."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter vectors are filled up with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products; where doubles would round, whole numbers without a limit, held to a long at the end."""
    if queries.shape[1] == 0:
        return np.zeros((len(queries), len(data)), dtype=np.int64)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if bound < EXACT:
        return (queries @ data.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    found = whole(queries) @ whole(data).T
    return np.array([[max(-LONG - 1, min(LONG, v)) for v in row] for row in found], dtype=np.int64).reshape(found.shape)


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each row and the distance to it."""
    square = (pivots * pivots).sum(axis=1)
    at = np.empty(len(x), dtype=np.int64)
    for a in range(0, len(x), 4096):
        at[a : a + 4096] = np.argmin(square - 2 * x[a : a + 4096] @ pivots.T, axis=1)
    return at, np.sqrt(((x - pivots[at]) ** 2).sum(axis=1))


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows of the sample, each the farthest from those before it; equal rows count once."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def best(ids: np.ndarray, values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest values, ties to the smaller id."""
    if len(values) > 4 * k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        at = np.flatnonzero(values >= least)
    else:
        at = np.arange(len(values))
    return at[np.lexsort((ids[at], -values[at]))[:k]]


def top_k(
    vectors: DataFrame,
    k: int = K,
    every: int = 100,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
    data_block: int = DATA_BLOCK,
) -> DataFrame:
    """The k best rows for every row whose id is divisible by ``every``: query_id, rank, vec_id, score.

    Components are turned into floor(1024 * x).  Rows without an id or with a
    null or non-finite component take no part; vectors of different lengths
    are filled up with zeros; scores beyond a long are held at its limits.  A
    query does not meet rows with its own id.  An id that occurs several times
    is one query, with its smallest vector, and several candidates.
    """
    spark = vectors.sparkSession
    rows = materialize(
        vectors.select(F.col(vec_id).cast("bigint").alias("id"), quantised(F.col(vector)).alias("v")).where(
            F.col("id").isNotNull() & F.col("v").isNotNull()
        ),
        "vectors",
    )
    queries = materialize(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_queries = queries.count()
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not n or not n_queries:
        return spark.createDataFrame([], out)

    # A bounded sample gives pivots and, by real scores, lower bounds.
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample_ids = taken.column("id").to_numpy()
    sample = matrix(taken.column("v").combine_chunks(), width)
    pivots = spread(sample, PIVOTS)
    query_pivots = spread(sample, min(SAMPLE, max(QUERY_PIVOTS, math.ceil(n_queries / QUERIES_A_PIVOT))))
    known = spark.sparkContext.broadcast((sample_ids, sample, query_pivots))

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample_ids, sample, pivots = known.value
        for batch in batches:
            x = matrix(batch.column("v"), width)
            at, far = nearest(x, pivots)
            ids = batch.column("id").to_numpy()
            s = scores(x, sample).astype(np.float64)
            s[ids[:, None] == sample_ids[None, :]] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(x), -np.inf)
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "v": batch.column("v"), "part": at, "far": far, "least": least}
            )

    placed = materialize(
        queries.mapInArrow(place_queries, "id long, v array<double>, part long, far double, least double"), "placed"
    )
    summary = {
        r["part"]: r
        for r in placed.groupBy("part")
        .agg(F.max("far").alias("far"), F.min("least").alias("least"), F.count(F.lit(1)).alias("n"))
        .collect()  # one row a pivot
    }
    parts = np.array(sorted(summary))
    chunks = {p: math.ceil(summary[p]["n"] / query_block) for p in parts.tolist()}

    sent_pivots = spark.sparkContext.broadcast(pivots)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = sent_pivots.value
        far = np.full(len(pivots), -1.0)
        for batch in batches:
            at, d = nearest(matrix(batch.column("v"), width), pivots)
            np.maximum.at(far, at, d)
        used = np.flatnonzero(far >= 0)
        yield pa.RecordBatch.from_pydict({"part": used, "far": far[used]})

    radius = np.full(len(pivots), -np.inf)
    for r in rows.mapInArrow(summarise, "part long, far double").groupBy("part").agg(F.max("far").alias("far")).collect():
        radius[r["part"]] = r["far"]  # one row a pivot

    p = query_pivots[parts]
    s = np.array([summary[i]["far"] for i in parts.tolist()])
    least = np.array([summary[i]["least"] for i in parts.tolist()])
    size = lambda m: np.sqrt((m * m).sum(axis=1))
    group_bound = (
        p @ pivots.T
        + size(p)[:, None] * radius[None, :]
        + s[:, None] * size(pivots)[None, :]
        + s[:, None] * radius[None, :]
    )
    # Rounding in the bounds must not lose a row.
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(group_bound), group_bound, 0)).max()) + 1e-3
    meets = group_bound + slack >= least[:, None]
    plan = spark.sparkContext.broadcast((parts, p, s, least, meets, chunks, slack))
    salts = max(1, math.ceil(n / data_block))

    def deal_data(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, p, s, least, meets, chunks, slack = plan.value
        seen = 0
        for batch in batches:
            x = matrix(batch.column("v"), width)
            at, _ = nearest(x, sent_pivots.value)
            norm = np.sqrt((x * x).sum(axis=1))
            salt = (seen + np.arange(len(x))) % salts
            seen += len(x)
            for i, part in enumerate(parts.tolist()):
                some = np.flatnonzero(meets[i, at])
                some = some[x[some] @ p[i] + s[i] * norm[some] + slack >= least[i]]
                if len(some):
                    taken = batch.take(pa.array(some))
                    for c in range(chunks[part]):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "part": np.full(len(some), part),
                                "chunk": np.full(len(some), c),
                                "salt": salt[some],
                                "id": taken.column("id"),
                                "v": taken.column("v"),
                            }
                        )

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = plan.value[5]
        for batch in batches:
            part = batch.column("part").to_numpy()
            ids = batch.column("id").to_numpy()
            chunk = np.array([hash_of(i) % chunks[g] for i, g in zip(ids.tolist(), part.tolist(), strict=True)])
            for salt in range(salts):
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": part,
                        "chunk": chunk,
                        "salt": np.full(len(part), salt),
                        "id": batch.column("id"),
                        "v": batch.column("v"),
                    }
                )

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        found: list[pd.DataFrame] = []
        if queries.num_rows and data.num_rows:
            data_ids = data.column("id").to_numpy()
            x = matrix(data.column("v").combine_chunks(), width)
            query_ids = queries.column("id").to_numpy()
            q = matrix(queries.column("v").combine_chunks(), width)
            for a in range(0, len(q), 128):
                for own, row in zip(query_ids[a : a + 128], scores(q[a : a + 128], x), strict=True):
                    other = np.flatnonzero(data_ids != own)
                    at = other[best(data_ids[other], row[other], k)]
                    found.append(pd.DataFrame({"query_id": own, "vec_id": data_ids[at], "score": row[at]}))
        if not found:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        return pa.Table.from_pandas(pd.concat(found, ignore_index=True), preserve_index=False)

    block = "part long, chunk long, salt long, id long, v array<double>"
    key = ("part", "chunk", "salt")
    local = (
        placed.select("id", "v", "part")
        .mapInArrow(deal_queries, block)
        .groupBy(*key)
        .cogroup(rows.mapInArrow(deal_data, block).groupBy(*key))
        .applyInArrow(solve, "query_id long, vec_id long, score long")
    )
    # Of every task at most k rows a query are left; they merge k by k.
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


def hash_of(value: int) -> int:
    """Deals ids that follow a rule evenly."""
    return (value * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 33
