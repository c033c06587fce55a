"""Hard negatives by inner product, from STR-packed R-trees.

The vectors are tiled: cut points of a bounded sample deal them into tiles,
a tile with too many rows is dealt over several trees, and every tree packs
its rows by sort-tile-recursion, coordinate by coordinate, into full leaves.
The minimum bounding box of a node gives an interval for every coordinate, and
with the anchor's coordinates one for its inner products.  A best-first queue
holds the nodes by their greatest product; it drops boxes that lie outside the
score window and ends at boxes strictly below the k-th best score.

Trees are rows of a written table.  Anchors meet them in passes of a bounded
size: a pass is sent to the workers and read against all trees, and a tree
leaves at most k rows per anchor and window, which are merged k by k.  The
sample and the tiles shape the boxes only, never the result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.arrow import bounded, give_back
from tillwise.llm.voronoi import EXACT, matrix, quantised, scores
from tillwise.scratch import materialize

#: Vectors the tiles are cut from, and rows of a tree, of a leaf, and nodes below a node.
SAMPLE = 4_096
TREE, LEAF, FAN = 16_384, 256, 8
#: Anchors of a chunk, and bytes of the anchors of a pass, which are broadcast.
CHUNK = 1_024
PASS_BYTES = 64 << 20

ROWS = "id long, label long, v array<double>"
TREES = "tree long, ids binary, labels binary, x binary"


def packed(x: np.ndarray, capacity: int, coordinate: int = 0) -> list[np.ndarray]:
    """Rows in tiles of ``capacity`` (the last of a slab may be smaller), by sort-tile-recursion.

    Of t tiles still to be made, with c coordinates left, the rows are sorted
    by the next one and cut into the c-th root of t slabs.
    """
    tiles = math.ceil(len(x) / capacity)
    left = x.shape[1] - coordinate
    if tiles <= 1 or left <= 0:
        return [np.arange(a, min(a + capacity, len(x))) for a in range(0, len(x), capacity)]
    order = np.argsort(x[:, coordinate], kind="stable")
    slabs = tiles if left == 1 else math.ceil(tiles ** (1 / left) - 1e-9)
    size = math.ceil(tiles / slabs) * capacity
    out = []
    for a in range(0, len(x), size):
        part = order[a : a + size]
        out += [part[inner] for inner in packed(x[part], capacity, coordinate + 1)]
    return out


def cuts(sample: np.ndarray, tiles: int, coordinate: int = 0):
    """Nested cut points (coordinate, points, parts) of the same recursion, for rows that are not at hand."""
    left = sample.shape[1] - coordinate
    if tiles <= 1 or left <= 0 or len(sample) < 2:
        return None
    slabs = min(len(sample), tiles if left == 1 else math.ceil(tiles ** (1 / left) - 1e-9))
    order = sample[np.argsort(sample[:, coordinate], kind="stable")]
    ends = [len(order) * i // slabs for i in range(slabs + 1)]
    points = order[ends[1:-1], coordinate]
    below = math.ceil(tiles / slabs)
    return coordinate, points, [cuts(order[a:b], below, coordinate + 1) for a, b in zip(ends, ends[1:], strict=False)]


def tile_of(x: np.ndarray, cut) -> np.ndarray:
    """Number of the tile of each row."""
    out = np.zeros(len(x), dtype=np.int64)
    at = 0

    def walk(rows: np.ndarray, node) -> None:
        nonlocal at
        if node is None:
            out[rows] = at
            at += 1
            return
        coordinate, points, parts = node
        part = np.searchsorted(points, x[rows, coordinate], side="right")
        for i, below in enumerate(parts):
            walk(rows[part == i], below)

    walk(np.arange(len(x)), cut)
    return out


class Tree:
    """Packed rows with the boxes of their nodes; level 0 are the leaves, the last level is the root."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        low, high, step = x, x, LEAF
        while True:
            at = np.arange(0, len(low), step)
            low, high, step = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), FAN
            self.boxes.append((low, high))
            if len(low) == 1:
                break

    def intervals(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each level the smallest and the greatest product of each anchor with a node."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        least = [up @ low.T + down @ high.T for low, high in self.boxes]
        most = [up @ high.T + down @ low.T for low, high in self.boxes]
        return least, most

    def leaves(self, least, most, low: float, high: float, kth: list[float]) -> Iterator[int]:
        """Leaves that can hold a score of the window not below ``kth[0]``, best first; kth may rise meanwhile."""
        top = len(self.boxes) - 1
        queue = [(-min(most[top][0], high), top, 0)]
        while queue:
            bound, level, node = heapq.heappop(queue)
            if -bound < kth[0]:
                return
            if level == 0:
                yield node
                continue
            upper, lower = most[level - 1], least[level - 1]
            for child in range(node * FAN, min(node * FAN + FAN, len(upper))):
                reach = min(upper[child], high)
                if reach >= low and lower[child] <= high and reach >= kth[0]:
                    heapq.heappush(queue, (-reach, level - 1, child))


class Search:
    """All questions of one anchor to one tree; the scores of a leaf are worked out once."""

    def __init__(self, tree: Tree, own: int, label: int, q: np.ndarray, least, most, exact: bool, same: bool) -> None:
        self.tree, self.own, self.label, self.q = tree, own, label, q
        self.least, self.most, self.exact, self.same = least, most, exact, same
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def scored(self, leaf: int) -> tuple[np.ndarray, np.ndarray]:
        """Negated scores, ascending, and ids of the rows of a leaf that are asked for."""
        if leaf not in self.known:
            part = slice(leaf * LEAF, (leaf + 1) * LEAF)
            x = self.tree.x[part]
            found = -(x @ self.q).astype(np.int64) if self.exact else -np.maximum(scores(self.q[None, :], x)[0], 1 - 2**63)
            ids, alike = self.tree.ids[part], self.tree.labels[part] == self.label
            at = np.flatnonzero((alike if self.same else ~alike) & (ids != self.own))
            at = at[np.lexsort((ids[at], found[at]))]
            self.known[leaf] = found[at], ids[at]
        return self.known[leaf]

    def first(self, k: int, low: int, high: int) -> list[tuple[int, int]]:
        """The k best (negated score, id) with low <= score <= high; ties to the smaller id."""
        best: list[tuple[int, int]] = []
        kth = [-math.inf]
        for leaf in self.tree.leaves(self.least, self.most, low, high, kth):
            found, ids = self.scored(leaf)
            a = int(np.searchsorted(found, -high))
            b = min(a + k, int(np.searchsorted(found, -low, side="right")))
            if a < b:
                best = sorted(best + list(zip(found[a:b].tolist(), ids[a:b].tolist(), strict=True)))[:k]
                if len(best) == k:
                    kth[0] = -best[-1][0]
        return best


WHOLE = (1 - 2**63, 2**63 - 1)


def tree_rows(rows: DataFrame, n: int, width: int) -> DataFrame:
    """Trees of all rows, one per row of the result."""
    spark = rows.sparkSession
    taken = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    sample = matrix(taken.column("v").combine_chunks(), width)
    spread = np.argsort(-sample.var(axis=0), kind="stable")
    layout = cuts(sample[:, spread], min(math.ceil(n / TREE), SAMPLE // 4))
    sent = spark.sparkContext.broadcast((spread, layout))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread, layout = sent.value
        for batch in batches:
            tile = tile_of(matrix(batch.column("v"), width)[:, spread], layout)
            yield pa.RecordBatch.from_arrays([pa.array(tile), *batch.columns], names=["tile", *batch.schema.names])

    tiled = materialize(bounded(rows).mapInArrow(deal, f"tile long, {ROWS}"), "tiled")
    # At most SAMPLE / 4 tiles; rows of a full one are dealt over as many trees as it fills.
    fan = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / TREE).alias("fan"))
    salt = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "fan")
    dealt = tiled.join(F.broadcast(fan), "tile").select(
        "tile", salt.alias("salt"), "id", "label", "v"
    )

    def pack(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        ids, labels = part.column("id").to_numpy(), part.column("label").to_numpy()
        x = matrix(part.column("v").combine_chunks(), width)
        # Rows come in any order; equal ones are told apart by nothing that matters.
        by = np.lexsort((labels, ids))
        by = by[np.concatenate(packed(x[by][:, sent.value[0]], LEAF))]
        return pa.table(
            {
                "tree": pa.array([(key[0].as_py() << 32) + key[1].as_py()], pa.int64()),
                "ids": pa.array([ids[by].tobytes()], pa.binary()),
                "labels": pa.array([labels[by].tobytes()], pa.binary()),
                "x": pa.array([np.ascontiguousarray(x[by]).tobytes()], pa.binary()),
            }
        )

    return materialize(dealt.groupBy("tile", "salt").applyInArrow(pack, TREES), "trees")


def ask(trees: DataFrame, anchors: DataFrame, n: int, width: int, k: int, same: bool) -> DataFrame:
    """(anchor, positive_score, id, score): for each anchor and window the k best of every tree.

    ``anchors`` has ``id``, ``label``, ``v`` and ``windows`` (structs of a
    positive score, least and greatest score), ``n`` of them.
    """
    chunks = max(1, math.ceil(n / CHUNK))
    item = F.struct("id", "label", "v", "windows")
    packs = anchors.groupBy(F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(item).alias("anchors"))
    packs = materialize(packs, "anchors")
    a_pass = max(1, PASS_BYTES // (CHUNK * (width + 16) * 8))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = (np.frombuffer(batch.column(c)[row].as_py(), dtype=np.int64) for c in ("ids", "labels"))
                x = np.frombuffer(batch.column("x")[row].as_py(), dtype=np.float64).reshape(len(ids), width)
                tree = Tree(ids, labels, x)
                each = batch.column("anchors")[row].values
                out: list[list[int]] = [[], [], [], []]
                q = matrix(each.field("v"), width)
                reach = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * width
                least, most = tree.intervals(q)
                # Bounds beyond whole doubles are widened by more than they can be off.
                slack = 0.0 if reach < EXACT else reach * 1e-9
                for i, (own, label, windows) in enumerate(
                    zip(each.field("id").to_pylist(), each.field("label").to_pylist(), each.field("windows").to_pylist(), strict=True)
                ):
                    search = Search(
                        tree, own, label, q[i], [b[i] - slack for b in least], [b[i] + slack for b in most], reach < EXACT, same
                    )
                    for w in windows:
                        for negated, other in search.first(k, w["low"], w["high"]):
                            for column, value in zip(out, (own, w["positive_score"], other, -negated), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["anchor", "positive_score", "id", "score"])
        give_back()

    found = []
    for first in range(0, chunks, a_pass):
        last = min(first + a_pass, chunks) - 1
        some = F.broadcast(packs.where(F.col("chunk").between(first, last)))
        places = trees.withColumn("chunk", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))))
        met = bounded(places.join(some, "chunk").select("ids", "labels", "x", "anchors"))
        found.append(met.mapInArrow(solve, "anchor long, positive_score long, id long, score long"))
    return reduce(DataFrame.unionAll, found)


def mine(
    vectors: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = 256,
) -> DataFrame:
    """Hard negatives of the rows whose id is divisible by ``every``.

    Components become floor(scale * x); the score of two rows is their integer
    inner product, held to the limits of a long, and ties go to the smaller
    id.  An anchor's positives are the best ``positives`` other rows of its
    label; for each, the best ``negatives`` rows of another label are given
    whose score lies between ``low`` and ``high`` percent of the positive's:
    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows without an id, a label or a vector, or with a null or non-finite
    component, take no part; shorter vectors are filled up with zeros.  An id
    that occurs several times is one anchor, with its smallest label and
    vector, and several candidates, though not for anchors of that id.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), quantised(F.col(vector), scale).alias("v")
    )
    rows = materialize(rows.where("id is not null and label is not null and v is not null"), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    own = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("of"))
    whole = F.array(F.struct(*[F.lit(v).cast("bigint").alias(c) for c, v in zip(("positive_score", "low", "high"), (0, *WHOLE), strict=True)]))
    anchors = materialize(own.select("id", "of.label", "of.v", whole.alias("windows")), "anchors")
    some = anchors.count()
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not some or not width:
        return spark.createDataFrame([], out)
    trees = tree_rows(rows, n, width)

    def ranked(found: DataFrame, k: int, *key: str) -> DataFrame:
        order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    alike = materialize(
        ranked(ask(trees, anchors, some, width, positives, True), positives, "anchor").select(
            "anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "positives",
    )
    # ceil(low * p / 100) and floor(high * p / 100) without leaving a long.
    p = F.col("positive_score")
    hundreds, rest = F.expr("positive_score div 100"), p % 100
    window = F.struct(
        p,
        (hundreds * low + F.ceil(rest * low / 100)).cast("bigint").alias("low"),
        (hundreds * high + F.floor(rest * high / 100)).cast("bigint").alias("high"),
    )
    windows = alike.select("anchor", window.alias("w")).where("w.low <= w.high")
    windows = windows.groupBy(F.col("anchor").alias("id")).agg(F.collect_set("w").alias("windows"))
    asking = materialize(anchors.drop("windows").join(windows, "id"), "asking")
    other = ranked(ask(trees, asking, some, width, negatives, False), negatives, "anchor", "positive_score")
    return alike.join(other, ["anchor", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
