"""SimHash near-duplicates: fingerprints, BK-trees, components.

Distinct fingerprints are dealt into shards that agree on six of their eight
bytes: two fingerprints within two bits differ in two bytes at most, so every
link lies whole in one of the 28 shards of a fingerprint, and a shard has at
most 65,536 fingerprints whatever the corpus holds.  A shard is a BK-tree,
whose children are keyed by their integer Hamming distance to the parent, and
the shard's fingerprints follow only the edges within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tillwise.llm.arrow import texts, with_columns
from tillwise.llm.components import components
from tillwise.llm.joins import checked, keyed
from tillwise.scratch import materialize

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Bits set in more than half of the shingle hashes; 0 without a word."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(len(words) - shingle + 1, 1)
    last = ends[min(shingle, len(words)) - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, AT_ONCE):
        pairs = zip(starts[at : min(at + AT_ONCE, n)].tolist(), last[at : at + AT_ONCE].tolist(), strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in pairs], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the 64-bit fingerprint of every whole text as a long; null counts as empty."""

    def make():
        def work(batch: pa.RecordBatch):
            return [[signed(fingerprint(t, shingle)) for t in texts(batch, text)]]

        return work

    return with_columns(docs, [(out, "bigint")], make)


def in_hex(value: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


class BkTree:
    """A BK-tree over distinct fingerprints, in the order given."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        open_ = [np.arange(len(values))] if len(values) else []
        while open_:
            group = open_.pop()
            root, rest = group[0], group[1:]
            far = self.distance(rest, root)
            for d in np.unique(far):
                below = rest[far == d]
                self.children[root][int(d)] = int(below[0])
                open_.append(below)

    def distance(self, some: np.ndarray, node: int) -> np.ndarray:
        return np.bitwise_count(self.values[some] ^ self.values[node])

    def near(self, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For every node the other places within the radius of it; all queries walk the tree together."""
        open_ = [(0, np.arange(len(self.values)))] if len(self.values) else []
        while open_:
            node, queries = open_.pop()
            far = self.distance(queries, node).astype(np.int64)
            yield node, queries[(far <= radius) & (queries != node)]
            for d, child in self.children[node].items():
                follow = queries[np.abs(far - d) <= radius]
                if len(follow):
                    open_.append((child, follow))


def star(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links (value, smallest value) that connect what a shard connects."""
    order = np.sort(values)
    up = list(range(len(order)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for node, found in BkTree(order.view(np.uint64)).near(radius):
        for other in found.tolist():
            a, b = root(node), root(other)
            if a != b:
                up[max(a, b)] = min(a, b)
    for i in range(len(order)):
        if (r := root(i)) != i:
            yield int(order[i]), int(order[r])


def shards(distinct: DataFrame, radius: int = RADIUS, fingerprint: str = "fingerprint") -> DataFrame:
    """Shards of at least two fingerprints, for a radius of at most two bits."""
    if not 0 <= radius <= 2:
        raise ValueError("shards hold links of at most two bits")
    keys = []
    for n, (i, j) in enumerate(combinations(range(8), 2)):
        mask = (1 << 64) - 1 ^ 0xFF << 8 * i ^ 0xFF << 8 * j
        keys.append(
            F.struct(F.lit(n).cast("tinyint").alias("n"), F.col("f").bitwiseAND(F.lit(signed(mask))).alias("k"))
        )
    # Written fingerprints lie in few files; their copies are made in as many tasks as the session shuffles with.
    return (
        distinct.select(F.col(fingerprint).alias("f"))
        .repartition(shuffle_tasks(distinct), "f")
        .select("f", F.explode(F.array(*keys)).alias("shard"))
        .groupBy("shard.n", "shard.k")
        .agg(F.collect_list("f").alias("members"))
        .where(F.size("members") > 1)
        .select("members")
    )


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def links(distinct: DataFrame, radius: int = RADIUS, fingerprint: str = "fingerprint") -> DataFrame:
    """Links (a, b) that connect every two fingerprints within the radius, directly or through others."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                pair
                for members in batch.column("members")
                for pair in star(members.values.to_numpy(zero_copy_only=False), radius)
            ]
            if found:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]})

    return shards(distinct, radius, fingerprint).mapInArrow(solve, "a long, b long").distinct()


def groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    more: Sequence[str] = (),
) -> DataFrame:
    """``doc_id``, columns ``more``, ``fingerprint``, ``root`` (longs) and ``component_id`` of every row.

    ``root`` is the smallest fingerprint of a component.  Texts without a
    word, null ones too, have the fingerprint zero and are linked like any
    other.  A row without an id gets the component of its fingerprint; the id
    of a component is null if no member has one.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(c) for c in more], F.col(text).alias("_text"))
    prints = materialize(fingerprints(rows, "_text", "fingerprint", shingle).drop("_text"), "prints")
    distinct = materialize(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialize(components(links(distinct, radius)), "roots")
    member = distinct.join(roots, distinct["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    found = materialize(member.select("fingerprint", "root").join(least, "root"), "found")
    return prints.join(found, "fingerprint").select("doc_id", *more, "fingerprint", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of every component, that with the smallest id; all their columns.

    Rows without an id stay only where no member has one; of rows with equal
    id and text one stays.
    """
    rows, keys = keyed(docs)
    found = materialize(groups(rows, "doc_id", "text", shingle, radius, keys), "groups")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", *keys)
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    first = materialize(first.select("root", *[F.col(f"first.{k}").alias(f"{k}_") for k in keys]), "first")
    same = (F.col(keys[0]) == F.col(f"{keys[0]}_")) & (F.col(keys[1]) == F.col(f"{keys[1]}_"))
    others = checked(found.join(first, "root").where(~same).select(*keys).distinct())
    kept = rows.join(others, keys, "left_anti")
    repeated = materialize(found.groupBy(*keys).count().where("count > 1").select(*keys), "repeated")
    if not repeated.isEmpty():
        repeated = checked(repeated)
        once = kept.join(repeated, keys, "left_semi").dropDuplicates(keys)
        kept = kept.join(repeated, keys, "left_anti").unionByName(once)
    return kept.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of every document, by three-word shingles and two bits."""
    return groups(docs).select("doc_id", in_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
