"""Set similarity join of word shingles, as a grouped prefix join.

Every document is the set of its distinct shingles.  The shingles of all sets
have one common order, in which frequent ones come last, and two sets whose
Jaccard similarity reaches the threshold share a shingle in their prefixes, a
tenth of each set at 90 percent.  Documents with equal sets are one member;
members with the same prefix and the same size are collapsed into one group.
Groups that share a prefix shingle are joined and filtered by size, by the
places of the shingle and by counts of their shingles in a few bins, and only
what is left is expanded to members and verified on the whole sets.

Whole sets are never shuffled for all documents: a set is made again from the
text of its first document where some pair of groups needs it.  Groups
that may be similar are connected to candidate components, small ones share a
unit of work, and a large one is cut into homes of a bounded size, every two of
which are a unit.  So near copies meet in few units, and neither a list nor a
unit leaves more than a row for each of its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrow import bounded, give_back, pieces
from tillwise.llm.components import components
from tillwise.llm.joins import KEYS, checked, row_keys
from tillwise.llm.tallies import tally
from tillwise.llm.words import BLANKS, letters, words
from tillwise.scratch import materialize, temporary

SHINGLE = 3
PERCENT = 90
#: Counters of the shingle frequencies, and bins of the short and of the longest profile of a set.
COUNTERS, BINS, MOST_BINS = 1 << 22, 64, 1 << 16
#: Groups of a block of a long list, and pairs of groups that are compared at once.
BLOCK, PAIRS = 1_024, 200_000
#: Bytes of the sets of a home; a set counts as at least the second number.
HOME_BYTES, LEAST_BYTES = 8 << 20, 1 << 10

TABLE = letters(BLANKS)

# Odd multipliers and the steps of a 64-bit finaliser (fixed values).
WORD_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
FINAL = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; of all its words, where they are fewer than ``width``."""
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, some), np.uint64, len(some)) for some in words(text, TABLE)]
    if not parts:
        return np.empty(0, dtype=np.uint64)
    h = np.concatenate(parts)
    taken = min(width, len(h))
    out = np.full(len(h) - taken + 1, taken, dtype=np.uint64)
    for k in range(taken):
        out = out * np.uint64(WORD_FACTORS[k % 5] + 2 * (k // 5)) + h[k : k + len(out)]
    for factor in FINAL:
        out ^= out >> np.uint64(33)
        out *= np.uint64(factor)
    return np.unique(out ^ (out >> np.uint64(33)))


def prefix_length(n: int, percent: int) -> int:
    """Of sets of which one has ``n`` elements and that are similar enough, both prefixes share an element."""
    return n - -(-percent * n // 100) + 1


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    return [shingles(t or b"", width) for t in batch.column("_text").cast(pa.binary()).to_pylist()]


def counter_of(hashes: np.ndarray) -> np.ndarray:
    """The counter of a shingle, by its leading bits."""
    return (hashes >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64)


def frequencies(texts: DataFrame, width: int = SHINGLE) -> np.ndarray:
    """Number of rows by the counter of a shingle, over the column ``_text`` of all rows."""

    def add(counts: np.ndarray, batch: pa.RecordBatch) -> None:
        if sets := _sets(batch, width):
            np.add.at(counts, counter_of(np.concatenate(sets)), 1)

    # A task sends all its counters on, so short tasks are put together.
    parts = texts.rdd.getNumPartitions()
    return tally(texts.coalesce(max(texts.sparkSession.sparkContext.defaultParallelism, parts // 8)), COUNTERS, add)


def classes(counts: np.ndarray) -> np.ndarray:
    """Place of each counter in the common order: 0 unless clearly above the mean, then by half powers of two."""
    floor = max(64.0, 3 * counts.mean())
    return np.where(counts <= floor, 0, 2 * np.log2(np.maximum(counts, 1))).astype(np.uint8)


def profile(hashes: np.ndarray) -> np.ndarray:
    """How many shingles of a set fall into each bin, 255 standing for that many or more; about eight to a bin."""
    n = len(hashes)
    bins = BINS if n <= 8 * BINS else min(MOST_BINS, 1 << (n // 8 - 1).bit_length())
    return np.minimum(np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8)


def folded(profile: np.ndarray, bins: int) -> np.ndarray:
    """The counts in fewer bins; where one is not known, it is beyond any set."""
    counts = np.where(profile == 255, 1 << 40, profile.astype(np.int64))
    return counts.reshape(-1, bins).sum(axis=0)


def short(profile: np.ndarray) -> np.ndarray:
    """The profile in ``BINS`` bins, again with 255 at most."""
    return np.minimum(folded(profile, BINS), 255).astype(np.uint8)


def described(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Every row of docs (doc_id, _text, row keys) with its set in short instead of the text.

    ``n`` is the size, ``key`` the set in 128 bits, ``prefix`` its first
    shingles in the common order, ``profile`` and ``short`` its counts by bin.
    """
    order = docs.sparkSession.sparkContext.broadcast(classes(frequencies(docs.select("_text"), width)))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                sets = _sets(batch, width)
                prefixes = [
                    s[np.lexsort((s, order.value[counter_of(s)]))[: prefix_length(len(s), percent)]].view(np.int64) if len(s) else s.view(np.int64)
                    for s in sets
                ]
                profiles = [profile(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in ("doc_id", *KEYS)],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                        pa.array([f.tobytes() for f in profiles], pa.binary()),
                        pa.array([short(f).tobytes() for f in profiles], pa.binary()),
                    ],
                    names=["doc_id", *KEYS, "n", "key", "prefix", "profile", "short"],
                )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, _k1 long, _k2 long, n long, key binary, prefix array<long>, profile binary, short binary"
    return bounded(docs).mapInArrow(describe, out)


def candidates(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of groups that connect every two groups which may hold similar sets.

    ``sets`` has ``gid``, ``n``, ``prefix`` and ``short``.  The groups that
    share a shingle are one list, a row; a long list is cut into blocks, of
    which every two meet in a list of their own.  A list compares its groups
    and leaves one link for each that has a partner, not one for each pair.
    """
    groups = sets.groupBy("n", "prefix").agg(
        F.min("gid").alias("gid"), F.when(F.count(F.lit(1)) == 1, F.min("short")).alias("short")
    )
    rows = groups.select("gid", "n", "short", F.posexplode("prefix").alias("place", "token"))
    rows = materialize(rows, "prefixes")
    shared = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    blocks = F.ceil(F.col("df") / BLOCK).cast("bigint")
    rows = rows.join(shared, "token").withColumn("blocks", F.when(F.col("df") <= 2 * BLOCK, F.lit(1).cast("bigint")).otherwise(blocks))
    own = F.pmod(F.xxhash64("gid"), "blocks")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    rows = rows.select("token", "gid", "n", "place", "short", own.alias("own"), other)
    met = rows.groupBy("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    lists = met.agg(F.collect_list(F.struct("gid", "n", "place", "short")).alias("groups")).where(F.size("groups") > 1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _connected(batch.column("groups"), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        give_back()

    return bounded(lists.select("groups")).mapInArrow(compare, "a long, b long").distinct()


def _connected(lists: pa.ListArray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the groups of each list that connect what may be similar.

    A pair passes that is linked at the first shingle both prefixes share,
    where nothing before it is common: then the rest of the smaller tail
    bounds the intersection.
    """
    entries = lists.flatten()
    gid, n, place = (entries.field(c).to_numpy().astype(np.int64) for c in ("gid", "n", "place"))
    # A group of several sets has no profile, which leaves room for anything.
    open_ = b"\xff" * BINS
    profile = np.frombuffer(b"".join([p or open_ for p in entries.field("short").to_pylist()]), dtype=np.uint8).reshape(-1, BINS)
    size = lists.value_lengths().to_numpy()
    start = np.cumsum(size) - size
    label = np.arange(len(gid))
    # Every group with those behind it in its list, as many groups at once as make PAIRS pairs.
    behind = np.repeat(start + size, size) - np.arange(len(gid)) - 1
    upto = np.cumsum(behind)
    at = 0
    while at < len(gid):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        i = np.repeat(np.arange(at, end), behind[at:end])
        j = _ranges(np.arange(at, end) + 1, behind[at:end])
        at = end
        rest = np.minimum(n[i] - place[i], n[j] - place[j])
        both = n[i] + n[j]
        good = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((100 + percent) * rest >= percent * both)
        i, j = i[good], j[good]
        good = _roomy(profile[i], profile[j], both[good], percent)
        _join(label, i[good], j[good])
    linked = np.flatnonzero(label != np.arange(len(gid)))
    return gid[linked], gid[label[linked]]


def _roomy(a: np.ndarray, b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether the profiles leave room for the intersection that sizes adding up to ``both`` need."""
    least = np.minimum(a, b)
    return (least == 255).any(axis=1) | ((100 + percent) * least.sum(axis=1, dtype=np.int64) >= percent * both)


def _join(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give all places that pairs (i, j) connect the smallest label among them."""
    while len(i):
        least = np.minimum(label[i], label[j])
        if (least == label[i]).all() and (least == label[j]).all():
            return
        for side in (i, j):
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        label[:] = label[label]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def verify(members: pa.Table, percent: int) -> pa.Table:
    """Links of a unit: for every member that has some, its ``near`` root among them and the ``links``, copies counted.

    Members of one ``root`` are compared, in a unit of two homes only those of
    different homes.
    """
    keys = members.column("key").to_pylist()
    # Rows with the same id and text come several times.
    at = sorted({(k, h): i for i, (k, h) in reversed(list(enumerate(zip(keys, members.column("home").to_pylist(), strict=True))))}.values())
    members = members.take(pa.array(at, pa.int64()))
    members = members.take(pa.array(np.lexsort((members.column("n").to_numpy(), members.column("root").to_numpy()))))
    keys = members.column("key").to_pylist()
    root, home, copies, size = (members.column(c).to_numpy() for c in ("root", "home", "copies", "n"))
    hashes = np.frombuffer(b"".join(members.column("tokens").to_pylist()), dtype=np.uint64)
    start = np.cumsum(size) - size
    profiles = np.array([short(profile(hashes[s : s + n])) for s, n in zip(start, size, strict=True)]).reshape(-1, BINS)
    tokens = np.unique(hashes, return_inverse=True)[1]
    marked = np.zeros(int(tokens.max(initial=-1)) + 1, dtype=bool)
    two_homes = len(members) > 0 and members.column("i")[0].as_py() != members.column("j")[0].as_py()
    links = np.zeros(len(keys), dtype=np.int64)
    label = np.arange(len(keys))
    ends = np.searchsorted(root, root, side="right")
    for a in range(len(keys)):
        # Of those behind it the sizes rise, so that the similar ones are a run.
        end = a + 1 + int(np.searchsorted(size[a + 1 : ends[a]], 100 * size[a] // percent, side="right"))
        near = np.arange(a + 1, end)
        if two_homes:
            near = near[home[near] != home[a]]
        near = near[_roomy(profiles[near], profiles[a], size[near] + size[a], percent)]
        if not len(near):
            continue
        mine = tokens[start[a] : start[a] + size[a]]
        marked[mine] = True
        both = np.add.reduceat(marked[tokens[_ranges(start[near], size[near])]], np.cumsum(size[near]) - size[near], dtype=np.int64)
        marked[mine] = False
        linked = near[(100 + percent) * both >= percent * (size[near] + size[a])]
        links[a] += copies[linked].sum()
        links[linked] += copies[a]
        _join(label, np.full(len(linked), a), linked)
    found = np.flatnonzero(links)
    return pa.table(
        {
            "key": pa.array([keys[i] for i in found], pa.binary()),
            "near": pa.array([keys[label[i]] for i in found], pa.binary()),
            "links": pa.array(links[found], pa.int64()),
        }
    )


def with_tokens(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` (row keys, other columns) with the whole set of each row as ``tokens``, made from its text again."""
    names = [c for c in wanted.columns if c not in KEYS]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                tokens = pa.array([s.tobytes() for s in _sets(batch, width)], pa.binary())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], tokens], names=[*names, "tokens"])
        give_back()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields if f.name in names)
    return bounded(docs.join(wanted, KEYS).select("_text", *names)).mapInArrow(make, f"{kinds}, tokens binary")


def refine(members: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between the groups of one root that the whole profiles leave room for."""
    members = members.take(pa.array(np.argsort(members.column("n").to_numpy(), kind="stable")))
    gid, home, size = (members.column(c).to_numpy() for c in ("gid", "home", "n"))
    profiles = [np.frombuffer(f, dtype=np.uint8) for f in members.column("profile").to_pylist()]
    shorts = np.array([short(f) for f in profiles]).reshape(-1, BINS)
    two_homes = len(gid) > 0 and members.column("i")[0].as_py() != members.column("j")[0].as_py()
    label = np.arange(len(gid))
    for a in range(len(gid)):
        near = np.arange(a + 1, a + 1 + int(np.searchsorted(size[a + 1 :], 100 * size[a] // percent, side="right")))
        near = near[(gid[near] != gid[a]) & (label[near] != label[a])]
        if two_homes:
            near = near[home[near] != home[a]]
        near = near[_roomy(shorts[near], shorts[a], size[near] + size[a], percent)]
        for b in near.tolist():
            bins = min(len(profiles[a]), len(profiles[b]))
            least = np.minimum(folded(profiles[a], bins), folded(profiles[b], bins)).sum() if bins > BINS else size[a]
            if (100 + percent) * least >= percent * (size[a] + size[b]):
                _join(label, np.array([a]), np.array([b]))
    linked = np.flatnonzero(label != np.arange(len(gid)))
    return pa.table({"a": pa.array(gid[linked]), "b": pa.array(gid[label[linked]])})


def _in_homes(wanted: DataFrame, bytes_: Column) -> DataFrame:
    """``wanted`` with a ``fan``, the homes that its root needs, and a ``home`` by its key."""
    full = wanted.groupBy("root").agg(F.ceil(F.sum(F.greatest(F.lit(LEAST_BYTES), bytes_)) / HOME_BYTES).alias("fan"))
    fan = F.coalesce("fan", F.lit(1).cast("bigint"))
    joined = wanted.join(checked(full.where("fan > 1"), "full"), "root", "left")
    return joined.select(*wanted.columns, fan.alias("fan"), F.pmod(F.xxhash64("key"), fan).alias("home"))


def _in_units(placed: DataFrame, units: int) -> DataFrame:
    """Rows by ``unit``, ``i`` and ``j``: small roots share units, and every two homes of a large one are a unit."""
    alone = F.col("fan") > 1
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("fan") - 1)).alias("other")
    return placed.select("*", other).select(
        F.when(alone, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(units))).alias("unit"),
        F.when(alone, F.least("home", "other")).otherwise(-1).alias("i"),
        F.when(alone, F.greatest("home", "other")).otherwise(-1).alias("j"),
        *[c for c in placed.columns if c != "fan"],
    )


def _places(edges: DataFrame, several: DataFrame) -> DataFrame:
    """(gid, root): the candidate component of each group that is linked, or that holds several sets itself."""
    roots = materialize(components(edges).withColumnRenamed("node", "gid"), "roots")
    return materialize(roots.unionByName(several.join(roots.select("gid"), "gid", "left_anti")), "places")


def _wanted(sets: DataFrame, percent: int) -> DataFrame:
    """Sets that may be similar to others, by the ``root`` of their candidate component.

    Long sets fill the few bins of a short profile too evenly, so that they all
    look alike; the large components that come of it are taken apart by the
    whole profiles.
    """
    several = sets.groupBy("gid").count().where("count > 1").select("gid", F.col("gid").alias("root"))
    places = _places(materialize(candidates(sets, percent), "candidates"), several)
    wanted = materialize(sets.join(places, "gid").select("root", "gid", "key", "n", "copies", "profile", *KEYS), "wanted")
    sums = wanted.groupBy("root").agg(F.sum(F.greatest(F.lit(LEAST_BYTES), F.col("n") * 8)).alias("bytes"))
    large = checked(sums.where(F.col("bytes") > HOME_BYTES).select("root"), "large")
    if large.isEmpty():
        return wanted.drop("profile", "gid")
    of_large = wanted.join(large, "root", "left_semi")
    placed = _in_homes(of_large.select("root", "gid", "key", "n", "profile"), F.octet_length("profile"))

    def solve(members: pa.Table) -> pa.Table:
        return refine(members, percent)

    # Roots are compared each for itself here.
    units = _in_units(placed.drop("key"), 1).groupBy("root", "unit", "i", "j").applyInArrow(solve, "a long, b long")
    own = several.join(of_large.select("gid").distinct(), "gid", "left_semi")
    parts = _places(materialize(units.distinct(), "refined"), own)
    taken = of_large.drop("root").join(parts, "gid").select(*wanted.columns)
    return wanted.join(large, "root", "left_anti").unionByName(taken).drop("profile", "gid")


def links(docs: DataFrame, sets: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, near, links): for sets that are linked with others, a set they are connected to, and their links in a unit."""
    wanted = materialize(_wanted(sets, percent), "wanted")
    total = wanted.agg(F.sum(F.greatest(F.lit(LEAST_BYTES), F.col("n") * 8))).first()[0] or 0
    placed = checked(_in_homes(wanted, F.col("n") * 8), "homes")
    tokens = materialize(with_tokens(docs, placed, width), "tokens")

    def solve(members: pa.Table) -> pa.Table:
        return verify(members, percent)

    dealt = _in_units(tokens, max(1, math.ceil(total / HOME_BYTES)))
    return dealt.groupBy("unit", "i", "j").applyInArrow(solve, "key binary, near binary, links long")


def similar(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Of every row: ``doc_id``, ``n_shingles``, ``component_id`` and ``n_links``, the number of rows it is linked with.

    Words are runs without ASCII white space, A-Z lower-cased; with fewer than
    ``width`` words the whole sequence is the only shingle.  Rows without a
    word, null texts too, are linked with nothing and are components of their
    own.  Rows link when ``100 * intersection >= percent * union``; rows with
    equal sets, repeated rows too, always do.  ``component_id`` is the
    smallest id of all rows that links reach, null ids left aside: null where
    no row has one.  Shingles are compared by 64-bit hashes.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), *_keys(doc_id, text))
    found = materialize(described(rows, width, percent), "described")
    sets = materialize(
        found.where("n > 0")
        .groupBy("key", "n", "prefix")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min("doc_id").alias("least"),
            F.min("profile").alias("profile"),
            F.min("short").alias("short"),
            F.min(F.struct(*KEYS)).alias("at"),
        )
        .select("key", "n", "prefix", "profile", "short", "copies", "least", "at.*", F.xxhash64("n", "prefix").alias("gid")),
        "sets",
    )
    with temporary(docs.sparkSession) as keep:
        linked = keep(links(rows, sets, width, percent), "linked")
    roots = components(linked.select(F.col("key").alias("a"), F.col("near").alias("b")))
    roots = materialize(roots.withColumnRenamed("node", "key"), "roots")
    degree = linked.groupBy("key").agg(F.sum("links").alias("links"))
    member = roots.join(sets.select("key", "least"), "key")
    least = member.groupBy("root").agg(F.min("least").alias("least"))
    joined = roots.join(least, "root").join(degree, "key").select("key", "least", "links", F.lit(True).alias("other"))
    copied = sets.where("copies > 1").select("key", F.col("least").alias("own"), "copies")
    lookup = copied.join(joined, "key", "full").select(
        "key",
        F.when(F.col("other"), F.col("least")).otherwise(F.col("own")).alias("_least"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("_links"),
        F.lit(True).alias("_found"),
    )
    return found.join(checked(lookup, "lookup"), "key", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("_found"), F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("_links", F.lit(0).cast("bigint")).alias("n_links"),
    )


def _keys(doc_id: str, text: str) -> list[Column]:
    return [c.alias(name) for name, c in row_keys(doc_id, text).items()]
