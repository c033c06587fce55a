"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask such as ``11010111`` takes the words at its ones and ignores the others,
so a replaced word does not hide a passage from all masks.  Hashes of the
masked words of every position of every text meet those of the benchmark
items.  What a hit leaves is short: the row, the item and the diagonal, the
distance of the place in the text from the place in the item.  Every diagonal
is then verified once: text and item are compared word by word, and windows of
``WINDOW`` words of the item (all of a shorter one) with a share ``LEAST`` of
equal words make the text contaminated.

``MASKS`` reaches every such window, whichever of its words are replaced: two
masks of six words for windows of 13, masks of fewer words for items of 5 to 12
words, of which up to two may be replaced, and shorter items as a whole.  Only
the masks of lengths that occur among the items are worked out.

Runs of one word give the same hits over and over.  Places so deep inside a run
of the text that all a hit there compares is that word are left out: the
nearest place that stays gives the same windows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.joins import checked, keyed
from tillwise.scratch import materialize

WINDOW = 13
LEAST = 0.8
#: Masks by the numbers of words of the items they serve; ``WINDOW`` stands for that many or more.
MASKS: dict[str, tuple[int, ...]] = {
    "1": (1,),
    "11": (2,),
    "111": (3,),
    "1111": tuple(range(4, 13)),
    "10111": (5, 10, 11, 12),
    "11011": (5, 6, 7, 8, 9),
    "11101": (5,),
    "11010111": (13,),
    "11110011": (13,),
}
#: Seeds of the items up to this number (about 24 bytes each) go to every worker; more are joined by a shuffle.
MOST_SEEDS = 2_000_000
#: Columns that a row of ``overlaps`` has beside those of the document.
FOUND = ("item_id", "diagonal", "first_word", "last_word", "share")


def words(text: Column) -> Column:
    """Runs of letters and digits, lower case; null counts as empty."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(of: Column, position: Column, length: Column, masks: list[str]) -> Column:
    """The masked hashes at a position; null where a mask passes the end."""
    out = []
    for mask in masks:
        taken = [F.get(of, position + k) for k, c in enumerate(mask) if c == "1"]
        out.append(F.when(position + len(mask) <= length, F.xxhash64(F.lit(mask), *taken)))
    return F.array(*out)


def seeded(rows: DataFrame, of: str, masks: list[str], where: Column | None = None) -> DataFrame:
    """One row for each position and mask: ``position``, ``number`` of the mask and ``seed``."""
    # The outer form keeps Spark from adding a filter that computes the words once more.
    places = rows.select("*", F.posexplode_outer(of).alias("position", "_h"))
    if where is not None:
        places = places.where(where)
    kept = [c for c in rows.columns if c != of]
    each = places.select(
        *kept, "position", F.posexplode(seeds(F.col(of), F.col("position"), F.size(of), masks)).alias("number", "seed")
    )
    return each.where(F.col("seed").isNotNull())


def _outside_runs(of: str, masks: list[str]) -> Column:
    """Whether the words that a hit at ``position`` can compare are not all the same.

    Nearly every place ends at the comparison with its neighbour.  All of it is
    compiled, so that the exploded places go on to their seeds without a copy
    of the words for each.
    """
    at, after = F.col("position"), WINDOW + max(map(len, masks), default=0)
    word = F.get(of, at)
    inside = (F.get(of, at + 1) == word) & (at >= WINDOW) & (at + after < F.size(of))
    length = WINDOW + 1 + after
    return ~F.coalesce(inside & (F.slice(of, at - WINDOW + 1, length) == F.array_repeat(word, length)), F.lit(False))


def _windows(text: Column, item: Column, diagonal: Column, first: Column, last: Column) -> Column:
    """(start, share) of the windows of an item, from ``first`` to ``last``, that are equal enough."""
    span = F.least(F.lit(WINDOW), F.size(item))
    places = F.sequence(F.lit(0), F.size(item) - 1)
    equal = F.transform(
        places, lambda i: F.coalesce((F.get(item, i) == F.when(diagonal + i >= 0, F.get(text, diagonal + i))).cast("int"), F.lit(0))
    )
    starts = F.sequence(F.greatest(F.lit(0), first - span + 1), F.least(last, F.size(item) - span))

    def rated(equal: Column) -> Column:
        return F.transform(
            starts,
            lambda s: F.struct(s.alias("start"), (F.aggregate(F.slice(equal, s + 1, span), F.lit(0), lambda n, e: n + e) / span).alias("share")),
        )

    # The array of equal places is a variable here, so that it is worked out once.
    all_ = F.flatten(F.transform(F.array(equal), rated))
    return F.filter(all_, lambda w: w["share"] >= LEAST)


def _found(
    rows: DataFrame, keys: list[str], text: str, benchmark: DataFrame, item_id: str, item_text: str,
    masks: Mapping[str, tuple[int, ...]], most_seeds: int,
) -> DataFrame:
    """The row keys ``keys`` and the columns ``FOUND`` of every verified diagonal of ``rows``."""
    items = materialize(
        benchmark.select(F.col(item_id).alias("item"), hashes(F.col(item_text)).alias("item_words"))
        .distinct()
        .where(F.size("item_words") > 0)
        .withColumn("item_key", F.xxhash64("item", "item_words")),
        "items",
    )
    length = F.least(F.size("item_words"), F.lit(WINDOW))
    present = {r[0] for r in items.select(length).distinct().collect()}  # at most WINDOW numbers
    used = [m for m, lengths in masks.items() if present.intersection(lengths)]
    serves = F.array(*[F.array(*map(F.lit, masks[m])) for m in used]) if used else F.array(F.array(F.lit(0)))
    table = seeded(items.select("item_key", length.alias("length"), "item_words"), "item_words", used)
    table = materialize(
        table.where(F.array_contains(F.get(serves, F.col("number")), F.col("length"))).select(
            "item_key", F.col("position").alias("at"), "seed"
        ),
        "seeds",
    )
    if table.count() <= most_seeds:
        table = F.broadcast(table)
    hashed = rows.select(*[F.col(k).alias(f"key{n}") for n, k in enumerate(keys)], hashes(F.col(text)).alias("words"))
    each = seeded(hashed, "words", used, _outside_runs("words", used)).drop("number")
    hits = (
        each.join(table, "seed")
        .groupBy("key0", "key1", "item_key", (F.col("position") - F.col("at")).alias("diagonal"))
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
    )
    hits = checked(hits, "hits")
    items = F.broadcast(items) if items.count() * WINDOW <= most_seeds else items
    distinct = hits.select("key0", "key1").distinct()
    compared = hashed.join(checked(distinct, "texts"), ["key0", "key1"], "left_semi").dropDuplicates(["key0", "key1"])
    windows = _windows(F.col("words"), F.col("item_words"), F.col("diagonal"), F.col("first"), F.col("last"))
    verified = compared.join(hits, ["key0", "key1"]).join(items, "item_key").select(
        "key0", "key1", "item", "diagonal", F.size("words").alias("n"), F.least(F.lit(WINDOW), F.size("item_words")).alias("span"),
        windows.alias("windows"),
    )
    last = F.array_max(F.transform("windows", lambda w: w["start"])) + F.col("span") - 1
    return verified.where(F.size("windows") > 0).select(
        *[F.col(f"key{n}").alias(k) for n, k in enumerate(keys)],
        F.col("item").alias("item_id"),
        F.col("diagonal").cast("bigint").alias("diagonal"),
        F.greatest(F.lit(0), F.col("diagonal") + F.array_min(F.transform("windows", lambda w: w["start"]))).cast("bigint").alias("first_word"),
        F.least(F.col("n") - 1, F.col("diagonal") + last).cast("bigint").alias("last_word"),
        F.array_max(F.transform("windows", lambda w: w["share"])).alias("share"),
    )


def overlaps(
    documents: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    masks: Mapping[str, tuple[int, ...]] = MASKS,
    most_seeds: int = MOST_SEEDS,
) -> DataFrame:
    """Rows of ``documents`` (without the text) with an item they verifiedly overlap.

    Further columns: ``item_id``, the ``diagonal`` (place in the text less
    place in the item), the ``first_word`` and ``last_word`` of the text that
    lie in an equal enough window, and the best ``share`` of equal words.
    Columns of the documents with one of these names are left out.  Items
    without a word overlap nothing; null texts are empty; repeated items count
    once and repeated rows each.
    """
    rows, keys = keyed(documents, doc_id, text)
    found = _found(rows, keys, text, benchmark, item_id, item_text, masks, most_seeds)
    kept = [f"`{c}`" for c in documents.columns if c != text and c.lower() not in FOUND]
    return rows.select(*kept, *keys).join(checked(found, "found"), keys).select(*kept, *FOUND)


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that overlap: where the overlap begins and ends, and the best share."""
    return (
        overlaps(documents.select("doc_id", "text"), benchmark)
        .groupBy("doc_id", "item_id")
        .agg(
            F.min("first_word").alias("first_word"),
            F.max("last_word").alias("last_word"),
            F.max("share").alias("share"),
        )
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that overlap an item; all their columns.

    Rows go by id and text, so of rows that share an id only those with a
    contaminated text go, and rows without an id are cleaned too.
    """
    rows, keys = keyed(documents)
    found = _found(rows, keys, "text", benchmark, "item_id", "text", MASKS, MOST_SEEDS)
    bad = checked(found.select(*keys).distinct())
    return rows.join(bad, keys, "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
