"""Secret scans with corpus-wide ownership.

Candidates of a whole text are found by patterns; their values are hashed and
counted over distinct repositories and owners of the corpus.  A value that
several owners carry, or that one owner spreads over very many repositories, is
a widely copied example; a value of one or two owners in few repositories looks
live.  The base kinds are reported either way; ``token``, any other long
random-looking string, is reported only where it looks live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm.arrow import texts, with_columns
from tillwise.llm.joins import checked, keyed, unused
from tillwise.scratch import materialize

# Fixed values of the contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex")

TOKEN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
TOKEN_CHARS, TOKEN_BITS = 20, 3.5
#: A value of at least so many owners, or in so many repositories whoever owns them, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 25
#: Shorter runs without white space hold neither an access key, a hex string nor a token.
RUN = re.compile(r"[^\s]{20,}")


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, hash of the value), by start and kind; kind 3 is ``token``."""
    found: list[tuple[int, int, int, str]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):
        at, part = run.start(), run[0]
        if "AKIA" in part:
            found += [(at + m.start(), 1, at + m.end(), m[0]) for m in ACCESS.finditer(part) if len(m[0]) >= 20]
        found += [(at + m.start(), 2, at + m.end(), m[0]) for m in HEX.finditer(part) if m.end() - m.start() >= 24]
    base = sorted((a, b) for a, _, b, _ in found)
    for run in RUN.finditer(text):
        for m in TOKEN.finditer(run[0]):
            a, b, value = run.start() + m.start(), run.start() + m.end(), m[0]
            if (
                b - a >= TOKEN_CHARS
                and any(c.isdigit() for c in value)
                and any(c.islower() for c in value)
                and any(c.isupper() for c in value)
                and not any(x < b and a < y for x, y in base)
                and entropy(value) >= TOKEN_BITS
            ):
                found.append((a, 3, b, value))
    return [(a, k, b, xxhash.xxh64_intdigest(v.encode("utf-8", "replace")) - (1 << 63)) for a, k, b, v in sorted(found)]


def spans_text(spans) -> str:
    names = (*KINDS, "token")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


SPAN = "struct<start:bigint,kind:tinyint,stop:bigint,value:bigint>"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the candidate ``spans`` of every whole text; null counts as empty."""

    def make():
        def work(batch: pa.RecordBatch):
            return [
                [
                    [{"start": a, "kind": k, "stop": b, "value": v} for a, k, b, v in candidates(t)]
                    for t in texts(batch, text)
                ]
            ]

        return work

    return with_columns(docs, [("spans", f"array<{SPAN}>")], make)


def ownership(found: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """Distinct repositories and owners of each value; a null owner or repository is one of its own."""
    missing = F.lit("\0")
    each = found.select(
        "value",
        F.coalesce(owner.cast("string"), missing).alias("owner"),
        F.coalesce(repository.cast("string"), missing).alias("repository"),
    ).distinct()
    return (
        each.groupBy("value", "owner")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
        .withColumn("live", (F.col("owners") < EXAMPLE_OWNERS) & (F.col("repositories") < EXAMPLE_REPOSITORIES))
    )


def judged(docs: DataFrame, repository: str = "doc_id", owner: str = "source", text: str = "text", *more: str) -> DataFrame:
    """Columns ``more`` and all reported ``spans`` of each row, each with owners and ``live``.

    Spans are sorted by start and kind.  A row without spans has an empty list.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(repository).alias("_repository"),
        F.col(owner).alias("_owner"),
        F.col(text).alias("_text"),
        *[F.col(c).alias(c) for c in more],
    )
    scanned = materialize(scan(rows, "_text").drop("_text"), "scan")
    each = scanned.where(F.size("spans") > 0).select("_row", "_repository", "_owner", F.explode("spans").alias("s"))
    each = each.select("_row", "_repository", "_owner", "s.*")
    owned = materialize(ownership(each, F.col("_repository"), F.col("_owner")), "owners")
    spans = (
        each.join(owned, "value")
        .where((F.col("kind") < len(KINDS)) | F.col("live"))
        .groupBy("_row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "value", "owners", "live"))).alias("judged"))
    )
    empty = F.array().cast("array<struct<start:bigint,kind:tinyint,stop:bigint,value:bigint,owners:bigint,live:boolean>>")
    return (
        scanned.drop("spans")
        .join(checked(spans), "_row", "left")
        .select(*more, F.coalesce("judged", empty).alias("spans"))
    )


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the secrets of every document; a row for each row.

    A row without an id counts as a repository of its own kind.
    """

    def make():
        def work(batch: pa.RecordBatch):
            out: list[list[object]] = [[] for _ in range(7)]
            for spans in batch.column("found").to_pylist():
                all_ = [(s["start"], s["kind"], s["stop"]) for s in spans]
                base = [s for s in all_ if s[1] < len(KINDS)]
                for k in range(3):
                    out[k].append(sum(s[1] == k for s in base))
                out[3].append(hashlib.sha256(spans_text(base).encode()).hexdigest())
                out[4].append(spans_text(all_))
                out[5].append(sum(s["live"] for s in spans))
                out[6].append(spans_text([(s["start"], s["kind"], s["stop"]) for s in spans if s["live"]]))
            return out

        return work

    fields = [(f"n_{k}", "bigint") for k in KINDS]
    fields += [("base_sha256", "string"), ("spans", "string"), ("n_live", "bigint"), ("live_spans", "string")]
    rows = judged(docs, "doc_id", "source", "text", "doc_id").withColumnRenamed("spans", "found")
    return with_columns(rows, fields, make).drop("found")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking span of the text replaced; copied examples stay.

    Overlapping spans are replaced once.  Texts without a live span, null
    ones too, stay as they are.  Rows are matched to their spans by id and
    text, so repeated rows get the same text.
    """
    rows, keys = keyed(docs, "doc_id", text)
    spans, new = unused(rows.columns, "_live", "_new")
    live = F.filter("spans", lambda s: s["live"])
    found = judged(rows, "doc_id", "source", text, *keys).select(
        *keys, F.transform(live, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias(spans)
    )
    found = checked(found.where(F.size(spans) > 0).dropDuplicates(keys))
    joined = rows.join(found, keys, "left")

    def make():
        def work(batch: pa.RecordBatch):
            return [
                [t if not cut else without(t, cut, mark) for t, cut in zip(
                    batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True
                )]
            ]

        return work

    done = with_columns(joined, [(new, "string")], make)
    return done.select(*[F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def without(text: str, spans: list[dict[str, int]], mark: str) -> str:
    """The text with its spans, sorted by start, replaced."""
    out, at = [], 0
    for s in spans:
        if s["stop"] <= at:
            continue
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = s["stop"]
    return "".join([*out, text[at:]])
