"""Joins with a table that may be small, and keys of whole rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.scratch import materialize, plan_bytes

#: Written tables up to this size go to every worker; larger ones are shuffled.
SMALL = 8 << 20
KEYS = ["_k1", "_k2"]


def checked(table: DataFrame, label: str = "side") -> DataFrame:
    """``table`` written, and marked for broadcast if the files are small."""
    table = materialize(table, label)
    return F.broadcast(table) if plan_bytes(table) <= SMALL else table


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column has it in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[str]]:
    """``df`` with the two halves of its row keys, and the names they have there."""
    names = unused(df.columns, *KEYS)
    return df.withColumns(dict(zip(names, row_keys(doc_id, text).values(), strict=True))), names


def row_keys(doc_id: str = "doc_id", text: str = "text") -> dict[str, Column]:
    """128 bits of id and text, never null: rows with and without an id can be matched by them."""
    parts = [
        F.coalesce(F.col(doc_id).cast("string"), F.lit("-")),
        F.col(text).isNull(),
        F.coalesce(F.col(text), F.lit("")),
    ]
    return {"_k1": F.xxhash64(*parts), "_k2": F.xxhash64(F.lit(1), *parts)}
