"""Appending computed columns to a table, one Arrow batch at a time."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Make = Callable[[], Callable[[pa.RecordBatch], Sequence[object]]]

#: Rows and bytes of text that are worked on at once, so that what is made of long texts stays small.
PIECE_ROWS, PIECE_BYTES = 1_000, 1 << 20
#: Bytes of a batch that goes to a Python worker; a single row may be larger.
BATCH_BYTES = 2 << 20
#: Rows that the scan decodes at once: the texts of 4,096 rows, the default, make arrays of many MB each time.
READ_ROWS = 256


def bounded(df: DataFrame) -> DataFrame:
    """``df``, its session set to small batches: rows of text differ too much to count them in thousands."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    df.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return df


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the machine: workers live on after a task, and so would all that it once needed."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows; a single row is never cut."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = int(np.searchsorted(ends, before + PIECE_BYTES, side="right"))
        end = min(max(end, at + 1), at + PIECE_ROWS, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def with_columns(df: DataFrame, fields: Sequence[tuple[str, str]], make: Make) -> DataFrame:
    """``df`` with further columns, made by a function of the batch.

    ``make`` runs once in each task and returns the function that gives one
    list or array per field.  Columns of ``df`` with the name of a field, in
    any case, are replaced.
    """
    names = [name for name, _ in fields]
    taken = {name.lower() for name in names}
    kept = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])
    added = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    out = T.StructType([*kept.schema.fields, *added.fields])
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in pieces(whole):
                made = [
                    values.cast(t) if isinstance(values, pa.Array) else pa.array(values, type=t)
                    for values, t in zip(work(batch), types, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])
        del work
        give_back()

    return bounded(kept).mapInArrow(run, out)


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]
