"""Counts of a fixed number of things over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tillwise.llm.arrow import bounded, give_back, pieces

#: Counters that travel as one row, and partial counts that are added up in one step.
IN_A_ROW, ADDED_AT_ONCE = 1 << 14, 256


def tally(df: DataFrame, size: int, add_to: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """``size`` counters, to which ``add_to`` adds each batch of ``df``.

    Every task counts for itself; its counters are added up by ranges of 16,384
    and in two steps, so that no task adds up the rows of more than a 256th of
    all tasks.  Only the sums reach the driver.
    """
    rows = -(-size // IN_A_ROW)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(rows * IN_A_ROW, dtype=np.int64)
        for whole in batches:
            for batch in pieces(whole):
                add_to(counts[:size], batch)
        parts = counts.reshape(-1, IN_A_ROW)
        used = np.flatnonzero(parts.any(axis=1))
        if len(used):
            task = np.full(len(used), TaskContext.get().partitionId() % ADDED_AT_ONCE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(task, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())],
                names=["part", "task", "counts"],
            )
        give_back()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(IN_A_ROW, dtype=np.int64)
        for counts in table.column("counts"):
            total += np.frombuffer(counts.as_py(), dtype=np.int64)
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    once = bounded(df).mapInArrow(count, "part int, task int, counts binary")
    once = once.groupBy("part", "task").applyInArrow(add, "part int, counts binary")
    out = np.zeros((rows, IN_A_ROW), dtype=np.int64)
    for row in once.groupBy("part").applyInArrow(add, "part int, counts binary").collect():  # size / 16,384 rows
        out[row["part"]] = np.frombuffer(row["counts"], dtype=np.int64)
    return out.ravel()[:size]
