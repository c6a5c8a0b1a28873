"""Sums of vectors over the rows of a table: one vector a task, added in the order of the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "part int, sums binary"


def _row(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])


def total_of(rows: DataFrame, one: Callable[[pa.RecordBatch], np.ndarray], size: int, adders: int = 0) -> np.ndarray:
    """The sum of ``one`` over all Arrow batches, ``size`` doubles; ``adders``: tasks that add first, where there are many.

    The order of addition is that of the tasks, so that a task that runs again changes nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += one(batch)
        yield _row(TaskContext.get().partitionId(), total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sorted((p, s) for b in batches for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if parts:
            yield _row(parts[0][0], np.sum([np.frombuffer(s) for _, s in parts], 0))

    parts = rows.mapInArrow(run, _SCHEMA)
    if adders:
        parts = parts.repartitionById(adders, F.col("part") % adders).mapInArrow(add, _SCHEMA)
    total = np.zeros(size)
    for row in sorted(parts.collect(), key=lambda r: r["part"]):
        total += np.frombuffer(row["sums"])
    return total
