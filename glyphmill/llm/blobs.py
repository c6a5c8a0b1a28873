"""Shuffles of packed numbers: each row is one piece of a batch for one target partition.

A row per number would cost more than the numbers; a piece holds the numbers of some hundred documents for one target,
as raw bytes. Pieces of a target are joined again on the other side, where numpy sorts and counts them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import mapped

#: Column layouts of pieces: name -> numpy type.
Layout = dict[str, str]


def schema_of(layouts: dict[str, Layout]) -> str:
    names = dict.fromkeys(n for layout in layouts.values() for n in layout)
    return "part int, kind string, " + ", ".join(f"{n} binary" for n in names)


def spread(hashes: np.ndarray, parts: int) -> np.ndarray:
    """An even target for each hash, from its low 32 bits."""
    return (((hashes.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def mix(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.uint64) if values.dtype != np.uint64 else values
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Packer:
    """Collects rows of pieces in the order of one schema."""

    def __init__(self, layouts: dict[str, Layout]):
        self.layouts = layouts
        self.names = list(dict.fromkeys(n for layout in layouts.values() for n in layout))
        self.rows: list[tuple] = []

    def add(self, kind: str, target: np.ndarray, columns: dict[str, np.ndarray]) -> None:
        """Splits the columns by target."""
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        t = target[order]
        cuts = np.flatnonzero(np.diff(t)) + 1
        layout = self.layouts[kind]
        pieces = {n: np.split(np.ascontiguousarray(columns[n][order], layout[n]), cuts) for n in layout}
        for k, at in enumerate(np.concatenate([[0], cuts])):
            self.rows.append((int(t[at]), kind, *(pieces[n][k].tobytes() if n in layout else None for n in self.names)))

    def one(self, kind: str, target: int, columns: dict[str, bytes]) -> None:
        self.rows.append((target, kind, *(columns.get(n) for n in self.names)))

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[]] * (len(self.names) + 2)
        self.rows = []
        return pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.string()), *(pa.array(c, pa.binary()) for c in columns[2:])], ["part", "kind", *self.names])


def gathered(batches: Iterator[pa.RecordBatch], layouts: dict[str, Layout]) -> dict[str, dict[str, list[np.ndarray]]]:
    """All pieces of a partition, by kind and column."""
    out: dict[str, dict[str, list[np.ndarray]]] = {k: {n: [] for n in layout} for k, layout in layouts.items()}
    for batch in batches:
        kinds = batch.column("kind").to_pylist()
        for kind, layout in layouts.items():
            at = [i for i, k in enumerate(kinds) if k == kind]
            for n, t in layout.items():
                column = batch.column(n)
                out[kind][n].extend(np.frombuffer(column[i].as_buffer(), t) if t else column[i].as_py() for i in at)
    return out


def joined(pieces: list[np.ndarray], dtype: str) -> np.ndarray:
    return np.concatenate(pieces) if pieces else np.zeros(0, dtype)


def exchanged(df: DataFrame, parts: int, run: Callable, schema: str) -> DataFrame:
    """Sends the pieces to their targets and maps each target."""
    return mapped(df.repartitionById(parts, F.col("part")), run, schema)
