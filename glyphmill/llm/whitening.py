"""Embedding whitening: leading principal components of distinct vectors, found without a covariance matrix.

Entries become whole numbers, x = floor(scale * c). The components are eigenvectors of the covariance of the distinct x,
by block subspace iteration: each pass over the written vectors multiplies the centred rows with a block Q of orthonormal
columns and gives the sum of X'(XQ), a few numbers for each task, which are added in two steps. On the driver the block
joins the subspace that earlier passes have multiplied; Rayleigh-Ritz over it gives the leading pairs, whose residuals
need no pass, and the residuals' directions (by QR, orthogonal to the subspace) are the next block. Plain iteration, which
forgets earlier blocks, needs hundreds of passes where eigenvalues are close, as those of embeddings are; with a kept
subspace a few do. It ends when the residuals of all wanted pairs are below ``GOAL`` of the largest eigenvalue, when they
are below ``CERTAIN`` and no longer fall, or when the subspace is all of the space. At ``WIDTH`` columns the subspace
begins anew with its leading half.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped, and so are those of
another length than most of the rest (of equally frequent lengths the largest stays); each distinct x counts once,
repeated rows are kept in the result; directions with less than ``FLAT`` of the trace are no components, so a table of
one distinct vector, or an empty one, gives no rows; of equal eigenvalues any basis of their directions is taken; a
deviation beyond 63 bits is null; entries whose floor is beyond 63 bits are set to its bounds; a null id stays null;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import settle, written

COMPONENTS, SCALE = 4, 256
#: Columns of a block, and most columns of the subspace that is kept.
BLOCK, WIDTH = 16, 128
GOAL, CERTAIN, FLAT = 1e-14, 1e-9, 1e-12
#: Tasks that add the sums of all others, and numbers of a batch that are worked on at a time.
ADDERS, CELLS = 16, 1 << 20


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and all of them are finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector.cast("array<double>"), finite), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))))


def blocks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """The rows of whole numbers of a list column, some at a time, with their slices of the batch."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            step = max(1, CELLS // x.shape[1])
            for low in range(0, len(x), step):
                yield x[low : low + step], batch.slice(low, step)


def total_of(fit: DataFrame, one: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum of ``one`` over all blocks of rows: a row for each task, added by ``ADDERS`` tasks and then here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, kind)
        for x, _ in blocks(batches, 0):
            total += one(x)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((p, s) for batch in batches for p, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if rows:  # in the order of tasks, so that a repeated task gives the same sum
            total = np.zeros(size, kind)
            for _, s in rows:
                total += np.frombuffer(s, kind)
            yield pa.record_batch([pa.array([rows[0][0]], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    schema = "part int, sums binary"
    parts = fit.mapInArrow(run, schema).repartitionById(ADDERS, F.col("part") % ADDERS).mapInArrow(add, schema)
    total = np.zeros(size, kind)
    for row in sorted(parts.collect(), key=lambda r: r["part"]):  # at most ADDERS rows
        total += np.frombuffer(row["sums"], kind)
    return total


def directions(found: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what of the columns of ``found`` lies outside the basis."""
    size = np.linalg.norm(found, axis=0)
    out = found[:, size > 0] / size[size > 0]
    for _ in range(2):  # once more, against rounding
        out = out - basis @ (basis.T @ out)
        out, r = np.linalg.qr(out)
        out = out[:, np.abs(np.diag(r)) > 1e-10]
    return out


def leading(multiply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, block: int = BLOCK, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The largest eigenvalues with unit eigenvectors (columns) of a symmetric matrix that is only ever multiplied with.

    Returns them with the largest residual, as a share of the largest eigenvalue, and the number of multiplications.
    """
    width = max(width, 2 * block, 4 * wanted)
    draws = np.random.default_rng(7)
    new = np.linalg.qr(draws.standard_normal((dims, min(max(block, wanted), dims))))[0]
    basis, image = np.zeros((dims, 0)), np.zeros((dims, 0))
    best, falling, passes = np.inf, 0, 0
    while True:
        basis, image = np.hstack([basis, new]), np.hstack([image, multiply(new)])
        passes += 1
        ritz = basis.T @ image
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn, image @ turn
        some = min(max(block, wanted), len(values))
        residual = images[:, :some] - vectors[:, :some] * values[:some]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        worst = float(np.linalg.norm(residual[:, :wanted], axis=0).max() / scale)
        falling = 0 if worst < best / 2 else falling + 1
        best = min(best, worst)
        if worst <= GOAL or basis.shape[1] == dims or (worst <= CERTAIN and falling > 2):
            return values[:wanted], vectors[:, :wanted], worst, passes
        if basis.shape[1] + block > width and width < dims:
            basis, image = vectors[:, : width // 2], images[:, : width // 2]
        new = directions(np.hstack([residual, draws.standard_normal((dims, 2))]), basis)[:, : min(block + 2, dims - basis.shape[1])]


class Whitening:
    """Mean, components and their eigenvalues of distinct vectors of whole numbers."""

    def __init__(self, dims: int, n: int, total: list[int], components: np.ndarray, values: np.ndarray, trace: float, scale: int):
        self.dims, self.n, self.total, self.scale = dims, n, total, scale
        self.components, self.values, self.trace = components, values, trace
        self.identity_error = 0.0
        self.residual, self.passes = 0.0, 0

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, exact, and its n-th part as doubles."""
        most = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.total))
        kind = np.int64 if most < 1 << 62 else object
        exact = x.astype(kind) * self.n - np.array(self.total, kind)
        return exact, exact.astype(float) / self.n

    def deviation(self, exact: np.ndarray) -> list[int | None]:
        """The sum of squares of each row, exact; null beyond 63 bits."""
        most = max(abs(int(exact.min())), abs(int(exact.max())))
        if most * most * exact.shape[1] < 1 << 63:
            return (exact.astype(np.int64) ** 2).sum(1).tolist()
        return [s if s < 1 << 63 else None for s in (sum(v * v for v in map(int, row)) for row in exact.tolist())]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred @ self.components) / np.sqrt(self.values)


def fit(df: DataFrame, *, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> Whitening | None:
    """Learns from all distinct vectors; None where there is none."""
    good = df.where(usable(F.col(f"`{vector}`"))).select(whole(F.col(f"`{vector}`"), scale).alias("x"))
    sizes = good.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return None
    dims = sizes["size"]
    rows = written(good.where(F.size("x") == dims).distinct(), "distinct-vectors")  # equal ones meet after a partial step
    low = (1 << 32) - 1
    sums = total_of(rows, lambda x: np.concatenate([[len(x)], (x >> 32).sum(0), (x & low).sum(0)]), 1 + 2 * dims, "int64").tolist()
    n, total = sums[0], [(a << 32) + b for a, b in zip(sums[1 : dims + 1], sums[dims + 1 :], strict=True)]
    out = Whitening(dims, n, total, np.zeros((dims, 0)), np.zeros(0), 0.0, scale)
    trace = []

    def multiply(block: np.ndarray) -> np.ndarray:
        def one(x: np.ndarray) -> np.ndarray:
            centred = out.centred(x)[1]
            return np.concatenate([(centred.T @ (centred @ block)).ravel(), [np.einsum("ij,ij", centred, centred)]])

        got = total_of(rows, one, block.size + 1, "float64") / n
        trace.append(got[-1])
        return got[:-1].reshape(block.shape)

    values, vectors, out.residual, out.passes = leading(multiply, dims, min(components, dims))
    out.trace = float(trace[0])
    kept = values > FLAT * out.trace
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    out.values, out.components = values[kept], (vectors * signs)[:, kept]
    k = len(out.values)
    if k:
        def spread(x: np.ndarray) -> np.ndarray:
            w = out.whitened(out.centred(x)[1])
            return np.concatenate([w.sum(0), (w.T @ w).ravel()])

        got = total_of(rows, spread, k + k * k, "float64") / n
        out.identity_error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    return out


def apply(df: DataFrame, model: Whitening | None, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (key, component, n, deviation, whitened, explained, identity_error) of each usable row and component; no shuffle."""
    held = F.col(f"`{vector}`")
    rows = df.where(usable(held) & (F.size(held) == (model.dims if model else -1))).select(F.col(f"`{key}`"), whole(held, model.scale if model else 1).alias("x"))
    sent = df.sparkSession.sparkContext.broadcast(model)  # a few vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        m = sent.value
        k = len(m.values) if m else 0
        for x, piece in blocks(batches, 1) if k else ():
            exact, centred = m.centred(x)
            size = len(x) * k
            columns = [
                piece.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(size, m.n)),
                pa.array([d for d in m.deviation(exact) for _ in range(k)], pa.int64()),
                pa.array(m.whitened(centred).ravel()),
                pa.array(np.tile(m.values / m.trace, len(x))),
                pa.array(np.full(size, m.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema.fields[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Every usable row on the leading components of all distinct ones."""
    return apply(df, fit(df, vector=vector, components=components, scale=scale), key=key, vector=vector)
