"""Whitening against a dense eigendecomposition of the distinct vectors."""

import math

import numpy as np
import pytest

from glyphmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n double"


def brute(rows, k=4, scale=256):
    """(id, component): (n, deviation, |whitened|, explained)."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in good]
    dims = max(set(lengths), key=lambda s: (lengths.count(s), s))
    good = [(i, [math.floor(float(np.float32(c)) * scale) for c in v]) for i, v in good if len(v) == dims]
    x = np.array(sorted({tuple(v) for _, v in good}), np.int64)
    n, total = len(x), x.sum(0)
    centred = x - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in good:
        exact = n * np.array(v) - total
        for c in range(k):
            out.append((i, c + 1, n, sum(int(e) ** 2 for e in exact), abs(float((exact / n) @ vectors[:, c]) / values[c] ** 0.5), values[c] / values.sum()))
    return out


def clouds(seed, n, dims):
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((n, dims)) * np.linspace(1, 0.3, dims)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(n)]
    rows += [(n + i, x[0].tolist()) for i in range(n // 2)]  # one vector in a third of all rows
    rows += [(-1, None), (-2, []), (-3, [None] * dims), (-4, [float("nan")] * dims), (-5, x[1].tolist()[:-1] + [float("inf")]), (-6, [1.0] * (dims - 1)), (None, x[2].tolist()), (3, x[3].tolist()), (3, x[3].tolist())]
    return rows


@pytest.mark.parametrize(("n", "dims"), [(150, 6), (300, 40)])
def test_equals_a_dense_decomposition(spark, n, dims):
    rows = clouds(dims, n, dims)
    got = whitening.whiten(spark.createDataFrame([(i, v, "c", 0.5) for i, v in rows], SCHEMA).repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], r[4])
    got, want = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key), sorted(brute(rows), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-10, atol=1e-11)


def test_whitened_covariance_is_the_identity(spark):
    model = whitening.fit(spark.createDataFrame([(i, v, "c", 0.5) for i, v in clouds(3, 200, 12)], SCHEMA))
    assert model.identity_error < 1e-12 and model.residual < 1e-13 and model.n == 200


def test_subspaces_begin_anew_and_close_eigenvalues_are_told_apart():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((900, 300)) * np.linspace(1.2, 1, 300)
    covariance = x.T @ x / len(x)
    values, vectors = np.linalg.eigh(covariance)
    got, found, residual, passes = whitening.leading(lambda q: covariance @ q, 300, 4, block=8, width=40)
    assert residual < 1e-9 and passes > 5
    assert np.allclose(got, values[::-1][:4], rtol=1e-12)
    assert np.allclose(np.abs((found * vectors[:, ::-1][:, :4]).sum(0)), 1)


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, None)]])
def test_without_variance_there_are_no_components(spark, rows):
    assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_flat_directions_are_no_components(spark):
    rows = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1} and len(got) == 9 and abs(got[0].explained - 1) < 1e-12


def test_sums_stay_exact_beyond_63_bits(spark):
    rows = [(i, [2.0**40 * (i + 1), -1.0 * i]) for i in range(4)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == dict.fromkeys(range(4))  # n * x - S is near 2 ** 50, its square is not a long
    small = [(i, [2.0**18 * (i + 1), -1.0 * i]) for i in range(4)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(small, "vec_id long, embedding array<double>")).collect()}
    x = [(256 * 2**18 * (i + 1), -256 * i) for i in range(4)]
    assert got == {i: sum((4 * x[i][d] - sum(v[d] for v in x)) ** 2 for d in (0, 1)) for i in range(4)}
