"""Mini-batch training against one process that sees the same batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import training

CENTRES = np.random.default_rng(5).standard_normal((4, 6)) * 1.6


def clouds(n):
    draws = np.random.default_rng(n)
    rows = []
    for i in range(n):
        k = int(draws.integers(0, 4))
        rows.append((i, (CENTRES[k] + draws.standard_normal(6)).tolist(), 10 * k - 5))
    return rows


def one_process(spark, rows, hidden, epochs, batch, rate, seed, decay=1e-4):
    """The same steps on arrays, gradients by automatic rules written out for one hidden layer."""
    keys = spark.createDataFrame([(r[0],) for r in rows], "key long").select("key", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(5)).alias("fold"))
    n_train = keys.where("fold <> 0").count()
    shards = math.ceil(n_train / batch) * training.SPREAD
    dealt = {r.key: (r.fold, r.shard) for r in keys.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(shards))).collect()}
    classes = sorted({r[2] for r in rows})
    x, y = np.array([r[1] for r in rows]), np.array([classes.index(r[2]) for r in rows])
    fold, shard = np.array([dealt[r[0]] for r in rows]).T
    draws = np.random.default_rng(seed)
    sizes = [(x.shape[1], hidden), (hidden, len(classes))]
    w = []
    for a, b in sizes:
        w += [draws.standard_normal(a * b).reshape(a, b) * math.sqrt(2 / a), np.zeros(b)]
    m, v, t, history = [0 * p for p in w], [0 * p for p in w], 0, []
    forward = lambda z: (h := np.maximum(z @ w[0] + w[1], 0), h @ w[2] + w[3])
    for epoch in range(epochs):
        lr, loss, seen = rate * (1 + math.cos(math.pi * epoch / epochs)) / 2, 0.0, 0
        order = np.random.default_rng([seed, epoch]).permutation(shards).tolist()
        for k in range(0, shards, training.SPREAD):
            some = (fold != 0) & np.isin(shard, order[k : k + training.SPREAD])
            if not some.any():
                continue
            h, z = forward(x[some])
            p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
            loss += -np.log(p[np.arange(some.sum()), y[some]]).sum()
            seen += some.sum()
            d = (p - np.eye(len(classes))[y[some]]) / some.sum()
            back = (d @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate([x[some].T @ back, back.sum(0), h.T @ d, d.sum(0)]):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] * (1 - lr * decay) - lr * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        held = fold == 0
        history.append((epoch + 1, lr, loss / seen, 100.0 * (forward(x[held])[1].argmax(1) == y[held]).mean()))
    return history


def test_history_equals_one_process(spark):
    rows = clouds(300)
    df = spark.createDataFrame(rows, "vec_id long, features array<float>, label int").repartition(3)
    got = training.train(df, key="vec_id", hidden=(8,), epochs=4, batch=64, rate=0.01, seed=3)
    want = one_process(spark, [(i, np.float32(x).astype(float).tolist(), y) for i, x, y in rows], 8, 4, 64, 0.01, 3)
    assert np.allclose(np.array(got.history), np.array(want), rtol=1e-9, atol=1e-9)
    assert got.history[-1][2] < got.history[0][2] and got.classes == [-5, 5, 15, 25]


@pytest.mark.parametrize("values", [1_000, 100])  # some blocks of steps; a block for each step, summed where its rows are
def test_blocks_change_nothing(spark, monkeypatch, values):
    rows = clouds(300)
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, label int").repartition(3)
    monkeypatch.setattr(training, "BLOCK", values)
    got = training.train(df, key="vec_id", hidden=(8,), epochs=2, batch=64, rate=0.01, seed=3)
    assert np.allclose(np.array(got.history), np.array(one_process(spark, rows, 8, 2, 64, 0.01, 3)), rtol=1e-9, atol=1e-9)


def test_jobs_grow_with_blocks_not_with_steps(spark):
    rows = clouds(300)
    df = spark.createDataFrame(rows, "vec_id long, features array<double>, label int")
    spark.sparkContext.setJobGroup("training", "training")
    try:
        got = training.train(df, key="vec_id", hidden=(4,), epochs=2, batch=4, rate=0.01, seed=3)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("training")) < 30  # 61 steps an epoch
    assert np.allclose(np.array(got.history), np.array(one_process(spark, rows, 4, 2, 4, 0.01, 3)), rtol=1e-9, atol=1e-9)


def test_gradient_equals_differences():
    net = training.Perceptron([3, 5, 4, 2])
    draws = np.random.default_rng(1)
    w, x, y = net.drawn(2) + 0.05, draws.standard_normal((7, 3)), draws.integers(0, 2, 7)
    got = net.losses(w, x, y)
    step = 1e-6 * np.eye(net.size)
    want = [(net.losses(w + s, x, y, False)[0] - net.losses(w - s, x, y, False)[0]) / 2e-6 for s in step]
    assert np.allclose(got[3:], want, atol=1e-5) and got[2] == 7


def test_learns_and_is_saved_and_predicts(spark, tmp_path):
    rows = clouds(400)
    odd = [(-1, None, 5), (-2, [1.0] * 5, 5), (-3, [float("nan")] * 6, 5), (-4, [0.0] * 6, None), (-5, [None] * 6, 5)]
    df = spark.createDataFrame(rows + odd, "vec_id long, features array<double>, label int")
    got = training.train(df, key="vec_id", hidden=(16,), epochs=6, batch=64, rate=0.02)
    assert max(h[3] for h in got.history) > 85
    training.save(df, got, str(tmp_path / "best"))
    back = training.load(spark, str(tmp_path / "best"))
    told = {r.vec_id: r for r in training.predicted(df.where("vec_id >= 0"), back, key="vec_id").collect()}
    assert np.mean([told[i].prediction == y for i, _, y in rows]) > 0.85
    held = {r.vec_id for r in df.where("vec_id >= 0").where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(5)) == 0).collect()}
    best = 100.0 * np.mean([told[i].prediction == y for i, _, y in rows if i in held])
    assert best == pytest.approx(max(h[3] for h in got.history))
    assert [r.epoch for r in training.history_of(df, got).orderBy("epoch").collect()] == [1, 2, 3, 4, 5, 6]


def test_without_rows_there_is_no_epoch(spark):
    got = training.train(spark.createDataFrame([], "vec_id long, features array<double>, label int"), key="vec_id")
    assert got.history == [] and training.history_of(spark.range(1), got).count() == 0
