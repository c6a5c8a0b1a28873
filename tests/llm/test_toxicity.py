"""Toxicity: boosting and the learned lexicon against plain versions, and odd tables."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from glyphmill.llm import toxicity


def plain_boosting(x, y, model):
    """Trees by trying every cut of every feature in every node, one after the other."""
    raw = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        cuts.append(np.unique(np.quantile(values, np.linspace(0, 1, model.bins + 1)[1:-1])) if len(values) > 1 else np.array([0.0]))
    for _ in range(model.trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        leaves = [np.arange(len(y))]
        for _ in range(model.depth):
            below = []
            for rows in leaves:
                best, side = 1e-6, np.zeros(len(rows), bool)
                for j in range(x.shape[1]):
                    for cut in cuts[j]:
                        right = x[rows, j] > cut
                        if min(right.sum(), (~right).sum()) < model.least:
                            continue
                        value = lambda some: grad[some].sum() ** 2 / (hess[some].sum() + model.ridge)
                        gain = value(rows[right]) + value(rows[~right]) - value(rows)
                        if gain > best + 1e-9:
                            best, side = gain, right
                below += [rows[~side], rows[side]]
            leaves = below
        for rows in leaves:
            raw[rows] += model.rate * grad[rows].sum() / (hess[rows].sum() + model.ridge)
    return raw


@pytest.mark.parametrize("seed", [0, 1])
def test_boosting_equals_a_plain_version(seed):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.random(160), rng.integers(0, 4, 160), np.zeros(160)])
    y = (rng.random(160) < 1 / (1 + np.exp(-4 * (x[:, 0] - 0.5) - x[:, 1] + 1.5))).astype(np.int64)
    model = toxicity.Boosted(trees=5, depth=2, bins=8, least=10).fit(x, y)
    assert np.allclose(model.raw(x), plain_boosting(x, y, model))


def test_the_learned_lexicon_equals_a_plain_count(spark):
    rng = np.random.default_rng(2)
    words = [f"word{k}" for k in range(30)]
    rows = [(" ".join(rng.choice(words, 12)) + (" Grobelix, grobelix! grobnix" if k % 4 == 0 else " quiet") , int(k % 4 == 0)) for k in range(200)] + [(None, 1), ("", 0)]
    got = toxicity.learned_lexicon(spark.createDataFrame(rows, "text string, label int").repartition(3))
    sizes, counts = Counter(), {0: Counter(), 1: Counter()}
    for text, label in rows:
        sizes[label] += 1
        counts[label].update({k for w in {t.strip(toxicity._EDGE).lower() for t in (text or "").split()} if w for k in toxicity.keys(w)})
    least = max(toxicity.LEAST_COUNT, toxicity.LEAST_SHARE * sizes[1])
    ratio = {k: math.log((n + 0.5) / sizes[1]) - math.log((counts[0][k] + 0.5) / sizes[0]) for k, n in counts[1].items() if n >= least}
    want = {k: v for k, v in ratio.items() if v >= toxicity.LEAST_RATIO}
    assert got == pytest.approx(want) and "grobelix" in got and "grob*" in got


@pytest.fixture(scope="module")
def labelled():
    rows = [(i, f"plain text number {i} about things" if i % 4 else f"you are an idiot and a loser number {i}") for i in range(400)]
    return rows, [(i, int(i % 4 == 0)) for i, _ in rows]


def test_odd_tables(spark, labelled):
    rows, labels = labelled
    more = [(None, None), (900, ""), (901, None), (902, "calm words " * 40_000), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, 1.0, "x", 2) for i, t in rows + more], "doc_id long, text string, score double, label string, predicted int").repartition(3)
    got = toxicity.toxicity(docs, spark.createDataFrame([*labels, *labels[:9], (None, 1), (3, None)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) + len(more)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 900)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (None, 900, 901)}) == 1 and len({r.score for r in got if r.doc_id == 0}) == 1
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_the_driver_gets_one_row_of_each_labelled_document(spark, labelled, monkeypatch):
    rows, labels = labelled
    docs = spark.createDataFrame(rows + [rows[7], rows[8]] * 1500, "doc_id long, text string").repartition(4)
    seen = []
    kind = type(docs)
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (seen.append(len(out := real(self))), out)[1])
    toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), train_rows=150)
    assert seen and max(seen) < 2_000 and all(n <= 250 for n in seen[-1:])
