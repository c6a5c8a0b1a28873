"""The compression classifier: evidence by hand, calibration, defined cases and held-out accuracy."""

import os
import zlib

import numpy as np
import pytest
import zstandard

from glyphmill.llm import quality, queries

SF = "/root/testdata/sf0.01"
WORDS = "the of and to in is that for was as with be by at from his her they which or had not are but".split()


def good(i):
    rng = np.random.default_rng(i)
    return " ".join(WORDS[k] + str(rng.integers(0, 9)) for k in rng.integers(0, len(WORDS), 150)) + "."


def bad(i):
    rng = np.random.default_rng(10_000 + i)
    return "!! ".join(WORDS[k].upper() for k in rng.integers(0, len(WORDS), 150))


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def rows():
    return [(i, good(i) if i % 3 else bad(i), "x", 0.5) for i in range(600)]


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")


def test_evidence_is_the_difference_over_all_blocks():
    first, second = b"abcabcabd" * 40, b"xyzzyxzyx" * 40
    both = quality.Compressors((first, second))
    sizes = lambda known, body: sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(known), write_content_size=False, write_checksum=False, write_dict_id=False).compress(body[k : k + 1024])) for k in range(0, len(body), 1024))
    body = b"xyzzy abc " * 500 + b"tail"
    assert both.evidence([body, b"", b"q"]).tolist() == [(sizes(first, body) - sizes(second, body)) / len(body), 0.0, sizes(first, b"q") - sizes(second, b"q")]


def test_held_out_texts_are_told_apart_and_labels_of_fold_0_are_not_read(spark, rows):
    labels = [(i, int(i % 3 != 0) if fold(i) else int(i % 3 == 0)) for i, *_ in rows]  # those of fold 0 are wrong
    more = [(None, None, None, None), (9_001, "", "y", 1.0), (9_002, None, "y", 1.0), (1, rows[1][1], "again", 0.0), (9_003, good(7) + " " + "long " * 60_000, "x", 0.0)]
    got = quality.quality(*frames(spark, rows + more, labels + labels[:50] + [(77_777, 1), (5, None), (None, 1)])).collect()
    assert len(got) == len(rows) + len(more)
    assert all(r.predicted == int(r.doc_id % 3 != 0) for r in got if r.doc_id is not None and r.doc_id < 9_000)
    assert all(r.held_out == (fold("" if r.doc_id is None else r.doc_id) == 0) and 0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (None, 9_001, 9_002)}
    assert len(empty) == 1 and 0.5 < empty.pop() < 0.8


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(i, 1) for i in range(20)], 1.0), ([(i, 0) for i in range(20)], 0.0)])
def test_without_both_labels_the_score_is_the_share(spark, rows, labels, want):
    got = quality.quality(*frames(spark, rows[:30], labels)).collect()
    assert {r.score for r in got} == {want}


def test_few_labelled_texts_and_an_empty_table(spark, rows):
    docs, labels = frames(spark, rows[:40], [(i, int(i % 3 != 0)) for i in range(40)])
    assert quality.quality(docs, labels).count() == 40
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_train_rows_and_blocks_bound_what_is_read(spark, rows):
    docs, labels = frames(spark, rows, [(i, int(i % 3 != 0)) for i, *_ in rows])
    model = quality.learn(docs, labels, train_rows=200, train_blocks=30)
    assert model.knots is not None
    texts = docs.selectExpr("doc_id", "text", "cast(doc_id % 3 <> 0 as int) as label")
    got = quality._chosen_blocks(texts, 30)
    assert all(10 < len(b) < 60 for b in got.values())


def test_calibration_rises_and_ends_short_of_certainty_without_enough_texts():
    rng = np.random.default_rng(1)
    evidence = rng.standard_normal(400)
    labels = (rng.random(400) < 1 / (1 + np.exp(-2 * evidence))).astype(float)
    at, share = quality.calibration(evidence, labels)
    assert (np.diff(at) > 0).all() and (np.diff(share) > 0).all()
    order = np.argsort(evidence)
    assert share[0] >= 0 and abs(np.interp(evidence, at, share).mean() - labels.mean()) < 0.02 and share[0] <= labels[order[:20]].mean() + 1e-12


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    got = queries.op11_quality(spark, SF).where("held_out")
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", "predicted", "quality").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
