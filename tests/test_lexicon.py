"""The lexicon search against a comparison with all entries, and readings that lack something."""

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import constants as C
from glyphmill.functions.chars import HYPOTHESES
from glyphmill.operators import decode, evaluate, lexicon, modes

LATTICE = pa.list_(pa.list_(pa.struct([("ch", pa.string()), ("p", pa.float64())])))


def brute(lattice, names, length, mismatch):
    """Best entry and score, by the rule."""
    near = {(a, b): s for a, b, s in C.affinity_rows()}
    best = None
    for name in sorted(set(names)):
        score = 0.0
        for k in range(length):
            cell = lattice[k] if k < len(lattice) else []
            chance = next((c["p"] for c in cell if c["ch"] == name[k]), None)
            score += np.log(max(chance, C.LEAST_PROBABILITY)) if chance is not None else near.get((cell[0]["ch"], name[k]), mismatch) if cell else mismatch
        if best is None or round(score, 6) > best[1]:
            best = (name, round(score, 6))
    return best


def random_lattices(seed, n, length, alphabet):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        out.append([[{"ch": str(rng.choice(list(alphabet))), "p": float(rng.choice([0.0, 0.3, 0.55, 0.9, 0.99]))} for _ in range(rng.integers(1, 5))] for _ in range(rng.integers(1, length + 1))])
    return out


@pytest.mark.parametrize(("group", "letters", "cells"), [("pin", "0123456789", 1 << 21), ("pin", "0123", 40), ("code3", "ABHMOQDPZ", 1 << 21), ("code2", "ABCOQ19", 7)])
def test_search_equals_a_comparison_with_all(monkeypatch, group, letters, cells):
    monkeypatch.setattr(lexicon, "CELLS", cells)  # few: batches are split
    length, alphabet, mismatch = lexicon.SHAPES[group]
    rng = np.random.default_rng(length)
    names = ["".join(rng.choice(list(letters), length)) for _ in range(400)] + ["é" * length, "é" + "A" * (length - 1), "è" * length]
    lattices = random_lattices(3, 150, length, letters)
    cut = lexicon.Lattices.read(pa.array(lattices, LATTICE), length, alphabet, mismatch)
    trie = lexicon.Trie.build(names, [None] * len(names), length, alphabet)
    best, score, touched = trie.search(cut.costs, np.full(len(lattices), -np.inf))
    assert [(trie.names[b], s) for b, s in zip(best, score, strict=True)] == [brute(x, names, length, mismatch) for x in lattices]
    assert (touched > 0).all()


def test_a_million_entries(monkeypatch):
    names = [f"{k:06d}" for k in range(1_000_000) if k % 37]
    trie = lexicon.Trie.build(names, [None] * len(names), 6, C.PIN_VOCABULARY)
    lattices = random_lattices(9, 60, 6, "0123456789")
    cut = lexicon.Lattices.read(pa.array(lattices, LATTICE), 6, C.PIN_VOCABULARY, C.PIN_MISMATCH)
    codes = np.array([list(map(int, n)) for n in names])
    best, score, touched = trie.search(cut.costs, np.full(60, -np.inf))
    for k in range(60):
        want = np.zeros(len(names))
        for place in range(6):
            want += cut.costs[k, place, codes[:, place]]
        want = np.round(want, 6)
        assert (trie.names[best[k]], score[k]) == (names[int(want.argmax())], want.max())
    assert np.median(touched) < 0.01 * len(names)


def test_parts_give_what_the_whole_gives(spark, monkeypatch):
    entries = [("pin", f"{k * 7919 % 900_000 + 100_000}", None) for k in range(500)] + [("pin", "12345", None), ("pin", None, None), ("code", "AB-1111", "AB"), ("code", "AB-2222", "AB"), ("code", "OQD-1", "OQD")]
    known = spark.createDataFrame(entries, "kind string, entry string, prefix string")
    rows = [(k, "pin" if k % 2 else "code", [(str((k * 31 + i) % 10) if k % 2 or i > 2 else "AQOB-Z"[(k + i) % 6], 0.9, []) for i in range(6 if k % 2 else 7 + k % 3)]) for k in range(120)]
    fields = spark.createDataFrame(rows, f"id int, field_type string, hyp {HYPOTHESES}")
    shown = lambda: sorted(map(str, decode.decode(fields, known).select("id", "text", "fsm_conf", "valid", "notes", "score").collect()))
    one = shown()
    assert len(lexicon.Finder(known).parts) == 1
    monkeypatch.setattr(lexicon, "MOST_ENTRIES", 150)
    assert len(lexicon.Finder(known).parts) > 3 and shown() == one


@pytest.mark.parametrize("empty", [True, False])
def test_odd_readings_are_kept_and_flagged(spark, empty):
    entries = [] if empty else [("pin", "123456", None), ("pin", "1234567", None), ("code", "AB-1111", "AB")]
    known = spark.createDataFrame(entries, "kind string, entry string, prefix string")
    read = lambda text: None if text is None else [(c, 0.9, None) for c in text]
    cases = list(itertools.product(["pin", "code", "date", "name", None], [None, "", "1", "A", "AB-", "AB-1", "123456", "AB-1234"]))
    fields = spark.createDataFrame([(i, k, read(t), t or "") for i, (k, t) in enumerate(cases)], f"id int, field_type string, hyp {HYPOTHESES}, ground_truth string")
    got = {cases[r.id]: r for r in decode.decode(fields, known).collect()}
    assert len(got) == len(cases)
    for (kind, text), r in got.items():
        if not text:
            assert r.text == "" and (r.valid == (kind not in ("pin", "code", "date"))) and r.score is None
        if kind in (None, "name"):
            assert (r.text, r.valid, r.fsm_conf) == (text or "", True, 0.9 if text else 0.0)
    assert not got["code", "A"].valid and got["code", "A"].fsm_conf == C.PIN_FAR and got["code", "AB-1"].valid
    assert got["pin", "123456"].valid and not got["pin", "1"].valid
    predictions = modes.read_fields(fields, known)
    assert {(r.mode, r.fields) for r in evaluate.leaderboard(predictions).collect()} == {(m, len(cases)) for m in C.MODES}
    short = predictions.where((F.col("field_type") == "code") & (F.col("raw_text") == "A") & (F.col("mode") != "raw_cnn"))
    assert {r.status for r in short.collect()} == {"FLAGGED"}


def test_no_shuffle_and_no_join(spark):
    known = spark.createDataFrame([("pin", "123456", None)], "kind string, entry string, prefix string")
    fields = spark.createDataFrame([(1, "pin", [("1", 0.9, [])])], f"id int, field_type string, hyp {HYPOTHESES}")
    plan = decode.decode(fields, known)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1
