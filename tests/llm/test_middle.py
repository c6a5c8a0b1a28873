"""Fill-in-middle against a plain version, and the exact way back."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm import middle, oracles, queries


def plain_cut(doc_id, text, units=list, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = units(text)
    n = len(parts)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in middle.SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def words(text):
    out = []
    kind = lambda c: 1 if c in " \t\n\v\f\r" else 0 if ord(c) > 127 or c.isalnum() else 2
    for c in text:
        if out and kind(out[-1][-1]) == kind(c):
            out[-1] += c
        else:
            out.append(c)
    return out


TEXTS = [None, "", "a", "ab", "éa", "日本語 und\nmore", "x<P>y", "half <S", "S> end", "<<<", "\x00\x7f\u0080\U0001f600", "two  words, signs!? ümlaut", " ", "<M>", "word " * 50_000]
ROWS = [(i * 7 + k, t) for k in range(4) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "twice"), (3, "twice")]


@pytest.mark.parametrize(("units", "own"), [("chars", list), ("words", words)])
def test_equals_a_plain_version_and_comes_back(spark, units, own):
    df = spark.createDataFrame([(i, t, "kept", 5) for i, t in ROWS], "doc_id long, text string, form string, extra int").repartition(3)
    got = middle.restored(middle.fill_in_middle(df, units=units).withColumnRenamed("n", "units")).collect()
    assert sorted(map(repr, ((r.doc_id, r.units, r.form, r.prefix_units, r.middle_units, r.output) for r in got))) == sorted(repr((i, *plain_cut(i, t, own))) for i, t in ROWS)
    assert all(r.restored == (r.text or "") and r.extra == 5 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**12), st.text(st.sampled_from("a <PSM>é日\U0001f600\n"), max_size=12)), max_size=8))
def test_batches_equal_a_plain_version(rows):
    h = [np.array([int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for i, _ in rows], np.int64) for k in range(4)]
    marks = middle.checked(middle.SENTINELS)
    got = middle.cut(middle.texts_of(pa.array([t for _, t in rows], pa.string())), h, marks, 10, 20, "chars")
    assert list(zip(*(got[n].to_pylist() for n in middle.RESULTS), strict=True)) == [plain_cut(i, t) for i, t in rows]
    back = middle.joined(middle.texts_of(got["output"]), got["form"], marks)
    assert [b.decode() for b in back.to_pylist()] == [t for _, t in rows]


def test_slices_and_empty_tables(spark):
    texts = pa.array(["aa", "bébé", "", None, "cc"])
    sliced = middle.texts_of(texts.slice(1, 3))
    body, at = middle.spans(sliced)
    assert middle.Units(body, at).n.tolist() == [4, 0, 0]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert middle.restored(middle.fill_in_middle(empty)).count() == 0


def test_sentinels_that_cannot_be_found_again_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P<", "<S>", "<M>")):
        with pytest.raises(ValueError):
            middle.checked(bad)


def test_query_equals_its_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([r for r in ROWS if r[0] is not None], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(oracles.OP13)
    got = queries.op13_fill_in_middle(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
