"""The trigram index against a plain search."""

import numpy as np
import pytest

from glyphmill.sources import text_index
from glyphmill.sources.text_index import TextIndex

ROWS = [(i, t, k) for i, (t, k) in enumerate([("18/09/2006", "Date"), ("123456", "pin"), ("AB-1234", "code"), (None, "pin"), ("", None), ("ÄB é\U0001f600x", "Code"), ("aaaa", "aa"), ("aaaa", "aa"), ("1", "x")])]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    more = [(100 + i, "".join(rng.choice(list("ab01-"), rng.integers(0, 12))), "pin") for i in range(500)]
    own = TextIndex(spark, str(tmp_path_factory.mktemp("index")))
    own.build(spark.createDataFrame(ROWS + more, "id long, truth string, kind string").repartition(4), ["id"], ["id", "truth", "kind"])
    return own, ROWS + more


NEEDLES = ["", "1", "A", "é", "a1", "09", "/2", "aaa", "AB-1", "ab-12345", "b é\U0001f600", "\U0001f600x", "a0b1", "-01-a", "12345", "123456", "code", "101", "zzz", "a-b-a-b-"]


@pytest.mark.parametrize("needle", NEEDLES)
def test_search_equals_a_plain_one(index, needle):
    own, rows = index
    got = sorted(r.id for r in own.search(needle).collect())
    assert got == sorted(r[0] for r in rows if any(needle.lower() in str(v).lower() for v in r if v is not None) or not needle)


def test_long_needles_read_few_rows(index):
    own, rows = index
    assert own.read_share("ab01-") < 0.2 and own.search(None).count() == len(rows)


def test_lists_are_cut_by_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 7)
    own = TextIndex(spark, str(tmp_path))
    own.build(spark.createDataFrame([(i, f"row {i}") for i in range(100)], "id long, t string"), ["id"], ["t"])
    lists = spark.read.parquet(f"{own.path}/lists")
    assert lists.where("gram = 'row'").count() == 15 and max(r.n for r in lists.collect()) <= 7
    for needle in ("row", "ow 4", "9", "row 57"):
        assert sorted(r.id for r in own.search(needle).collect()) == [i for i in range(100) if needle in f"row {i}"]


def test_an_empty_table(spark, tmp_path):
    own = TextIndex(spark, str(tmp_path))
    own.build(spark.createDataFrame([], "id long, t string"), ["id"], ["t"])
    assert own.search("abc").count() == 0 and own.search("a").count() == 0 and own.search("").count() == 0


def test_packing_and_ranges():
    numbers = np.array([0, 3, 4, 16_383])
    assert text_index.unpacked(text_index.packed(numbers)).tolist() == numbers.tolist()
    assert text_index.joined_ranges([1, 2, 3, 7, 8, 20]) == [(1, 3), (7, 8), (20, 20)]
    assert text_index.joined_ranges([1, 2, 3, 7, 8, 20], 2) == [(1, 8), (20, 20)] and text_index.joined_ranges([]) == []
