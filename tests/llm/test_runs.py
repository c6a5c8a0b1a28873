"""Names of runs: texts that agree under weak hashes must stay apart, within a batch and from one batch to the next."""

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from glyphmill.llm import langid, pieces, queries, runs, token_files


def thue_morse(n, a="a", b="b"):
    bits = np.zeros(1, bool)
    while len(bits) < n:
        bits = np.concatenate([bits, ~bits])
    return "".join(np.where(bits, b, a)), "".join(np.where(bits, a, b))


SIZES = [1 << k for k in range(9, 14)]


@pytest.mark.parametrize("n", SIZES)
def test_hashes_tell_words_and_complements_apart(n):
    one, two = thue_morse(n)
    codes = runs.code_points(one + two)
    got = runs.Hashes(codes).of(np.array([0, n]), np.array([n, 2 * n]))
    assert got[0] != got[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 0x10FFFF), min_size=1, max_size=40), st.data())
def test_hashes_of_stretches_are_those_of_the_same_numbers_elsewhere(codes, data):
    codes = np.array(codes, np.uint32)
    low = data.draw(st.integers(0, len(codes) - 1))
    high = data.draw(st.integers(low, len(codes)))
    inside = runs.Hashes(codes).of(np.array([low]), np.array([high]))
    alone = runs.Hashes(codes[low:high]).of(np.array([0]), np.array([high - low]))
    value = [sum((int(c) + 1) * pow(base, i, 2**31 - 1) for i, c in enumerate(codes[low:high])) % (2**31 - 1) for base in runs.SHARED]
    assert inside == alone == runs.mix(np.array([value[0] << 32 | value[1]], np.uint64))


@pytest.mark.parametrize("together", [True, False])
@pytest.mark.parametrize("n", SIZES)
def test_token_ids_are_the_librarys(n, together):
    path = public_tokenizers.path(queries.TOKENIZER)
    library = Tokenizer.from_file(path)
    enc = token_files.Encoder(path, "uint16")
    texts = [*thue_morse(n), *(t + " x " + t for t in thue_morse(n, "b", "c"))]
    got = list(enc.encode_many(texts)) if together else [enc.encode(t) for t in texts]
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", SIZES[:3])
def test_pieces_and_languages_tell_them_apart(n):
    model = pieces.Codec(public_tokenizers.path(queries.PIECES), 2)
    texts = [*thue_morse(n), *("▁" + t for t in thue_morse(n, "c", "d"))]
    for body, ways in zip(texts, model.encode_many(texts), strict=True):
        assert ways[0][1].tolist() == model.encode_alone(body)[0][1].tolist()
    words = langid.Words(texts)
    assert len(words.first) == len(texts)


def test_lists_draw_new_points_where_runs_of_a_batch_agree_and_forget_long_ones(monkeypatch):
    solved = []

    def solve(codes):
        def one(low, sizes):
            solved.append(len(low))
            return np.concatenate([codes[a : a + n] for a, n in zip(low, sizes, strict=True)]).astype(np.int32), sizes

        return one

    lists = runs.Lists(np.int32, 100)
    real, bad = runs.Hashes.of, lists.points
    monkeypatch.setattr(runs.Hashes, "__init__", lambda self, codes, points=runs.SHARED, old=runs.Hashes.__init__: (old(self, codes, points), setattr(self, "points", points))[0])
    monkeypatch.setattr(runs.Hashes, "of", lambda self, a, b: np.zeros(len(a), np.uint64) if self.points == bad else real(self, a, b))
    codes = np.arange(600) % 7
    starts, ends = np.array([0, 7, 1, 0, 300]), np.array([3, 10, 3, 300, 599])
    for _ in range(2):
        flat, sizes = lists.of(lists.numbers(codes, starts, ends, solve(codes)))
        assert flat.tolist() == np.concatenate([codes[a:b] for a, b in zip(starts, ends, strict=True)]).tolist() and sizes.tolist() == (ends - starts).tolist()
    assert lists.points != bad and solved == [4, 2]
