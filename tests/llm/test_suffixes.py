"""Two-stage suffix order against plain sorting."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.llm.repeats import anchors
from glyphmill.llm.suffixes import common_prefix_reaches, suffix_order


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=9, max_size=60) | st.text("ab", min_size=9, max_size=60).map(str.encode), min_size=1, max_size=6), st.sampled_from([3, 8, 9]), st.booleans())
def test_order(segments, depth, twins):
    raw = b"".join(segments)
    text, ends = np.frombuffer(raw, np.uint8), np.cumsum([len(s) for s in segments])
    starts = np.concatenate([[0], ends[:-1]])
    wanted = np.concatenate([np.arange(a, b - depth + 1) for a, b in zip(starts, ends, strict=True)])
    number = np.zeros(len(text), np.uint64)
    for i in wanted:
        number[i] = hash(raw[i : i + depth]) & 0xFFFFFFFF
    order = suffix_order(text, starts, ends, wanted, depth, number if twins else None)
    keys = [raw[i : i + depth] for i in order]
    assert sorted(order.tolist()) == wanted.tolist() and keys == sorted(keys)
    assert common_prefix_reaches(text, order, depth).tolist() == [a == b for a, b in zip(keys, keys[1:], strict=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=90), min_size=1, max_size=5))
def test_every_string_has_one_anchor_inside(texts):
    raw = "".join(texts).encode()
    ends = np.cumsum([len(t) for t in texts])
    place, first, last, _ = anchors(np.frombuffer(raw, np.uint8), ends, 20, 6)
    covered = [i for a, b in zip(first, last, strict=True) for i in range(a, b + 1)]
    want = [i for e, t in zip(ends, texts, strict=True) for i in range(e - len(t), e - 20 + 1)]
    assert covered == want
    assert all(a <= p and b >= p - 14 for p, a, b in zip(place, first, last, strict=True))
