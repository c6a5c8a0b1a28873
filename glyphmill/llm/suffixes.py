"""Suffix arrays of bounded depth by two-stage sorting, in numpy.

Of the wanted suffixes of a text only those smaller than their successors are sorted directly. The others are induced
in one scan of the buckets of first bytes: each suffix, in order, hands its predecessor to that one's bucket.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number (zeros beyond the end)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def smaller_than_next(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than its successor, within segments that end at ``ends``.

    A segment's end counts as smaller than every byte.
    """
    n = len(text)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    differs = np.ones(n, bool)
    differs[:-1] = text[:-1] != text[1:]
    differs |= last
    at = np.where(differs, np.arange(n), n)
    decide = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal bytes ends
    following = np.append(text[1:], np.uint8(0))
    return ~last[decide] & (following[decide] > text)


def direct_order(words: np.ndarray, where: np.ndarray, limit: np.ndarray, depth: int) -> np.ndarray:
    """The order of the suffixes at ``where`` by at most ``depth`` bytes, none from ``limit`` on; more bytes are read only where fewer are equal."""
    order = np.argsort(_clipped(words, where, limit, 0), kind="stable")
    value = _clipped(words, where, limit, 0)[order]
    tied = np.zeros(len(order), np.int64)
    tied[1:] = np.cumsum(value[1:] != value[:-1])
    open_ = np.arange(len(order))
    for at in range(8, depth, 8):
        group = tied[open_]
        size = np.bincount(group, minlength=1)[group] if len(group) else group
        open_ = open_[size > 1]
        if not len(open_):
            break
        group = tied[open_]
        value = _clipped(words, where[order[open_]], limit[order[open_]], at)
        again = np.lexsort((value, group))
        order[open_] = order[open_][again]
        group, value = group[again], value[again]
        new = np.ones(len(open_), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        tied[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        tied = _dense(tied)
    return order


def _dense(values: np.ndarray) -> np.ndarray:
    """The same groups, numbered from 0; groups are runs."""
    return np.concatenate([[0], np.cumsum(values[1:] != values[:-1])]) if len(values) else values


def _clipped(words: np.ndarray, where: np.ndarray, limit: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes from ``where + at`` on, zeros from ``limit`` on."""
    place = where + at
    left = np.clip(limit - place, 0, 8)
    value = words[np.minimum(place, len(words) - 1)]
    shift = ((8 - left) * 8).astype(np.uint64)
    return np.where(left > 0, (value >> np.minimum(shift, np.uint64(63))) << np.minimum(shift, np.uint64(63)), np.uint64(0))


def suffix_order(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int, twin: np.ndarray | None = None) -> np.ndarray:
    """The places in ``wanted``, ordered by the ``depth`` bytes from each.

    ``starts`` and ``ends`` cut the text into segments; every wanted place has ``depth`` bytes in its segment.
    ``twin``: numbers per place, equal for places whose ``depth`` bytes are taken to be equal; of these the direct sort
    reads the bytes of one.
    """
    n = len(text)
    if not len(wanted):
        return wanted
    small = smaller_than_next(text, ends)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    inside = np.zeros(n + 1, bool)
    inside[wanted] = True
    up = np.minimum.accumulate(np.where(small | last, np.arange(n), n)[::-1])[::-1]
    chain = wanted[~small[wanted]]  # their successors are needed up to one that is sorted directly or ends a segment
    reach = np.zeros(n + 2, np.int64)
    np.add.at(reach, chain, 1)
    np.add.at(reach, up[chain] + 1, -1)
    inside[:n] |= np.cumsum(reach[:n]) > 0
    segment_end = ends[np.searchsorted(ends, np.arange(n), side="right")]
    direct = np.flatnonzero(inside[:n] & small)
    words = words_at(text)
    ordered = _direct_with_twins(words, direct, segment_end, depth, twin, wanted, n)
    induced = inside.copy()
    induced[:n] &= ~small
    induced[n] = False
    induced[:n] &= ~last
    first_byte = text[ordered]
    s_cut = np.searchsorted(first_byte, np.arange(257)) if len(ordered) else np.zeros(257, np.int64)
    single = np.flatnonzero(inside[:n] & last)  # one byte alone comes first in its bucket
    pieces: list[list[np.ndarray]] = [[single[text[single] == c]] for c in range(256)]
    out = []

    def hand_on(places: np.ndarray, own: int) -> np.ndarray:
        """Predecessors go to their buckets; those of the same bucket are returned."""
        before = places[places > 0] - 1
        before = before[induced[before]]
        if not len(before):
            return before
        byte = text[before]
        same = before[byte == own]
        rest, byte = before[byte != own], byte[byte != own]
        if len(rest):
            order = np.argsort(byte, kind="stable")
            rest, byte = rest[order], byte[order]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for piece in np.split(rest, cuts):
                pieces[text[piece[0]]].append(piece)
        return same

    for own in range(256):
        todo = [p for p in pieces[own] if len(p)]
        done: list[np.ndarray] = []
        while todo:
            now = np.concatenate(todo)
            done.append(now)
            same = hand_on(now, own)
            todo = [same] if len(same) else []
        pieces[own] = []
        large = ordered[s_cut[own] : s_cut[own + 1]]
        hand_on(large, own)
        out += [*done, large]
    ranked = np.concatenate(out)
    is_wanted = np.zeros(n, bool)
    is_wanted[wanted] = True
    return ranked[is_wanted[ranked]]


def _direct_with_twins(words, direct, segment_end, depth, twin, wanted, n) -> np.ndarray:
    """``direct`` in order; of places with the same twin number only the first is compared."""
    if twin is None:
        return direct[direct_order(words, direct, segment_end[direct], depth)]
    has = np.zeros(n, bool)
    has[wanted] = True
    own = has[direct]
    number = np.where(own, twin[direct], np.uint64(0))
    key = np.lexsort((direct, number, ~own))
    sorted_direct, sorted_number, sorted_own = direct[key], number[key], own[key]
    first = np.ones(len(key), bool)
    first[1:] = ~(sorted_own[1:] & sorted_own[:-1] & (sorted_number[1:] == sorted_number[:-1]))
    group = np.cumsum(first) - 1
    leads = sorted_direct[first]
    order = direct_order(words, leads, segment_end[leads], depth)
    rank = np.empty(len(leads), np.int64)
    rank[order] = np.arange(len(leads))
    return sorted_direct[np.argsort(rank[group], kind="stable")]


def common_prefix_reaches(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each two neighbours of an order, whether their common prefix has at least ``depth`` bytes; compares the bytes."""
    a, b = order[:-1], order[1:]
    words = words_at(text)
    ok = np.ones(len(a), bool)
    at = [*range(0, depth - 7, 8)]
    if depth % 8 and depth >= 8:
        at.append(depth - 8)
    for k in at:
        live = np.flatnonzero(ok)
        ok[live] = words[a[live] + k] == words[b[live] + k]
    if depth < 8:
        shift = np.uint64(8 * (8 - depth))
        ok = (words[a] >> shift) == (words[b] >> shift)
    return ok
