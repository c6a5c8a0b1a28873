"""Runs of characters of many texts at once: code points, hashes of any stretch of them, and tables keyed by hashes.

A run is named by 62 bits of its code points, so that equal runs of a batch are found by one sort and looked up
together; nothing is kept per character in Python objects. The bits are those of two polynomials modulo a prime, each at
a point of its own: two different runs of L code points agree by chance in at most (L / 2**31)**2 of all pairs of points,
whatever the runs. (A polynomial modulo a power of two would not do: there, whole families of different texts agree at
every point.)
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glyphmill.llm.blobs import mix
from glyphmill.llm.common import Kept, remembered

_PRIME, _BITS = np.uint64((1 << 31) - 1), np.uint64(31)
#: Points of hashes that different processes must agree on.
SHARED = tuple(int.from_bytes(hashlib.sha256(f"point {k}".encode()).digest()[:4], "little") % (int(_PRIME) - 2) + 2 for k in range(2))
#: Runs of at most so many code points are remembered from one batch to the next.
REMEMBERED = 256
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = remembered(Kept())


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2**62 modulo the prime 2**31 - 1."""
    x = (x & _PRIME) + (x >> _BITS)
    x = (x & _PRIME) + (x >> _BITS)
    return np.where(x >= _PRIME, x - _PRIME, x)


def _ascending(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:  # what is known, times the next power
        more = min(done, size - done)
        out[done : done + more] = _reduced(out[:more] * np.uint64(pow(base, done, int(_PRIME))))
        done += more
    return out


def powers(n: int, base: int, least: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a number and of its inverse, modulo the prime."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n + n // 4, least)
        _POWERS[base] = (_ascending(base, size), _ascending(pow(base, -1, int(_PRIME)), size))
    up, down = _POWERS[base]
    return up[:n], down[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def pieces_of(batch: pa.RecordBatch, at: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts, in one column, have about ``most`` bytes at most, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    filled = np.cumsum(sizes)
    low = 0
    while low < batch.num_rows:
        base = filled[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(filled, base + most, side="right")))
        yield batch.slice(low, high - low)
        low = high


class Hashes:
    """Hashes of all stretches of a sequence of numbers below 2**31 - 1, each in constant time."""

    def __init__(self, codes: np.ndarray, points: tuple[int, int] = SHARED):
        self.ways = []
        values = codes.astype(np.uint64) + np.uint64(1)
        for base in points:
            up, down = powers(len(codes) + 1, base)
            total = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(_reduced(values * up[:-1]), out=total[1:])
            self.ways.append((total, down))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        one, two = (_reduced(_reduced(total[ends] - total[starts]) * down[starts]) for total, down in self.ways)
        return mix(one << np.uint64(32) | two)


class Table:
    """A fixed set of distinct hashes, each with its place in the order given."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.place = np.full(1 << bits, -1, np.int32)
        self.keys = np.zeros(1 << bits, np.uint64)
        todo = np.arange(len(keys))
        slot = (keys >> self.shift).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.place[slot] < 0)
            got, first = np.unique(slot[free], return_index=True)
            own = free[first]
            self.place[got], self.keys[got] = todo[own], keys[todo[own]]
            rest = np.ones(len(todo), bool)
            rest[own] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        slot = (hashes >> self.shift).astype(np.int64)
        out = self.place[slot]
        other = np.flatnonzero((out >= 0) & (self.keys[slot] != hashes))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            at = slot[other]
            out[other] = self.place[at]
            other = other[(out[other] >= 0) & (self.keys[at] != hashes[other])]
        return out


class Known:
    """Which hashes were seen, with the number each got: a growing sorted list."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.numbers[at], np.int32(-1))

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Takes new hashes in ascending order."""
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.numbers = np.insert(self.keys, at, hashes), np.insert(self.numbers, at, numbers.astype(np.int32))


def same(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lead: np.ndarray) -> bool:
    """Whether each run is equal to the run with the number in ``lead``."""
    other = np.flatnonzero(lead != np.arange(len(lead)))
    if (sizes[other] != sizes[lead[other]]).any():
        return False
    return np.array_equal(codes[ranges(starts[other], sizes[other])], codes[ranges(starts[lead[other]], sizes[other])])


class Lists:
    """Lists of numbers, and some values each, of runs that were worked out before; forgets all when ``most`` are held.

    Runs of a batch that share a hash are compared; if any differ, new points are drawn. Longer runs than ``REMEMBERED``
    are worked out in each batch anew.
    """

    def __init__(self, dtype, most: int, values: int = 0):
        self.dtype, self.most, self.known = np.dtype(dtype), most, Known()
        self.values = [np.zeros(0) for _ in range(values)]
        self.points = self._drawn()
        self.clear()
        remembered(self)

    @staticmethod
    def _drawn() -> tuple[int, int]:
        return tuple(int.from_bytes(os.urandom(8), "little") % (int(_PRIME) - 2) + 2 for _ in range(2))  # type: ignore[return-value]

    def clear(self) -> None:
        self.known.clear()
        self.flat, self.at, self.kept = np.zeros(0, self.dtype), np.zeros(1, np.int64), 0
        self.values = [np.zeros(0) for _ in self.values]

    def _drop_long(self) -> None:
        self.at = self.at[: self.kept + 1]
        self.flat, self.values = self.flat[: self.at[-1]], [v[: self.kept] for v in self.values]

    def numbers(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, solve: Callable) -> np.ndarray:
        """The number of each run, until the next call; ``solve(starts, sizes)`` of the new ones gives (all their lists, sizes, values...)."""
        runs = ends - starts
        while True:
            hashes, first, back = np.unique(Hashes(codes, self.points).of(starts, ends), return_index=True, return_inverse=True)
            if same(codes, starts, runs, first[back]):
                break
            self.points = self._drawn()
            self.clear()
        self._drop_long()
        number = self.known.find(hashes)
        if len(self.known) + int((number < 0).sum()) > self.most:
            self.clear()
            number[:] = -1
        new = np.flatnonzero(number < 0)
        if len(new):
            long_ = runs[first[new]] > REMEMBERED
            new = new[np.argsort(long_, kind="stable")]  # in the end, where they are dropped
            short = len(new) - int(long_.sum())
            flat, sizes, *values = solve(starts[first[new]], runs[first[new]])
            number[new] = np.arange(self.kept, self.kept + len(new))
            self.known.add(hashes[new[:short]], number[new[:short]])
            self.kept += short
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.values = [np.concatenate([a, b]) for a, b in zip(self.values, values, strict=True)]
        return number[back]

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these runs, one after the other, and their sizes."""
        sizes = self.at[numbers + 1] - self.at[numbers]
        return self.flat[ranges(self.at[numbers], sizes)], sizes


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, start + 1, ...), one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
