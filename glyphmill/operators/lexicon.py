"""The best lexicon entry of character lattices, by a trie with bounds.

A lattice has some candidates with probabilities at each place. An entry's score is the sum over its places: the log
probability of its character where that is a candidate, else the affinity between it and the first candidate, else a
fixed mismatch. The lexicon is a trie, kept as sorted keys with the first child of every node. No entry below a node can
score more than the node's own score with the best character at every place that follows; what stays below a score that
a few greedy descents have reached is left out with all that hangs on it. The result is that of a comparison with all
entries; of equal scores (to six decimals) the smallest entry is taken.

Entries that differ only in characters out of the alphabet score alike, so that one of them, the smallest, is kept: a
lexicon of n places has at most (alphabet + 1)^n entries, 1.8 million PINs and 64,000 prefixes of codes. It is broadcast
in parts of at most ``MOST_ENTRIES``; a later part is searched from the score that earlier ones have reached.

Defined cases: a null or empty lattice gets no entry; places that a short lattice lacks score as mismatches; entries of
another length than their kind's are left out; null and repeated entries count once or not at all; with an empty lexicon
nothing is found; of several codes with one prefix the largest is registered.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import constants as C

MOST_ENTRIES = 2_000_000
#: Descents that find a first score, and children that are looked at together.
BEAM, CELLS = 16, 1 << 21
DIGITS = 6
#: Places, alphabet and mismatch of each group of entries.
SHAPES = {"pin": (DIGITS, C.PIN_VOCABULARY, C.PIN_MISMATCH)} | {f"code{n}": (n, C.FULL_VOCABULARY, C.PREFIX_MISMATCH) for n in (2, 3)}
FOUND = "struct<exact:boolean,entry:string,whole:string,score:double,touched:bigint>"


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (start, start + 1, ...), one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def affinities(alphabet: str, mismatch: float) -> np.ndarray:
    """By first candidate and entry character; the last row and column: characters out of the alphabet."""
    out = np.full((len(alphabet) + 1, len(alphabet) + 1), mismatch)
    for a, b, score in C.affinity_rows():
        if a in alphabet and b in alphabet:
            out[alphabet.index(a), alphabet.index(b)] = score
    return out


@dataclass
class Lattices:
    """Scores of all characters at all places of some lattices, the key of their first candidates and how many places they have."""

    costs: np.ndarray
    keys: np.ndarray
    places: np.ndarray

    @classmethod
    def read(cls, column: pa.Array, length: int, alphabet: str, mismatch: float) -> Lattices:
        width = len(alphabet)
        places = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cells = column.flatten()
        row = np.repeat(np.arange(len(column)), places)
        place = ranges(np.zeros(len(places), np.int64), places)
        sizes = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        candidates = cells.flatten()
        code = pc.fill_null(pc.index_in(pc.struct_field(candidates, "ch"), pa.array(list(alphabet))), width).to_numpy(zero_copy_only=False).astype(np.int64)
        chance = pc.fill_null(pc.struct_field(candidates, "p"), 0.0).to_numpy(zero_copy_only=False)
        first = np.full(len(sizes), width, np.int64)
        first[sizes > 0] = code[(np.cumsum(sizes) - sizes)[sizes > 0]]
        costs = np.full((len(column), length, width + 1), mismatch)
        inside = place < length
        costs[row[inside], place[inside]] = affinities(alphabet, mismatch)[first[inside]]
        cell = np.repeat(np.arange(len(sizes)), sizes)
        some = np.flatnonzero((code < width) & inside[cell])[::-1]  # backwards: of equal candidates the first counts
        costs[row[cell[some]], place[cell[some]], code[some]] = np.log(np.maximum(chance[some], C.LEAST_PROBABILITY))
        keys = np.zeros(len(column), np.int64)
        np.add.at(keys, row[inside], first[inside] * (width + 1) ** (length - 1 - place[inside]))
        known = np.zeros(len(column), np.int64)
        np.add.at(known, row[inside], first[inside] < width)
        keys[known < length] = -1
        return cls(costs, keys, places)

    def of(self, rows: np.ndarray) -> Lattices:
        return Lattices(self.costs[rows], self.keys[rows], self.places[rows])


@dataclass
class Trie:
    """Entries of one length, sorted by the key of their characters."""

    length: int
    names: np.ndarray
    wholes: np.ndarray
    keys: np.ndarray
    rank: np.ndarray
    chars: list[np.ndarray] = field(default_factory=list)  # by depth, the character of each node
    first: list[np.ndarray] = field(default_factory=list)  # by depth, the first child of each node, and the end

    @classmethod
    def build(cls, names: list[str], wholes: list[str | None], length: int, alphabet: str) -> Trie:
        base = len(alphabet) + 1
        points = np.frombuffer("".join(names).encode("utf-32-le"), "<u4").reshape(-1, length)
        known = np.array(sorted(map(ord, alphabet)), np.int64)
        at = np.minimum(np.searchsorted(known, points), len(known) - 1)
        codes = np.where(known[at] == points, np.array([alphabet.index(chr(c)) for c in known])[at], base - 1)
        keys = codes.astype(np.int64) @ (base ** np.arange(length - 1, -1, -1, dtype=np.int64))
        text = np.array(names, f"<U{length}")
        order = np.lexsort((text, keys))
        order = order[np.diff(keys[order], prepend=-1) != 0]  # of equal keys the smallest name
        keys, own = keys[order], np.array(names, object)[order]
        rank = np.empty(len(own), np.int64)
        rank[np.argsort(text[order])] = np.arange(len(own))
        out = cls(length, own, np.array(wholes, object)[order], keys, rank)
        starts = np.zeros(min(1, len(keys)), np.int64)
        for depth in range(1, length + 1):
            prefix = keys // base ** (length - depth)
            below = np.flatnonzero(np.diff(prefix, prepend=-1) != 0)
            out.first.append(np.append(np.searchsorted(below, starts), len(below)))
            out.chars.append((prefix[below] % base).astype(np.int8))
            starts = below
        return out

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """The place of the entry with each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (keys >= 0), at, -1)

    def _below(self, costs: np.ndarray, depth: int, row: np.ndarray, node: np.ndarray, score: np.ndarray):
        """All children of some nodes."""
        sizes = self.first[depth][node + 1] - self.first[depth][node]
        child = ranges(self.first[depth][node], sizes)
        row = np.repeat(row, sizes)
        return row, child, np.repeat(score, sizes) + costs[row, depth, self.chars[depth][child]]

    def reached(self, costs: np.ndarray, touched: np.ndarray) -> np.ndarray:
        """A score that some entry has, for each lattice, by the best ``BEAM`` nodes of each depth."""
        row, node, score = np.arange(len(costs)), np.zeros(len(costs), np.int64), np.zeros(len(costs))
        for depth in range(self.length):
            row, node, score = self._below(costs, depth, row, node, score)
            touched += np.bincount(row, minlength=len(costs))
            order = np.lexsort((-score, row))
            row, node, score = row[order], node[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, node, score = row[place < BEAM], node[place < BEAM], score[place < BEAM]
        return score[np.searchsorted(row, np.arange(len(costs)))]

    def search(self, costs: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best entry of each lattice (-1: none scores as much as is known), its score, and how many nodes were looked at."""
        n = len(costs)
        best, score, touched = np.full(n, -1), np.full(n, -np.inf), np.zeros(n, np.int64)
        if not len(self.keys) or not n:
            return best, score, touched
        rest = np.zeros((n, self.length + 1))
        rest[:, :-1] = np.cumsum(costs.max(2)[:, ::-1], 1)[:, ::-1]
        low = np.maximum(known, self.reached(costs, touched)) - 2e-6  # scores are compared to six decimals
        todo = [np.arange(n)]
        while todo:
            some = todo.pop()
            row, node, total = some, np.zeros(len(some), np.int64), np.zeros(len(some))
            for depth in range(self.length):
                children = int((self.first[depth][node + 1] - self.first[depth][node]).sum())
                if children > CELLS and len(some) > 1:
                    todo += [some[: len(some) // 2], some[len(some) // 2 :]]
                    break
                row, node, total = self._below(costs, depth, row, node, total)
                touched += np.bincount(row, minlength=n)
                keep = total + rest[row, depth + 1] >= low[row]
                row, node, total = row[keep], node[keep], total[keep]
            else:
                total = np.round(total, 6)
                order = np.lexsort((self.rank[node], -total, row))
                lead = order[np.diff(row[order], prepend=-1) != 0]
                best[row[lead]], score[row[lead]] = node[lead], total[lead]
        return best, score, touched


class Lexicon:
    """Tries by group; parts of a lexicon that is broadcast."""

    def __init__(self, table: pa.Table):
        self.tries: dict[str, Trie] = {}
        groups = np.array(table["group"].to_pylist(), object)
        names, wholes = np.array(table["entry"].to_pylist(), object), np.array(table["whole"].to_pylist(), object)
        for group in set(groups.tolist()):
            own = groups == group
            self.tries[group] = Trie.build(names[own].tolist(), wholes[own].tolist(), *SHAPES[group][:2])

    def find(self, groups: pa.Array, lattices: pa.Array, before: pa.Array | None = None) -> pa.Array:
        """What is found of each lattice of a group; ``before``: what other parts have given."""
        n = len(groups)
        exact, entry, whole = np.zeros(n, bool), np.full(n, None, object), np.full(n, None, object)
        score, touched = np.full(n, -np.inf), np.zeros(n, np.int64)
        if before is not None:
            exact = pc.fill_null(pc.struct_field(before, "exact"), False).to_numpy(zero_copy_only=False).copy()
            entry, whole = (np.array(pc.struct_field(before, k).to_pylist(), object) for k in ("entry", "whole"))
            score = pc.fill_null(pc.struct_field(before, "score"), -math.inf).to_numpy(zero_copy_only=False).copy()
            touched = pc.fill_null(pc.struct_field(before, "touched"), 0).to_numpy(zero_copy_only=False).copy()
        named = np.array(groups.to_pylist(), object)
        for group, trie in self.tries.items():
            own = np.flatnonzero((named == group) & ~exact)
            if not len(own):
                continue
            length, alphabet, mismatch = SHAPES[group]
            cells = Lattices.read(lattices.take(pa.array(own)), length, alphabet, mismatch)
            hit = trie.exact(cells.keys)
            at = own[hit >= 0]
            exact[at], entry[at], whole[at], score[at] = True, trie.names[hit[hit >= 0]], trie.wholes[hit[hit >= 0]], -np.inf
            miss = np.flatnonzero((hit < 0) & (cells.places > 0))
            at = own[miss]
            best, found, seen = trie.search(cells.of(miss).costs, score[at])
            touched[at] += seen
            for k, place, value in zip(at.tolist(), best.tolist(), found.tolist(), strict=True):
                if place >= 0 and (value > score[k] or (value == score[k] and trie.names[place] < entry[k])):
                    entry[k], whole[k], score[k] = trie.names[place], trie.wholes[place], value
        return pa.StructArray.from_arrays([pa.array(exact), pa.array(entry, pa.string()), pa.array(whole, pa.string()), pa.array(score, mask=np.isinf(score)), pa.array(touched)], ["exact", "entry", "whole", "score", "touched"])


def grouped(lexicon: DataFrame) -> DataFrame:
    """Rows (group, entry, whole) of a lexicon (kind, entry, prefix): PINs, and the prefixes of codes with their codes."""
    pins = lexicon.where((F.col("kind") == "pin") & (F.length("entry") == DIGITS)).select(F.lit("pin").alias("group"), "entry", F.lit(None).cast("string").alias("whole")).distinct()
    codes = lexicon.where((F.col("kind") == "code") & F.length("prefix").isin(2, 3)).groupBy("prefix").agg(F.max("entry").alias("whole"))
    return pins.union(codes.select(F.concat(F.lit("code"), F.length("prefix").cast("string")), F.col("prefix"), "whole"))


class Finder:
    """Finds the best entries of lattices in a lexicon, which is read once; no shuffle and no join."""

    def __init__(self, lexicon: DataFrame):
        rows = grouped(lexicon)
        some = rows.limit(MOST_ENTRIES + 1).toArrow()
        tables = [some]
        if some.num_rows > MOST_ENTRIES:
            parts = math.ceil(rows.count() / MOST_ENTRIES) + 1
            tables = [rows.where(F.pmod(F.xxhash64("entry"), F.lit(parts)) == k).toArrow() for k in range(parts)]
        self.groups = {g for t in tables for g in set(t["group"].to_pylist())}
        self.parts = [lexicon.sparkSession.sparkContext.broadcast(Lexicon(t)) for t in tables]

    def column(self, group: Column, lattice: Column) -> Column:
        """A column (exact, entry, whole, score, touched) of each lattice."""

        def of(part, first: bool):
            def begin(groups: pa.Array, lattices: pa.Array) -> pa.Array:
                return part.value.find(groups, lattices)

            def go_on(groups: pa.Array, lattices: pa.Array, before: pa.Array) -> pa.Array:
                return part.value.find(groups, lattices, before)

            return F.arrow_udf(begin if first else go_on, FOUND)

        out = of(self.parts[0], True)(group, lattice)
        for part in self.parts[1:]:
            out = of(part, False)(group, lattice, out)
        return out
