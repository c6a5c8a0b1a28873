"""Benchmark decontamination: rare words of the items find the places, Smith-Waterman alignment of words scores them.

An alignment that scores a share t of an item of m words has at least t * m of its words in order, so it leaves out at
most m - t * m of them. Of any m - t * m + c of the item's words it therefore has c; the c + m - t * m words that the
fewest documents hold are the item's seeds. A place where c seeds stand within the longest stretch that such an alignment
can have is aligned with the item, unless its words, were all of them in order, could not reach the threshold. Nothing
that reaches the threshold is passed over, however its edits are spread: longer n-grams as seeds would miss copies in
which every second or third word is replaced. How many documents hold a word is counted over all of them.

The score is the alignment's, divided by that of the whole item against itself: substituted, lost and added words lower
it. A pair counts from ``THRESHOLD`` on, and with ``LEAST`` words at least (all of an item that has no more).

Items are few by nature: they are broadcast with their words, about 80 bytes for each character of text. More than
``MOST_ITEM_CHARS`` are dealt into groups by a hash, and the texts are read twice for each group.

Defined cases: null or empty texts and items match nothing; texts of any length are read whole, and places in them are
aligned in pieces that overlap by more than an alignment; repeated rows of a document or item are one; an empty table on
either side gives no rows; equal scores of several places in a text: the first place counts; other columns are ignored
by ``contaminated``, whatever their names, and kept by ``clean``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.llm.common import mapped, settle, without, written
from glyphmill.llm.runs import pieces_of, ranges

WORD = re.compile(r"[^\W_]+")
THRESHOLD, LEAST = 0.5, 6
#: Seeds that a place needs: one for so many words of an item, and at most so many.
WORDS_A_SEED, MOST_SEEDS = 4, 8
MATCH, MISMATCH, GAP = 2, -1, -1
MOST_ITEM_CHARS = 2 << 20
#: Bytes of text of a batch; words of places that wait for their alignment, and table cells of one alignment, at a time.
CHUNK, WAITING, CELLS = 1 << 20, 1 << 20, 1 << 20


#: By byte of Latin-1: letters in lower case and digits, blanks for the rest.
_PLAIN = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(256)).encode("latin-1")


def words_of(text: str) -> list:
    """The words of a text in lower case; as Latin-1 bytes, which take less than half the time, where it has no other signs."""
    try:
        return text.encode("latin-1").translate(_PLAIN).split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


class Items:
    """Words of all items, and the seeds of each once the documents are counted."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.words: dict[str, int] = {}
        self.ids, self.bodies = [], []
        for item, text in sorted({(i, t) for i, t in items if t}, key=lambda x: (x[0] is None, x)):
            body = np.array([self.words.setdefault(w, len(self.words)) for w in WORD.findall(text.lower())], np.int64)
            if len(body):
                self.ids.append(item)
                self.bodies.append(body)
        self.words |= {w.encode("latin-1"): k for w, k in self.words.items() if max(w) <= "\xff"}
        self.bags = [np.unique(body, return_counts=True) for body in self.bodies]
        self.least = [max(threshold, min(1.0, LEAST / len(body))) for body in self.bodies]
        matched = [math.ceil(t * len(body) - 1e-9) for t, body in zip(self.least, self.bodies, strict=True)]
        self.need = np.array([min(max(1, len(body) // WORDS_A_SEED), MOST_SEEDS, m) for m, body in zip(matched, self.bodies, strict=True)], np.int64)
        self.spare = [len(body) - m for m, body in zip(matched, self.bodies, strict=True)]
        self.reach = np.array([math.ceil(len(body) * (3 - 2 * t)) for t, body in zip(self.least, self.bodies, strict=True)], np.int64)
        self.size = len(set(self.words.values()))
        self.first = np.zeros(self.size + 1, np.int64)
        self.seeded = np.zeros(0, np.int64)

    def ranked(self, documents: np.ndarray) -> None:
        """Sets the seeds, by the number of documents that hold each word."""
        pairs = []
        for k, body in enumerate(self.bodies):
            rarest = body[np.lexsort((body, documents[body]))][: self.spare[k] + int(self.need[k])]
            pairs += [(w, k) for w in np.unique(rarest).tolist()]
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.first = np.searchsorted(pairs[:, 0], np.arange(self.size + 1))
        self.seeded = pairs[:, 1]

    def most_share(self, at: int, window: np.ndarray) -> float:
        """No alignment of this item with the window has a larger score share: that of their words in common."""
        own, often = self.bags[at]
        j = np.minimum(np.searchsorted(own, window), len(own) - 1)
        return int(np.minimum(np.bincount(j[own[j] == window], minlength=len(own)), often).sum()) / len(self.bodies[at])

    def numbered(self, words: list) -> np.ndarray:
        """The words' numbers, -1 for words of no item."""
        return np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))

    def places(self, ids: np.ndarray, edge: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, text, first word, last word + 1) of the stretches where an item's seeds stand close enough, by item and place.

        ids: the words of several texts, with at least the longest reach of -1 between them; edge and sizes: where each
        text begins and how many words it has.
        """
        p = np.flatnonzero(ids >= 0)
        often = self.first[ids[p] + 1] - self.first[ids[p]]
        place, item = np.repeat(p, often), self.seeded[ranges(self.first[ids[p]], often)]
        order = np.lexsort((place, item))
        place, item = place[order], item[order]
        last = np.arange(len(item)) + self.need[item] - 1
        inside = last < len(item)
        last = np.where(inside, last, 0)
        k = np.flatnonzero(inside & (item[last] == item) & (place[last] - place < self.reach[item]))
        text = np.searchsorted(edge, place[k], side="right") - 1
        low = np.maximum(place[last[k]] - self.reach[item[k]] + 1, edge[text])
        high = np.minimum(place[k] + self.reach[item[k]], edge[text] + sizes[text])
        out: list[tuple[int, int, int, int]] = []
        for i, t, a, b in zip(item[k].tolist(), text.tolist(), low.tolist(), high.tolist(), strict=True):
            if out and out[-1][:2] == (i, t) and a <= out[-1][3]:
                out[-1] = (i, t, out[-1][2], max(b, out[-1][3]))
            else:
                out.append((i, t, a, b))
        return out


def align(item: np.ndarray, windows: list[np.ndarray]) -> list[tuple[float, int, int]]:
    """Smith-Waterman of an item with several windows at once: (score share, first word, last word + 1)."""
    ends = _best_ends(item, windows)
    turned = _best_ends(item[::-1], [w[:e][::-1] for w, (_, e) in zip(windows, ends, strict=True)])
    return [(score / (MATCH * len(item)), end - back, end) for (score, end), (_, back) in zip(ends, turned, strict=True)]


def _best_ends(item: np.ndarray, windows: list[np.ndarray]) -> list[tuple[int, int]]:
    width = max(map(len, windows), default=0)
    body = np.full((len(windows), width), -2, np.int64)
    for k, w in enumerate(windows):
        body[k, : len(w)] = w
    row = np.zeros((len(windows), width + 1), np.int32)
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    best, where = np.zeros(len(windows), np.int32), np.zeros(len(windows), np.int64)
    for word in item:
        step = np.where(body == word, MATCH, MISMATCH).astype(np.int32)
        new = np.zeros_like(row)
        np.maximum(row[:, :-1] + step, row[:, 1:] + GAP, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, 1) - slope
        top = row.argmax(1)
        value = row[np.arange(len(windows)), top]
        better = value > best
        best[better], where[better] = value[better], top[better]
    return list(zip(best.tolist(), where.tolist(), strict=True))


def _pieces(low: int, high: int, reach: int) -> Iterator[tuple[int, int]]:
    """Pieces of a stretch that overlap by more than an alignment."""
    while True:
        end = min(high, low + 6 * reach)
        yield low, end
        if end >= high:
            return
        low = end - reach


def contaminated(df: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, most_chars: int = MOST_ITEM_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, score, start, end): the place is in characters of the text."""
    few = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    size = few.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    groups = -(-size // most_chars)
    bodies = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    if groups <= 1:
        return _first_places(_places(bodies, few, threshold))
    found = [written(_places(bodies, few.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k), threshold), "contaminated") for k in range(groups)]
    return _first_places(reduce(DataFrame.union, found))


def _first_places(scored: DataFrame) -> DataFrame:
    """Of each document and item the best place, the first among equals."""
    first = F.row_number().over(Window.partitionBy("doc_id", "item_id").orderBy(F.desc("score"), "start", "end"))
    return scored.withColumn("__rank", first).where("__rank = 1").drop("__rank")


def document_counts(bodies: DataFrame, words: dict, size: int) -> np.ndarray:
    """How many of the texts hold each word; a number for each word of the items."""
    sent = bodies.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known = sent.value
        names = known.keys()
        total = np.zeros(size, np.int64)
        for piece in (p for batch in batches for p in pieces_of(batch, 0, CHUNK)):
            for body in piece.column(0).to_pylist():
                if body:
                    total[[known[w] for w in names & set(words_of(body))]] += 1
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["word", "n"])

    out = np.zeros(size, np.int64)
    for r in mapped(bodies.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # a row a word of the items
        out[r["word"]] = r["n"]
    return out


def _places(bodies: DataFrame, few: DataFrame, threshold: float) -> DataFrame:
    """Rows (doc_id, item_id, score, start, end) of all places that reach the threshold."""
    own = Items([tuple(r) for r in few.collect()], threshold)  # at most most_chars of text
    own.ranked(document_counts(bodies, own.words, own.size))
    sent = bodies.sparkSession.sparkContext.broadcast(own)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        book = sent.value
        waiting: dict[int, list[tuple[int, np.ndarray, list[tuple[int, int]]]]] = {}
        held = 0
        for piece in (p for batch in batches for p in pieces_of(batch, 1, CHUNK)):
            keys, texts = piece.column(0).to_pylist(), piece.column(1).to_pylist()
            words = [words_of(t) if t else [] for t in texts]
            apart = int(book.reach.max(initial=0))  # words of no item between texts: no stretch spans two of them
            sizes = np.array([len(w) for w in words], np.int64)
            edge = np.cumsum(sizes + apart) - sizes - apart
            ids = np.full(int((sizes + apart).sum()), -1, np.int64)
            ids[ranges(edge, sizes)] = book.numbered([w for own in words for w in own])
            spans: dict[int, list[tuple[int, int]]] = {}
            for item, row, low, high in book.places(ids, edge, sizes):
                for a, b in _pieces(low, high, int(book.reach[item])):
                    if book.most_share(item, ids[a:b]) < book.least[item] - 1e-9:
                        continue
                    if row not in spans:
                        spans[row] = _spans(texts[row], len(words[row]))
                    waiting.setdefault(item, []).append((keys[row], ids[a:b].copy(), spans[row][a - edge[row] : b - edge[row]]))
                    held += b - a
            if held > WAITING:
                yield _scored(book, waiting)
                waiting, held = {}, 0
        yield _scored(book, waiting)

    return mapped(bodies, find, "doc_id long, item_id long, score double, start long, end long")


def _scored(book: Items, waiting: dict[int, list[tuple[int, np.ndarray, list[tuple[int, int]]]]]) -> pa.RecordBatch:
    """The result rows of the waiting places (doc_id, words, their spans), by item."""
    out = []
    for item, places in waiting.items():
        body = book.bodies[item]
        places.sort(key=lambda r: len(r[1]))
        k = 0
        while k < len(places):
            most = max(1, min(256, CELLS // len(places[min(k + 255, len(places) - 1)][1])))
            some = places[k : k + most]
            k += most
            ends = _best_ends(body, [w for _, w, _ in some])
            good = [r for r, (score, _) in zip(some, ends, strict=True) if score / (MATCH * len(body)) >= book.least[item] - 1e-9]
            for (doc, _, spans), (value, low, high) in zip(good, align(body, [w for _, w, _ in good]), strict=True):
                out.append((doc, book.ids[item], value, spans[low][0], spans[high - 1][1]))
    return pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "start", "end"])


def _spans(body: str, count: int) -> list[tuple[int, int]]:
    """Character places of the words; of the lower-cased text, should lower-casing change lengths."""
    spans = [m.span() for m in WORD.finditer(body)]
    return spans if len(spans) == count else [m.span() for m in WORD.finditer(body.lower())]


def clean(df: DataFrame, items: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows of documents that hold no item, with all their columns."""
    bad = contaminated(df, items, key=key, **options).select("doc_id")
    return without(df, key, bad, "contaminated-ids")
