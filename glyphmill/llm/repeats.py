"""Suffix-array removal of repeated byte strings across a corpus.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller
doc_id, or earlier in the same one. All strings are judged on the input.

1. Every string of ``length`` bytes has one anchor, its least hashed ``GRAM``-byte piece (the first among equals), so
   equal strings have equal anchors. Anchors are counted over the whole corpus; strings whose anchor occurs once are
   unique.
2. Whole texts that equal an earlier one are removed as such. Around each repeated anchor of the others, the bytes of
   its strings go to the anchor's partition; pieces that are the same within a batch go once, with the earliest place.
   An anchor that occurs more than ``hot`` times has its strings dealt in several ranges of the anchor's place in them,
   the more the hotter, down to one string alone. A range goes where the hash of the bytes that all its strings share
   says, so equal strings still meet, and its equal pieces go once from each task. So no more than ``hot`` pieces a string
   of the anchor, or one a task, share a key, however many documents hold the anchor.
3. There the strings' suffixes are ordered by two-stage sorting (see ``suffixes``), neighbours with a common prefix of
   ``length`` bytes are one string, and all its places but the earliest are repeats.
4. The repeats' spans return to their documents.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; several rows of one
doc_id with equal texts are the same document and count once (each row loses the same), with different texts they are
ordered by the texts' hash; null doc_ids come first; an empty table gives no rows; other columns are kept by
``without_repeats``, whatever their names. Whole texts are held equal by their 128-bit hash,
shorter pieces by their bytes; texts of any length are read whole, their anchors a block at a time, and sorted in pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.blobs import Packer, exchanged, gathered, joined, mix, schema_of, spread
from glyphmill.llm.common import MOST_BROADCAST, Kept, mapped, partitions, remembered, settle, written
from glyphmill.llm.suffixes import common_prefix_reaches, suffix_order

NULL_ID = -(2**63)
LENGTH, GRAM = 100, 32
CHUNK_BYTES, SORT_BYTES, BLOCK = 1 << 20, 1 << 20, 1 << 16
#: Occurrences for each range that an anchor's strings are dealt in, and pieces that a task holds back to merge them.
HOT, HELD = 1_024, 20_000
#: An anchor's number is listed with the count of its ranges in the low bits.
_RANGE_BITS = 16
_PLACE_BITS = np.uint64(24)
_ODD = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = remembered(Kept())


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 4 * LENGTH)
        for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(text: np.ndarray, width: int) -> np.ndarray:
    """A mixed hash of the ``width`` bytes from each place on."""
    n = len(text) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return stretch_hashes(text, np.arange(n), np.arange(width, len(text) + 1))


def stretch_hashes(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A mixed hash of the bytes between each two places."""
    up, down = _powers(len(text) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return mix((total[high] - total[low]) * down[low])


def anchors(text: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that end at ``ends``: (place, first and last start of the strings it anchors, its hash), in order."""
    window = length - gram + 1
    found: list[tuple[np.ndarray, ...]] = []
    for low in range(0, max(0, len(text) - length + 1), BLOCK):
        some = text[low : low + BLOCK + length - 1]
        n = len(some) - length + 1
        hashes = rolling(some, gram)
        packed = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_min(packed, window)[:n]
        at = np.arange(low, low + n)
        starts = np.flatnonzero(at + length <= ends[np.searchsorted(ends, at, side="right")])
        if not len(starts):
            continue
        place = (least[starts] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
        new = np.concatenate([[True], (place[1:] != place[:-1])])
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(starts)) - 1
        found.append((place[at] + low, starts[at] + low, starts[last] + low, hashes[place[at]]))
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
    place, first, last, hashes = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = np.concatenate([[True], place[1:] != place[:-1]])  # one anchor may serve two blocks
    cut = np.flatnonzero(keep)
    return place[cut], first[cut], last[np.append(cut[1:], len(place)) - 1], hashes[cut]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width + width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of some documents each: (rows, their bytes, their ends)."""
    for batch in batches:
        column = batch.column(text_at).cast(pa.large_binary())
        sizes = np.array([len(v.as_buffer()) if v.is_valid else 0 for v in column], np.int64)
        low = 0
        while low < batch.num_rows:
            high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low : low + 512]), CHUNK_BYTES, side="right")))
            high = min(high, batch.num_rows, low + 512)
            raw = b"".join(v.as_py() or b"" for v in column[low:high])
            yield batch.slice(low, high - low), np.frombuffer(raw, np.uint8), np.cumsum(sizes[low:high])
            low = high


# --- 1. repeated anchors ----------------------------------------------------------------------------------------

_COUNT = {
    "anchor": {"hashes": "<u8", "number": "<i4", "times": "<i4", "chunk": "<i8"},  # ~number of the first where a chunk has several; times of those
    "chunk": {"docs": "<i8", "sizes": "<i8", "counts": "<i4", "marks": "S32", "number": "<i4", "leads": "<i4", "chunk": "<i8"},
    "again": {"number": "<i4", "ranges": "<i4", "chunk": "<i8"},
}


def repeated_anchors(rows: DataFrame, length: int, gram: int, parts: int, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, mark, n_bytes, anchors): which of a document's anchors occur elsewhere, too, each as its number and, in the low bits, in how many ranges its strings are dealt."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        task = TaskContext.get().partitionId() << 32
        for k, (piece, text, ends) in enumerate(chunks(batches, 2)):
            out = Packer(_COUNT)
            place, _, _, hashes = anchors(text, ends, length, gram)
            order = np.argsort(hashes, kind="stable")
            ranked = hashes[order]
            first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
            many = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1] > 1 if len(ranked) else first
            keep = first | ~many
            group = np.cumsum(first) - 1
            times = np.bincount(group)[group][keep].astype("<i4") if len(ranked) else order
            lead = order[first][group]
            number = np.where(many, ~order, order)[keep].astype("<i4")
            target = spread(ranked[keep], parts)
            by = np.argsort(target, kind="stable")
            cuts = np.flatnonzero(np.diff(target[by])) + 1
            for some in np.split(by, cuts) if len(by) else ():
                out.one("anchor", int(target[some[0]]), {"hashes": ranked[keep][some].astype("<u8").tobytes(), "number": number[some].tobytes(), "times": times[some][number[some] < 0].tobytes(), "chunk": np.int64(task + k).tobytes()})
            sizes = np.diff(np.concatenate([[0], ends]))
            counts = np.bincount(np.searchsorted(ends, place, side="right"), minlength=len(ends)).astype("<i4")
            several = np.argsort(order[many])
            out.one("chunk", int(spread(mix(np.array([task + k])), parts)[0]), {"docs": np.array(piece.column(0).to_pylist(), "<i8").tobytes(), "sizes": sizes.astype("<i8").tobytes(), "counts": counts.tobytes(), "marks": np.array(piece.column(1).to_pylist(), "S32").tobytes(), "number": order[many][several].astype("<i4").tobytes(), "leads": lead[many][several].astype("<i4").tobytes(), "chunk": np.int64(task + k).tobytes()})
            yield out.flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, _COUNT)
        hashes, number = joined(got["anchor"]["hashes"], "<u8"), joined(got["anchor"]["number"], "<i4")
        chunk = np.repeat(joined(got["anchor"]["chunk"], "<i8"), [len(n) for n in got["anchor"]["number"]])
        times = np.ones(len(number), np.int64)
        times[number < 0] = joined(got["anchor"]["times"], "<i4")
        order = np.argsort(hashes, kind="stable")
        hashes, number, chunk, times = hashes[order], number[order], chunk[order], times[order]
        out = Packer(_COUNT)
        if len(hashes):
            group = np.concatenate([[0], np.cumsum(hashes[1:] != hashes[:-1])])
            total = np.bincount(group, times).astype(np.int64)[group]
            ranges = np.clip(-(-total // hot), 1, length - gram + 1).astype("<i4")
            again = (total > 1) & ((number >= 0) | (ranges > 1))
            number, chunk, ranges = number[again], chunk[again], ranges[again]
            order = np.argsort(chunk, kind="stable")
            number, chunk, ranges = number[order], chunk[order], ranges[order]
            for some in np.split(np.arange(len(chunk)), np.flatnonzero(np.diff(chunk)) + 1) if len(chunk) else ():
                out.one("again", int(spread(mix(chunk[some[:1]]), parts)[0]), {"number": number[some].tobytes(), "ranges": ranges[some].tobytes(), "chunk": chunk[some[:1]].tobytes()})
        for k in range(len(got["chunk"]["chunk"])):
            own = {c: got["chunk"][c][k].tobytes() for c in _COUNT["chunk"]}
            out.one("chunk", int(spread(mix(got["chunk"]["chunk"][k]), parts)[0]), own)
        yield out.flush()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, _COUNT)
        again: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for chunk, number, ranges in zip(*(got["again"][n] for n in ("chunk", "number", "ranges")), strict=True):
            again.setdefault(int(chunk[0]), []).append((number, ranges))
        c = got["chunk"]
        for k in range(len(c["chunk"])):
            number, ranges = (np.concatenate(x) for x in zip((np.zeros(0, "<i4"),) * 2, *again.get(int(c["chunk"][k][0]), []), strict=True))
            ends = np.cumsum(c["counts"][k])
            dealt = np.zeros(ends[-1] if len(ends) else 0, np.int64)  # in how many ranges; 0 for anchors that occur once
            dealt[number[number >= 0]] = ranges[number >= 0]
            by_lead = np.ones(len(dealt), np.int64)
            by_lead[~number[number < 0]] = ranges[number < 0]
            dealt[c["number"][k]] = by_lead[c["leads"][k]]
            found = np.flatnonzero(dealt)
            owner = np.searchsorted(ends, found, side="right")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(ends)))])
            own = (found - (ends - c["counts"][k])[owner]) << _RANGE_BITS | dealt[found]
            yield pa.record_batch([pa.array(c["docs"][k]), pa.array([m.decode() for m in c["marks"][k].tolist()], pa.string()), pa.array(c["sizes"][k]), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(own))], ["doc_id", "mark", "n_bytes", "anchors"])

    counted = exchanged(mapped(rows, deal, schema_of(_COUNT)), parts, count, schema_of(_COUNT))
    return exchanged(counted, parts, collect, "doc_id long, mark string, n_bytes long, anchors array<long>")


# --- 2. and 3. strings around them ------------------------------------------------------------------------------

_SORT = {"piece": {"raw": "", "lengths": "<i4", "hashes": "<u8", "docs": "<i8", "marks": "<u8", "starts": "<i8"}, "span": {"docs": "<i8", "marks": "<u8", "starts": "<i8", "ends": "<i8"}}


def short_mark(marks: list[str]) -> np.ndarray:
    return np.array([int(m[:16], 16) for m in marks], np.uint64)


def repeated_spans(rows: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """Rows (doc_id, short, starts, ends) of documents (doc_id, mark, text, anchors): their spans of repeats, merged."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        out = Packer(_SORT)
        held: dict[bytes, tuple[int, int, int, int]] = {}  # pieces of hot anchors: (doc, mark, start, key) of the earliest
        for piece, text, ends in chunks(batches, 2):
            raw = text.tobytes()
            place, first, last, hashes = anchors(text, ends, length, gram)
            before = np.searchsorted(np.searchsorted(ends, place, side="right"), np.arange(len(ends)))
            listed = [(np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64), b) for x, b in zip(piece.column(3), before, strict=True)]
            chosen = np.concatenate([(x >> _RANGE_BITS) + b for x, b in listed]).astype(np.int64)
            ranges = np.concatenate([x & ((1 << _RANGE_BITS) - 1) for x, _ in listed]).astype(np.int64)
            which, low, high, key = pieces_of(text, place[chosen], first[chosen], last[chosen], hashes[chosen], ranges, length, gram)
            hot = ranges[which] > 1
            owner = np.searchsorted(ends, low, side="right")
            begin = (ends - np.diff(np.concatenate([[0], ends])))[owner]
            doc, mark = np.array(piece.column(0).to_pylist(), np.int64)[owner], short_mark(piece.column(1).to_pylist())[owner]
            start, stop = low - begin, high + length - begin

            def at(c: int) -> tuple[int, int, int, int]:
                return int(doc[c]), int(mark[c]), int(start[c]), int(key[c])

            seen: dict[bytes, int] = {}
            sent, spans, replaced = [], [], []
            for c in np.lexsort((start, mark, doc)).tolist():
                own = raw[low[c] : high[c] + length]
                lead = seen.setdefault(own, c)
                if lead != c:
                    if at(lead)[:3] != at(c)[:3]:
                        spans.append(c)
                elif not hot[c]:
                    sent.append(c)
                elif (old := held.setdefault(own, at(c)))[:3] < (new := at(c))[:3]:
                    spans.append(c)
                elif old[:3] > new[:3]:
                    held[own] = new
                    replaced.append((*old[:3], old[2] + len(own)))
            spans, sent = np.array(spans, np.int64), np.array(sent, np.int64)
            gone = [np.array(x, t) for x, t in zip(zip(*replaced, strict=True), ("<i8", "<u8", "<i8", "<i8"), strict=True)] if replaced else [np.zeros(0, t) for t in ("<i8", "<u8", "<i8", "<i8")]
            columns = merged(*(np.concatenate([x[spans], y]) for x, y in zip((doc, mark, start, stop), gone, strict=True)))
            out.add("span", spread(mix(columns[0]), parts), dict(zip(("docs", "marks", "starts", "ends"), columns, strict=True)))
            send(out, [raw[low[c] : high[c] + length] for c in sent.tolist()], key[sent], doc[sent], mark[sent], start[sent])
            if len(held) > HELD:
                send_held(out, held)
            yield out.flush()
        send_held(out, held)
        yield out.flush()

    def send_held(out: Packer, held: dict[bytes, tuple[int, int, int, int]]) -> None:
        columns = [np.array([x[k] for x in held.values()], t) for k, t in enumerate(("<i8", "<u8", "<i8", "<u8"))]
        send(out, list(held), columns[3], *columns[:3])
        held.clear()

    def send(out: Packer, bodies: list[bytes], key: np.ndarray, doc: np.ndarray, mark: np.ndarray, start: np.ndarray) -> None:
        pack = pa.Codec("zstd", compression_level=1)
        target = spread(key, parts)
        by = np.lexsort((key, target))
        for some in np.split(by, np.flatnonzero(np.diff(target[by])) + 1) if len(by) else ():
            own = [bodies[k] for k in some.tolist()]
            columns = {"lengths": np.array([len(b) for b in own]), "hashes": key[some], "docs": doc[some], "marks": mark[some], "starts": start[some]}
            out.one("piece", int(target[some[0]]), {"raw": pack.compress(b"".join(own), asbytes=True)} | {n: np.ascontiguousarray(v, _SORT["piece"][n]).tobytes() for n, v in columns.items()})

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, _SORT)
        out = Packer(_SORT)
        p = got["piece"]
        unpack = pa.Codec("zstd")
        lengths, hashes, docs, marks, starts = (joined(p[c], _SORT["piece"][c]) for c in ("lengths", "hashes", "docs", "marks", "starts"))
        if len(lengths):
            sizes = [int(x.sum()) for x in p["lengths"]]
            bodies = [np.frombuffer(unpack.decompress(r, decompressed_size=n), np.uint8) for r, n in zip(p["raw"], sizes, strict=True)]
            p["raw"].clear()
            text = np.concatenate(bodies)
            del bodies
            at = np.cumsum(lengths, dtype=np.int64) - lengths
            order = np.argsort(hashes, kind="stable")
            new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
            filled = np.cumsum(lengths[order], dtype=np.int64)
            low = 0
            while low < len(order):  # as many whole anchors as make up SORT_BYTES, one at least
                base = filled[low - 1] if low else 0
                high = int(np.searchsorted(filled, base + SORT_BYTES))
                more = np.flatnonzero(new[max(high, low + 1) :])
                high = max(high, low + 1) + int(more[0]) if len(more) else len(order)
                some = order[low:high]
                low = high
                for columns in (repeats_in(text, at[some], lengths[some], docs[some], marks[some], starts[some], length),):
                    out.add("span", spread(mix(columns["docs"]), parts), columns)
                    yield out.flush()
        for k in range(len(got["span"]["docs"])):
            own = {c: got["span"][c][k] for c in _SORT["span"]}
            out.add("span", spread(mix(own["docs"]), parts), own)
        yield out.flush()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, _SORT)["span"]
        docs, marks, starts, ends = merged(*(joined(got[c], _SORT["span"][c]) for c in ("docs", "marks", "starts", "ends")))
        if len(docs):
            new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])])
            at = np.flatnonzero(new)
            cuts = pa.array(np.append(at, len(docs)), pa.int32())
            yield pa.record_batch([pa.array(docs[at]), pa.array(marks[at].view(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(starts)), pa.ListArray.from_arrays(cuts, pa.array(ends))], ["doc_id", "short", "starts", "ends"])

    sorted_ = exchanged(mapped(rows, deal, schema_of(_SORT)), parts, sort, schema_of(_SORT))
    return exchanged(sorted_, parts, collect, "doc_id long, short long, starts array<long>, ends array<long>")


def pieces_of(text: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray, ranges: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The pieces of some anchors: (which anchor, first and last start of the strings, the key they go by).

    An anchor of one range has one piece, its key is the anchor's hash. Else the strings are cut by the anchor's place in
    them, and the key is the hash of the bytes that all strings of the range share (each covers them).
    """
    window = length - gram + 1
    width = -(-window // np.maximum(ranges, 1))
    count = np.where(ranges > 1, -(-window // width), 1)
    which = np.repeat(np.arange(len(place)), count)
    number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    if not (ranges > 1).any():
        return which, first, last, hashes
    cut = (ranges > 1)[which]
    latest = place[which] - number * width[which]
    earliest = place[which] - np.minimum((number + 1) * width[which], window) + 1
    low = np.where(cut, np.maximum(first[which], earliest), first[which])
    high = np.where(cut, np.minimum(last[which], latest), last[which])
    some = low <= high
    which, low, high, cut, latest, earliest = (x[some] for x in (which, low, high, cut, latest, earliest))
    key = hashes[which]
    key[cut] = stretch_hashes(text, latest[cut], earliest[cut] + length)
    return which, low, high, key


def repeats_in(text: np.ndarray, at: np.ndarray, lengths: np.ndarray, docs: np.ndarray, marks: np.ndarray, starts: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Spans of the strings in some pieces that also start at an earlier place among them."""
    ends = np.cumsum(lengths, dtype=np.int64)
    begin = ends - lengths
    owner_of = np.repeat(np.arange(len(at)), lengths)
    own = text[np.arange(ends[-1]) - begin[owner_of] + at[owner_of]]
    inside = np.arange(len(own)) + length <= ends[owner_of]
    wanted = np.flatnonzero(inside)
    twin = rolling(own, length)
    twin = np.concatenate([twin, np.zeros(len(own) - len(twin), np.uint64)])
    order = suffix_order(own, begin, ends, wanted, length, twin)
    group = np.concatenate([[0], np.cumsum(~common_prefix_reaches(own, order, length))])
    owner = owner_of[order]
    place = starts[owner] + order - begin[owner]
    rank = np.lexsort((place, marks[owner], docs[owner], group))
    first = np.concatenate([[True], group[rank][1:] != group[rank][:-1]])
    lead = rank[first][np.cumsum(first) - 1]
    same = (docs[owner[rank]] == docs[owner[lead]]) & (marks[owner[rank]] == marks[owner[lead]]) & (place[rank] == place[lead])
    again = rank[~same]
    columns = merged(docs[owner[again]], marks[owner[again]], place[again], place[again] + length)
    return dict(zip(("docs", "marks", "starts", "ends"), columns, strict=True))


def merged(docs: np.ndarray, marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of spans within each document, touching ones joined, in order."""
    if not len(docs):
        return docs, marks, starts, ends
    order = np.lexsort((starts, marks, docs))
    docs, marks, starts, ends = docs[order], marks[order], starts[order], ends[order]
    new_doc = np.concatenate([[True], (docs[1:] != docs[:-1]) | (marks[1:] != marks[:-1])])
    number = np.cumsum(new_doc) - 1
    shift = number * (int(ends.max()) + 1)  # later documents lie beyond all earlier ones
    reach = np.maximum.accumulate(ends + shift)
    new = new_doc | np.concatenate([[True], (starts + shift)[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(new)) - 1
    return docs[at], marks[at], starts[at], (reach - shift)[last]


# --- the operator -----------------------------------------------------------------------------------------------


def spans(df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, parts: int | None = None, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(documents with __doc, __mark and all their columns; rows (__doc, __mark, __starts, __ends) of those that lose bytes)."""
    parts = parts or partitions(df.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    full = df.withColumn("__doc", F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID))).withColumn("__mark", F.md5(body.cast("binary")))
    rows = full.select(F.col("__doc").alias("doc_id"), F.col("__mark").alias("mark"), body.alias("text"))
    counted = written(repeated_anchors(rows, length, gram, parts, hot), "repeat-anchors")
    long_ = counted.where(F.col("n_bytes") >= length)
    lead = long_.groupBy("mark").agg(F.min("doc_id").alias("lead"))
    known = long_.join(lead, "mark")
    copies = known.where("doc_id <> lead").select("doc_id", "mark", F.array(F.lit(0).cast("long")).alias("starts"), F.array("n_bytes").alias("ends"))
    todo = known.where("doc_id = lead and size(anchors) > 0").select("doc_id", "mark", "anchors").dropDuplicates(["doc_id", "mark"])
    own = written(todo.select("doc_id").distinct(), "repeat-ids")
    if own.count() <= MOST_BROADCAST:  # only the texts that are sorted are shuffled
        rows = rows.join(F.broadcast(own), "doc_id", "left_semi")
    found = repeated_spans(rows.join(todo, ["doc_id", "mark"]).select("doc_id", "mark", "text", "anchors"), length, gram, parts)
    short = F.conv(F.substring("mark", 1, 16), 16, -10).cast("long")
    back = found.join(todo.select("doc_id", "mark", short.alias("short")), ["doc_id", "short"]).select("doc_id", "mark", "starts", "ends")
    cut = written(copies.dropDuplicates(["doc_id", "mark"]).union(back), "repeat-spans")
    n, spans_ = cut.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    cut = cut.toDF("__doc", "__mark", "__starts", "__ends")
    return full, F.broadcast(cut) if 8 * n + 2 * spans_ <= MOST_BROADCAST else cut  # in units of an id


def _kept(raw: bytes, starts: list[int] | None, ends: list[int] | None) -> bytes:
    if not starts:
        return raw
    at, out = 0, []
    for low, high in zip(starts, ends, strict=True):
        out.append(raw[at:low])
        at = high
    out.append(raw[at:])
    return b"".join(out)


def repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends) of every row."""
    full, cut = spans(df, key=key, text=text, **options)
    body = full.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), "__doc", "__mark")
    rows = body.join(cut, ["__doc", "__mark"], "left").select("doc_id", "text", F.col("__starts").alias("starts"), F.col("__ends").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s, e in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                out.append((len(raw), sum(e or ()) - sum(s or ()), len(s or ()), hashlib.sha256(_kept(raw, s, e)).hexdigest()))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.record_batch([batch.column(0), *columns, batch.column(2), batch.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    return mapped(rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")


def without_repeats(df: DataFrame, *, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars", **options) -> DataFrame:
    """The rows with the repeats cut out of their text (characters cut in two are dropped) and ``chars`` set anew; rows of which nothing is left go."""
    full, cut = spans(df, key=key, text=text, **options)
    rows = full.join(cut, ["__doc", "__mark"], "left")

    @F.pandas_udf("string")
    def left(texts, starts, ends):
        return texts.combine(starts.combine(ends, lambda s, e: (s, e)), lambda t, se: t if t is None or se[0] is None else _kept(t.encode("utf-8", "surrogatepass"), list(se[0]), list(se[1])).decode("utf-8", "ignore"))

    changed = F.col("__starts").isNotNull()
    text_now = F.when(changed, left(F.when(changed, F.col(text)), "__starts", "__ends")).otherwise(F.col(text))
    out = rows.withColumn("__left", text_now).where(~changed | (F.length("__left") > 0))
    columns = [F.col("__left").alias(c) if c == text else F.when(changed, F.length("__left").cast("long")).otherwise(F.col(c)).cast(df.schema[c].dataType).alias(c) if c == chars else F.col(f"`{c}`") for c in df.columns]
    return out.select(*columns)
