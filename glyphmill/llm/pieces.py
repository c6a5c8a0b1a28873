"""SentencePiece encoding and decoding with N-best segmentation.

A text becomes a lattice of the vocabulary's pieces, each with its score from the model file. The forward pass keeps
the best score of every prefix; the backward A* search from the text's end uses these scores as exact estimates of
what is left, so segmentations leave its queue in order of score.

The lattice falls apart wherever no piece holds the two neighbouring characters. Each distinct stretch of a batch is
searched on its own, all of them in step: one forward pass, then the search's first descent, which gives the best
segmentation and the head of the queue, that is how much the second one loses. The N best segmentations of a whole text
follow from those of its stretches, and only the N - 1 stretches with the smallest losses can deviate in them; for
these the search goes on. Stretches are named by 64-bit hashes and remembered up to ``MOST_KNOWN``; a text that does
not decode to itself is searched again without them.

A character without a piece of its own is an unknown of score (least score - 10) and is written as its bytes. Scores
are sums of the file's scores; of segmentations with equal scores any may come first, always the same one.

Defined cases: null counts as empty and gives no pieces, one empty segmentation of score 0 and the text ''; texts may
be of any length (one that exceeds ``CHUNK`` is a batch of its own); repeated rows are kept; an empty table gives no
rows; the other columns of a table are kept where asked for, but one with the name of a result gives way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Memo, mapped, plain_names, settle
from glyphmill.llm.runs import Hashes, Lists, Table, code_points, pieces_of, ranges

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_LOSS = 10.0
#: Bytes of text of a batch; stretches that are remembered; longer stretches are searched one by one.
CHUNK, MOST_KNOWN, MOST_IN_STEP = 1 << 19, 400_000, 256
_CODECS: dict[tuple[str, int], Codec] = {}


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, best: int = 4):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.best = best
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: dict[int, int] = {}
        self.shown: list[bytes] = []
        self.unknown_id = 0
        for i, p in enumerate(model.pieces):
            if p.type in (NORMAL, USER):
                self.pieces[p.piece] = (i, p.score)
                self.shown.append(p.piece.replace(BLANK, " ").encode())
            elif p.type == BYTE:
                self.bytes_of[int(p.piece[3:5], 16)] = i
                self.shown.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.unknown_id = i if p.type == UNKNOWN else self.unknown_id
                self.shown.append(" ⁇ ".encode() if p.type == UNKNOWN else b"")
        self.dtype = np.dtype("<u2" if len(model.pieces) <= 1 << 16 else "<u4")
        self.unknown_score = min(s for _, s in self.pieces.values()) - UNKNOWN_LOSS
        self.longest = max(map(len, self.pieces))
        self.reach: dict[str, int] = {}  # the longest piece with these last four characters; without one, pieces have three at most
        for p in self.pieces:
            if len(p) > 3:
                self.reach[p[-4:]] = max(len(p), self.reach.get(p[-4:], 0))
        self._tables()
        self.others = Memo(self._ways, 20_000)
        self.parts = Lists(self.dtype, MOST_KNOWN, values=2)

    def _tables(self) -> None:
        """Beginnings of pieces by hash, and the pairs of characters that some piece holds together."""
        begins = sorted({p[:n] for p in self.pieces for n in range(1, len(p) + 1)})
        sizes = np.fromiter(map(len, begins), np.int64, len(begins))
        ends = np.cumsum(sizes)
        self.begins = Table(Hashes(code_points("".join(begins))).of(ends - sizes, ends))
        self.piece_of = np.array([self.pieces.get(p, (-1, 0.0))[0] for p in begins], np.int32)
        self.score_of = np.array([self.pieces.get(p, (-1, 0.0))[1] for p in begins])
        longer = {p[:n] for p in self.pieces for n in range(1, len(p))}
        self.goes_on = np.array([p in longer for p in begins])
        pairs = sorted({p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)})
        chars = sorted(set("".join(pairs)))
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[code_points("".join(chars))] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        if pairs:
            left, right = self.kind[code_points("".join(pairs))].reshape(-1, 2).T
            self.joined[left, right] = True

    def lattice(self, text: str, end: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """Arcs (start, ids, score) that end at a place."""
        for start in range(max(0, end - self.longest), end):
            found = self.pieces.get(text[start:end])
            if found:
                yield start, (found[0],), found[1]
            elif start == end - 1:
                yield start, self._unknown(text[start]), self.unknown_score

    def _unknown(self, char: str) -> tuple[int, ...]:
        raw = char.encode("utf-8", "surrogatepass")
        return tuple(self.bytes_of[b] for b in raw) if len(self.bytes_of) == 256 else (self.unknown_id,)

    def forward(self, text: str) -> list[float]:
        """The best score of every prefix."""
        get, reach, unknown = self.pieces.get, self.reach.get, self.unknown_score
        ahead = [0.0]
        for end in range(1, len(text) + 1):
            best = None
            span = reach(text[end - 4 : end], 3) if end > 3 else end
            for start in range(end - span if end > span else 0, end):
                found = get(text[start:end])
                if found is not None:
                    score = ahead[start] + found[1]
                    if best is None or score > best:
                        best = score
            if get(text[end - 1]) is None:
                score = ahead[end - 1] + unknown
                if best is None or score > best:
                    best = score
            ahead.append(best)
        return ahead

    def _descend(self, text: str, ahead: list[float], at: int, behind: float, path: tuple | None, leave) -> tuple:
        """Follows the best arcs back to the start; what branches off goes to ``leave(total, start, behind, path)``."""
        while at:
            chosen = None
            for start, ids, score in self.lattice(text, at):
                if chosen is None and ahead[start] + score == ahead[at]:
                    chosen = (start, behind + score, (ids, path))
                else:
                    leave(ahead[start] + score + behind, start, behind + score, (ids, path))
            at, behind, path = chosen
        return behind, path

    def search(self, text: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best segmentations of a lattice, best first.

        The queue's order is the exact total of the best completion, so an entry that is taken leads straight to the
        start. Each entry stands for other segmentations than all the rest; what is worse than the N best totals seen
        never enters.
        """
        ahead = self.forward(text)
        out: list[tuple[float, tuple[int, ...]]] = []
        queue: list[tuple[float, int, int, float, tuple | None]] = [(-ahead[-1], 0, len(text), 0.0, None)]
        totals = [ahead[-1]]
        tick = 0

        def leave(total: float, start: int, behind: float, path: tuple) -> None:
            nonlocal tick
            if len(totals) < self.best:
                heapq.heappush(totals, total)
            elif total > totals[0]:
                heapq.heapreplace(totals, total)
            else:
                return
            tick += 1
            heapq.heappush(queue, (-total, tick, start, behind, path))

        while queue and len(out) < self.best:
            _, _, at, behind, path = heapq.heappop(queue)
            behind, path = self._descend(text, ahead, at, behind, path, leave)
            out.append((behind, _flat(path)))
        return out

    def _ways(self, text: str) -> list[tuple[float, bytes]]:
        """The second to N-th best segmentations of a stretch, with their losses."""
        found = self.search(text)
        return [(found[0][0] - score, np.array(ids, self.dtype).tobytes()) for score, ids in found[1:]]

    def _arcs(self, codes: np.ndarray, pos: np.ndarray, limit: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Per length of a piece the lattices' arcs (from, to, score, piece or -1, first of each end place), ordered by the end's place."""
        out = []
        hashes = Hashes(codes)
        alive = np.arange(len(codes))
        most = int(pos.max()) + 1
        for size in range(1, self.longest + 1):
            found = self.begins.find(hashes.of(alive, alive + size))
            if size > 1:
                alive, found = alive[found >= 0], found[found >= 0]
            piece = np.where(found >= 0, self.piece_of[found], -1)
            score = np.where(piece >= 0, self.score_of[found], self.unknown_score)
            real = np.flatnonzero(piece >= 0) if size > 1 else np.arange(len(alive))
            end = (pos[alive[real]] + size).astype(np.int16)
            order = np.argsort(end, kind="stable")
            real = real[order]
            at = node[alive[real]]
            out.append((at, at + size, score[real], piece[real], np.searchsorted(end[order], np.arange(most + 2))))
            alive = alive[(found >= 0) & self.goes_on[found]]
            alive = alive[alive + size < limit[alive]]
            if not len(alive):
                break
        return out

    def _solved(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of stretches, one after the other: (ids of all, how many of each, best score, loss of the second best).

        The forward pass goes from place to place in all lattices at once and keeps the best two arcs of every node;
        the search's first descent then follows the best arcs back from all ends, and the least loss of an arc that it
        leaves aside is the head of its queue.
        """
        count = len(sizes)
        ends = np.cumsum(sizes)
        begin = ends - sizes
        pos = np.arange(len(codes)) - np.repeat(begin, sizes)
        number = np.repeat(np.arange(count), sizes)
        arcs = self._arcs(codes, pos, np.repeat(ends, sizes), np.arange(len(codes)) + number)
        bases = np.cumsum([0, *(len(a[0]) for a in arcs)])
        ahead = np.full(len(codes) + count, -np.inf)
        second = ahead.copy()
        root = begin + np.arange(count)
        ahead[root] = 0.0
        came = np.zeros(len(ahead), np.int64)
        for place in range(1, int(sizes.max()) + 1):
            for k in range(min(place, len(arcs)) - 1, -1, -1):  # of arcs with equal totals the longest counts
                start, end, score, _, cuts = arcs[k]
                low, high = cuts[place], cuts[place + 1]
                if low == high:
                    continue
                to = end[low:high]
                value = ahead[start[low:high]] + score[low:high]
                old = ahead[to]
                better = value > old
                second[to] = np.maximum(second[to], np.minimum(old, value))
                ahead[to] = np.where(better, value, old)
                came[to[better]] = bases[k] + low + np.flatnonzero(better)
        start, piece = np.concatenate([a[0] for a in arcs]), np.concatenate([a[3] for a in arcs])
        here = root + sizes
        loss = np.full(count, np.inf)
        busy = np.arange(count)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(busy):
            node = here[busy]
            loss[busy] = np.minimum(loss[busy], ahead[node] - second[node])
            arc = came[node]
            steps.append((busy, arc))
            here[busy] = start[arc]
            busy = busy[here[busy] > root[busy]]
        length = np.bincount(np.concatenate([b for b, _ in steps]), minlength=count)
        path = np.zeros(int(length.sum()), np.int64)
        last = np.cumsum(length) - 1
        for k, (who, arc) in enumerate(steps):
            path[last[who] - k] = arc
        ids, per_arc = self._written(piece[path], codes, start[path] - np.repeat(np.arange(count), length))
        owner = np.repeat(np.arange(count), length)
        return ids, np.bincount(owner, per_arc, count).astype(np.int64), ahead[root + sizes], loss

    def _written(self, piece: np.ndarray, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of arcs, unknown characters as their bytes, and how many each has."""
        lost = np.flatnonzero(piece < 0)
        if not len(lost):
            return piece.astype(self.dtype), np.ones(len(piece), np.int64)
        kinds, back = np.unique(codes[at[lost]], return_inverse=True)
        spelled = [self._unknown(chr(c)) for c in kinds.tolist()]
        sizes = np.ones(len(piece), np.int64)
        sizes[lost] = np.array([len(w) for w in spelled])[back]
        first = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), self.dtype)
        out[first[piece >= 0]] = piece[piece >= 0]
        for k, word in enumerate(spelled):
            mine = first[lost[back == k]]
            for j, one in enumerate(word):
                out[mine + j] = one
        return out, sizes

    def _found(self, codes: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``_solved`` of any stretches of a text; very long ones would keep all others waiting and are searched alone."""
        small = sizes <= MOST_IN_STEP
        if small.all():
            return self._solved(codes[ranges(low, sizes)], sizes)
        ids, count = np.zeros(0, self.dtype), np.zeros(len(low), np.int64)
        score, loss = np.zeros(len(low)), np.zeros(len(low))
        if small.any():
            ids, count[small], score[small], loss[small] = self._solved(codes[ranges(low[small], sizes[small])], sizes[small])
        more = [self.search(codes[a : a + n].tobytes().decode("utf-32-le", "surrogatepass")) for a, n in zip(low[~small], sizes[~small], strict=True)]
        ids = np.concatenate([ids, *(np.array(m[0][1], self.dtype) for m in more)])
        count[~small], score[~small] = [len(m[0][1]) for m in more], [m[0][0] for m in more]
        loss[~small] = [m[0][0] - m[1][0] if len(m) > 1 else np.inf for m in more]
        order = np.argsort(~small, kind="stable")  # the long ones' ids stand last
        begin = np.zeros(len(low), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return ids[ranges(begin, count)], count, score, loss

    def _chosen(self, loss: np.ndarray, others) -> list[tuple[float, dict[int, bytes]]]:
        """The N best ways through a row of stretches: (loss, ids of the stretches that deviate); ``others(k)``: the k-th's ways but the best."""
        ways: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
        if self.best > 1 and len(loss):
            for k in _smallest(loss, min(len(loss), self.best - 1)).tolist():
                if np.isfinite(loss[k]):
                    more = [(total + lost, chosen | {k: alt}) for lost, alt in others(k) for total, chosen in ways]
                    ways = sorted([*ways, *more], key=lambda w: w[0])[: self.best]
        return ways

    def normalized(self, text: str) -> str:
        text = text.replace(" ", BLANK)
        return BLANK + text if self.dummy_prefix and text else text

    def stretches(self, bodies: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of normalized texts: (code points of all, stretches' starts and ends, first stretch of each text and the end)."""
        codes = code_points("".join(bodies))
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        edge = np.cumsum(sizes) - sizes
        kinds = self.kind[codes]
        cut = np.ones(len(codes), bool)
        cut[1:] = ~self.joined[kinds[:-1], kinds[1:]]
        cut[edge[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        return codes, starts, np.append(starts[1:], len(codes)), np.append(np.searchsorted(starts, edge), len(starts))

    def encode_many(self, texts: list[str | None]) -> Iterator[list[tuple[float, np.ndarray]]]:
        """The N best segmentations (score, ids) of each text, best first."""
        bodies = [self.normalized(t or "") for t in texts]
        codes, starts, ends, own = self.stretches(bodies)
        if not len(starts):
            yield from ([(0.0, np.zeros(0, self.dtype))] for _ in bodies)
            return
        number = self.parts.numbers(codes, starts, ends, lambda low, sizes: self._found(codes, low, sizes))
        ids, counts = self.parts.of(number)
        cuts = np.concatenate([[0], np.cumsum(counts)])
        scores, losses = self.parts.values
        score = np.bincount(np.repeat(np.arange(len(bodies)), np.diff(own)), scores[number], len(bodies)).tolist()
        loss = losses[number]
        whole = "".join(bodies)
        for k, (low, high) in enumerate(zip(own[:-1].tolist(), own[1:].tolist(), strict=True)):
            yield self._composed(score[k], ids, cuts[low : high + 1], loss[low:high], lambda j: self.others[whole[starts[low + j] : ends[low + j]]])  # noqa: B023

    def _composed(self, score: float, ids: np.ndarray, cuts: np.ndarray, loss: np.ndarray, others) -> list[tuple[float, np.ndarray]]:
        """The N best ways of a text whose stretches' best ids lie between ``cuts``."""
        out = []
        for total, chosen in self._chosen(loss, others):
            parts, low = [], cuts[0]
            for k in sorted(chosen):
                parts += [ids[low : cuts[k]], np.frombuffer(chosen[k], self.dtype)]
                low = cuts[k + 1]
            out.append((score - total, np.concatenate([*parts, ids[low : cuts[-1]]]) if parts else ids[cuts[0] : cuts[-1]]))
        return out

    def encode(self, text: str | None) -> list[tuple[float, np.ndarray]]:
        """The N best segmentations (score, ids) of a text, best first."""
        return next(self.encode_many([text]))

    def encode_alone(self, text: str) -> list[tuple[float, np.ndarray]]:
        """The same by searches of this text's own stretches, without what is remembered under hashes."""
        body = self.normalized(text)
        _, starts, ends, _ = self.stretches([body])
        found = [self.search(body[a:b]) for a, b in zip(starts, ends, strict=True)]
        ids = [np.array(f[0][1], self.dtype) for f in found]
        loss = np.array([f[0][0] - f[1][0] if len(f) > 1 else np.inf for f in found])
        ways = lambda j: [(found[j][0][0] - s, np.array(i, self.dtype).tobytes()) for s, i in found[j][1:]]
        return self._composed(sum(f[0][0] for f in found), np.concatenate([np.zeros(0, self.dtype), *ids]), np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64), loss, ways)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; bytes that are not UTF-8 become U+FFFD."""
        shown = self.shown
        raw = b"".join([shown[i] for i in ids.tolist()])
        return (raw[1:] if self.dummy_prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


    def encode_surely(self, texts: list[str | None]) -> Iterator[tuple[list[tuple[float, np.ndarray]], str]]:
        """The N best segmentations and the decoded best one; a text that it isn't goes another, slower way."""
        for body, ways in zip(texts, self.encode_many(texts), strict=True):
            back = self.decode(ways[0][1])
            if back != (body or "") and BLANK not in (body or ""):
                ways = self.encode_alone(body or "")
                back = self.decode(ways[0][1])
            yield ways, back


def _flat(path: tuple | None) -> tuple[int, ...]:
    ids: list[int] = []
    while path is not None:
        ids.extend(path[0])
        path = path[1]
    return tuple(ids)


def _smallest(loss: np.ndarray, few: int) -> np.ndarray:
    """Places of the smallest values, the first places among equals."""
    cut = np.partition(loss, few - 1)[few - 1]
    below, level = np.flatnonzero(loss < cut), np.flatnonzero(loss == cut)
    return np.concatenate([below, level[: few - len(below)]])


def codec(path: str, best: int) -> Codec:
    if (path, best) not in _CODECS:
        _CODECS[path, best] = Codec(path, best)
    return _CODECS[path, best]


RESULTS = {"n_pieces": "long", "ids_crc32": "long", "score": "double", "nbest_scores": "array<double>", "nbest_crc32": "array<long>", "decoded_sha256": "string", "round_trip": "boolean", "ids": "array<int>"}
_TYPES = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.string(), pa.bool_()]


def encode(df: DataFrame, model_path: str, *, text: str = "text", keep: list[str] | None = None, best: int = 4) -> DataFrame:
    """Adds to the columns ``keep`` (default: all but the text): n_pieces, ids_crc32, score, nbest_scores, nbest_crc32, decoded_sha256, round_trip, ids.

    ids: the best segmentation; the nbest columns: all N, best first. round_trip: whether decoding gives the text again
    (a text that holds U+2581 itself comes back with blanks).
    """
    keep = plain_names(df, [c for c in df.columns if c != text] if keep is None else keep, RESULTS)
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path, best)
        settle(model.others, model.parts)
        for batch in batches:
            for piece in pieces_of(batch, batch.num_columns - 1, CHUNK):
                rows, ids = [], []
                texts = piece.column(piece.num_columns - 1).to_pylist()
                for body, (ways, back) in zip(texts, model.encode_surely(texts), strict=True):
                    marks = [zlib.crc32(w[1].astype("<u4").tobytes()) for w in ways]
                    rows.append((len(ways[0][1]), marks[0], float(ways[0][0]), [float(w[0]) for w in ways], marks, hashlib.sha256(back.encode()).hexdigest(), back == (body or "")))
                    ids.append(ways[0][1])
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)), lists], names=[*keep, *RESULTS])

    return mapped(chosen, run, kept + ", ".join(f"{n} {t}" for n, t in RESULTS.items()))


def decode(df: DataFrame, model_path: str, *, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds ``text``, the decoded ids (null counts as none), to the columns ``keep`` (default: all but the ids)."""
    keep = plain_names(df, [c for c in df.columns if c != ids] if keep is None else keep, ["text"])
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("__ids"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path, 1)
        settle()
        for batch in batches:
            texts = [model.decode(np.array(i, np.int64)) for i in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "text"])

    return chosen.mapInArrow(run, kept + "text string")
