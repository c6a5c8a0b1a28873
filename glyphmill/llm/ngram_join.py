"""Self join on the Jaccard similarity of word n-gram sets, with adaptive multi-match prefixes.

Two sets that link share at least ceil(t * size) n-grams, so under any common order of all n-grams their prefixes of
size - ceil(t * size) + L share at least L. Each document picks the L of the least estimated cost (what its prefix
would touch, and how many candidates can share L of it); a pair must share as many prefix n-grams as the smaller L.

1. Sieve: under the order of hashes, every document's prefix is counted over the whole corpus. Documents without
   enough n-grams that occur twice are done.
2. Equal sets become one; what is left links to the first document that shares one of its least hashes, and the
   checked links give first groups. Pairs within a group need no search.
3. Join: for the n-grams that occur in several groups, ordered by document frequency, prefixes are chosen and joined.
   Of the n-grams that two documents share, only the L-th hands the pair on, so each pair comes once. Long lists are
   split into blocks that meet in separate tasks.
4. Candidates are checked on their whole sets; links give components.

N-grams are 64-bit hashes. Rows are keyed by doc_id; several rows of one doc_id count as one document that links when
any of its texts links (each row has its own n_shingles). Null, empty or blank texts have no n-grams and link with
nothing; texts with fewer words than n have one n-gram, the whole sequence; null doc_ids are one document. Empty
tables give empty results; texts of any length have all their n-grams, a packed list a document; other columns are
ignored, whatever their names, and kept by ``one_of_each``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.blobs import Packer, exchanged, gathered, joined, mix, schema_of, spread
from glyphmill.llm.common import Memo, MOST_BROADCAST, mapped, partitions, settle, without, written
from glyphmill.llm.components import components

NULL_ID = -(2**63)
CHUNK, MANY = 512, 0xFFFF
#: Hashes that look for a first link; choices of L; cost of a candidate's check per n-gram, against one list entry.
FIRST, MOST_L, CHECK_COST = 6, 8, 0.1
BLOCK = 1024
#: Lists of at least so many members check their pairs on the spot.
LONG_LIST = 24
#: Bytes of packed rows that wait to be sent; cells of one table of members and n-grams.
WAITING, CELLS = 1 << 21, 1 << 22
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORDS = Memo(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), 200_000)
_ODD = [np.uint64(int.from_bytes(hashlib.blake2b(b"place %d" % k, digest_size=8).digest(), "little") | 1) for k in range(64)]


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(n, len(ids))
    total = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        total = mix(total ^ ids[k : len(ids) - width + 1 + k] * _ODD[k % 64])
    return np.unique(total.view(np.int64))


def overlap(size, percent: int):
    """The least number of shared n-grams of a set of this size with any set it links to."""
    return -(-percent * size // 100)


def linked(shared: Column, size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (size_a + size_b - shared)


# --- 1. sieve -------------------------------------------------------------------------------------------------

_SIEVE = {"token": {"tokens": "<i8", "at": "<u2", "docs": "<i8"}, "doc": {"docs": "<i8", "sizes": "<i4", "need": "<i4", "seen": "<i4", "marks": "S16"}, "count": {"docs": "<i8", "seen": "<i4"}}


def sieve(df: DataFrame, n: int, percent: int, parts: int) -> DataFrame:
    """Rows (doc_id, n_shingles, mark, alive) of every row; mark: equal for equal sets; not alive: links with no other set."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(_WORDS)
        out = Packer(_SIEVE)
        for batch in batches:
            for cut in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(cut, CHUNK)
                docs = np.array(piece.column(0).to_pylist(), np.int64)
                sets = [shingles(t, n) for t in piece.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                free = sizes - overlap(sizes, percent)
                prefix = np.minimum(sizes, free + np.maximum(1, sizes * 15 // 100))
                tokens = np.concatenate([s[:p] for s, p in zip(sets, prefix, strict=True)])
                owner = np.repeat(np.arange(len(sets)), prefix)
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                first = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, bool)
                group = np.cumsum(first) - 1
                many = np.bincount(group)[group] > 1 if len(tokens) else first
                seen = np.bincount(owner[many], minlength=len(sets))
                keep = first | ~many  # an n-gram that is repeated here goes out once
                sent, at = tokens[keep], np.where(many, MANY, owner)[keep]
                target = spread(mix(sent), parts)
                order = np.argsort(target, kind="stable")
                sent, at, target = sent[order], at[order], target[order]
                cuts = np.flatnonzero(np.diff(target)) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(sent)], strict=True) if len(sent) else ():
                    own = at[lo:hi]
                    used, local = np.unique(own[own != MANY], return_inverse=True)
                    places = np.full(len(own), MANY, "<u2")
                    places[own != MANY] = local
                    out.one("token", int(target[lo]), {"tokens": sent[lo:hi].astype("<i8").tobytes(), "at": places.tobytes(), "docs": docs[used].astype("<i8").tobytes()})
                marks = np.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest().replace(b"\0", b"\1") for s in sets], "S16")
                out.add("doc", spread(mix(docs), parts), {"docs": docs, "sizes": sizes, "need": prefix - free, "seen": seen, "marks": marks})
                yield out.flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, _SIEVE)
        out = Packer(_SIEVE)
        t = got["token"]
        tokens = joined(t["tokens"], "<i8")
        alone = np.concatenate([a != MANY for a in t["at"]]) if t["at"] else np.zeros(0, bool)
        docs = np.concatenate([np.append(d, 0)[np.where(a == MANY, len(d), a)] for a, d in zip(t["at"], t["docs"], strict=True)]) if t["at"] else np.zeros(0, np.int64)
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        group = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])]) if len(ranked) else np.zeros(0, np.int64)
        times = np.bincount(group, np.where(alone[order], 1, 2)) if len(ranked) else np.zeros(0)
        hit = docs[order][(times[group] > 1) & alone[order]] if len(ranked) else docs
        who, seen = np.unique(hit, return_counts=True)
        out.add("count", spread(mix(who), parts), {"docs": who, "seen": seen})
        d = got["doc"]
        for k in range(len(d["docs"])):
            own = {c: d[c][k] for c in _SIEVE["doc"]}
            out.add("doc", spread(mix(own["docs"]), parts), own)
        yield out.flush()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, _SIEVE)
        d = {c: joined(got["doc"][c], t) for c, t in _SIEVE["doc"].items()}
        who, seen = joined(got["count"]["docs"], "<i8"), joined(got["count"]["seen"], "<i4")
        names, back = np.unique(np.concatenate([d["docs"], who]), return_inverse=True)
        total = np.bincount(back, np.concatenate([d["seen"], seen]), len(names))
        alive = (total[back[: len(d["docs"])]] >= d["need"]) & (d["sizes"] > 0)
        yield pa.record_batch([pa.array(d["docs"], pa.int64()), pa.array(d["sizes"].astype(np.int64)), pa.array([m.ljust(16, b"\1") if s else None for m, s in zip(d["marks"].tolist(), d["sizes"], strict=True)], pa.binary()), pa.array(alive)], ["doc_id", "n_shingles", "mark", "alive"])

    dealt = mapped(df, deal, schema_of(_SIEVE))
    counted = exchanged(dealt, parts, count, schema_of(_SIEVE))
    return exchanged(counted, parts, judge, "doc_id long, n_shingles long, mark binary, alive boolean")


# --- 3. n-grams that several groups share -----------------------------------------------------------------------

_SHARED = {"token": {"tokens": "<i8", "docs": "<i8", "groups": "<i8"}, "doc": {"docs": "<i8", "groups": "<i8", "sizes": "<i4", "l": "<i4"}, "found": {"docs": "<i8", "tokens": "<i8", "times": "<i4"}}
_SETS = "doc_id long, group long, size int, l int, tokens array<long>, times array<int>"
_PREFIXES = _SETS + ", all array<long>"


def shared_by_groups(sets: DataFrame, parts: int, then=None, schema: str = _SETS) -> DataFrame:
    """Of rows (doc_id, group, size, l, tokens) the tokens that occur in several groups, with their number of rows.

    ``then``: a map of the resulting batches to rows of ``schema``, run in the same Python worker.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(_SHARED)
        for batch in batches:
            for cut in range(0, batch.num_rows, CHUNK):
                piece = batch.slice(cut, CHUNK)
                docs, groups, sizes, level = (piece.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                lengths = piece.column(4).value_lengths().to_numpy(zero_copy_only=False)
                tokens = piece.column(4).flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(len(docs)), lengths)
                out.add("token", spread(mix(tokens), parts), {"tokens": tokens, "docs": docs[owner], "groups": groups[owner]})
                out.add("doc", spread(mix(docs), parts), {"docs": docs, "groups": groups, "sizes": sizes, "l": level})
                yield out.flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, _SHARED)
        tokens, docs, groups = (joined(got["token"][c], t) for c, t in _SHARED["token"].items())
        out = Packer(_SHARED)
        order = np.lexsort((groups, tokens))
        tokens, docs, groups = tokens[order], docs[order], groups[order]
        if len(tokens):
            new = np.concatenate([[True], tokens[1:] != tokens[:-1]])
            other = np.concatenate([[True], new[1:] | (groups[1:] != groups[:-1])])
            at = np.cumsum(new) - 1
            several = np.bincount(at, other)[at] > 1
            times = np.bincount(at)[at]
            out.add("found", spread(mix(docs[several]), parts), {"docs": docs[several], "tokens": tokens[several], "times": times[several]})
        for k in range(len(got["doc"]["docs"])):
            own = {c: got["doc"][c][k] for c in _SHARED["doc"]}
            out.add("doc", spread(mix(own["docs"]), parts), own)
        yield out.flush()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = gathered(batches, _SHARED)
        d = {c: joined(got["doc"][c], t) for c, t in _SHARED["doc"].items()}
        docs, tokens, times = (joined(got["found"][c], t) for c, t in _SHARED["found"].items())
        order = np.argsort(docs, kind="stable")
        docs, tokens, times = docs[order], tokens[order], times[order]
        lo, hi = np.searchsorted(docs, d["docs"], "left"), np.searchsorted(docs, d["docs"], "right")
        for cut in range(0, len(lo), 2000):
            some = slice(cut, cut + 2000)
            n = hi[some] - lo[some]
            take = np.concatenate([np.arange(a, b) for a, b in zip(lo[some], hi[some], strict=True)]).astype(np.int64) if n.sum() else np.zeros(0, np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.record_batch([pa.array(d["docs"][some]), pa.array(d["groups"][some]), pa.array(d["sizes"][some]), pa.array(d["l"][some]), pa.ListArray.from_arrays(ends, pa.array(tokens[take])), pa.ListArray.from_arrays(ends, pa.array(times[take]))], ["doc_id", "group", "size", "l", "tokens", "times"])

    dealt = mapped(sets.select("doc_id", "group", "size", "l", "tokens"), deal, schema_of(_SHARED))
    finish = (lambda batches: then(collect(batches))) if then else collect
    return exchanged(exchanged(dealt, parts, count, schema_of(_SHARED)), parts, finish, schema)


def choose_prefix(tokens: np.ndarray, times: np.ndarray, size: int, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """L and the prefix (tokens and times, rarest first) of one set, of whose n-grams only the given ones are shared.

    Estimated cost of an L: the list entries that the prefix touches, and a check of all the candidates that can share
    L of them, at most entries / L.
    """
    order = np.lexsort((tokens, times))
    tokens, times = tokens[order], times[order]
    free = size - overlap(size, percent) - (size - len(tokens))  # n-grams of no other group come first in the order
    if free + 1 > len(tokens) or free < 0:
        return 1, tokens[: max(0, free + 1)], times[: max(0, free + 1)]
    most = min(MOST_L, len(tokens) - free)
    touched = np.cumsum(times)[free : free + most]
    levels = np.arange(1, most + 1)
    level = int(levels[(touched + CHECK_COST * size * touched / levels).argmin()])
    return level, tokens[: free + level], times[: free + level]


def prefixes(percent: int):
    """Map of batches of ``shared_by_groups`` to rows with the tokens of the prefix, and all of them; rows that can link with nothing go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                tokens, times = (np.asarray(batch.column(k)[r].values) for k in (4, 5))
                size = batch.column(2)[r].as_py()
                if len(tokens) >= overlap(size, percent):
                    level, some, often = choose_prefix(tokens, times, size, percent)
                    if len(some) >= level:
                        rows.append((batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), size, level, some, often, tokens))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())), strict=True)], ["doc_id", "group", "size", "l", "tokens", "times", "all"])

    return run


_LISTS = {"list": {"key": "<i8", "tokens": "<i8", "lengths": "<i4", "at": "<i4", "docs": "<i8", "groups": "<i8", "sizes": "<i4", "l": "<i4", "side": "<i4", "long": "<i4"}, "set": {"docs": "<i8", "whole": "<i8"}}


def candidates(prefix: DataFrame, percent: int, parts: int, block: int = BLOCK, long_list: int = LONG_LIST) -> DataFrame:
    """Rows (a, b, sure): pairs of different groups that share at least the smaller L prefix n-grams and can link by their sizes.

    Of members of a list of ``long_list`` or more all shared n-grams are sent along, once for each partition: their
    pairs are checked on the spot, and only links (sure) go on, so that a large group of texts that are alike but not
    linked makes no rows. Lists of more than ``block`` members are split into blocks.

    ``prefix``: the chosen prefixes. Tokens that only one group has in a prefix are left out first; a document with
    none left has no candidates (one with fewer than its L may still meet others of a smaller L).
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = Packer(_LISTS), 0
        for batch in batches:
            for row in range(batch.num_rows):
                doc, group, size, level, tokens, times, every = (c[row] for c in batch.columns)
                doc, group, size, level = doc.as_py(), group.as_py(), size.as_py(), level.as_py()
                tokens, times, every = np.asarray(tokens.values, np.int64), np.asarray(times.values, np.int64), np.asarray(every.values, np.int64)
                order = np.lexsort((tokens, times))
                tokens, times = tokens[order], times[order]
                common = {"docs": np.int64(doc).tobytes(), "groups": np.int64(group).tobytes(), "sizes": np.int32(size).tobytes(), "l": np.int32(level).tobytes()}
                checks = set()
                for at in range(len(tokens)):
                    blocks = -(-int(times[at]) // block)
                    own = int(mix(np.array([doc]))[0] % np.uint64(blocks))
                    is_long = times[at] >= long_list
                    for other in range(blocks):
                        low, high = min(own, other), max(own, other)
                        key = int(mix(np.array([tokens[at] + low * 1_000_003 + high * 7_919], np.int64)).view(np.int64)[0]) if blocks > 1 else int(tokens[at])
                        target = int(spread(mix(np.array([key])), parts)[0])
                        out.one("list", target, common | {"key": np.int64(key).tobytes(), "tokens": tokens[: at + 1].tobytes(), "lengths": np.int32(at + 1).tobytes(), "at": np.int32(at).tobytes(), "side": np.int32(own - low if low != high else -1).tobytes(), "long": np.int32(is_long).tobytes()})
                        held += 8 * (at + 1) + 100
                        if is_long:
                            checks.add(target)
                for target in checks:
                    out.one("set", target, {"docs": common["docs"], "whole": every.tobytes()})
                    held += every.nbytes + 100
                if held > WAITING:
                    yield out.flush()
                    held = 0
        yield out.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = gathered(batches, _LISTS)
        got = both["list"]
        whole_of = {int(d[0]): w for d, w in zip(both["set"]["docs"], both["set"]["whole"], strict=True)}
        key, docs, groups, sizes, level, side, long_ = (joined(got[c], _LISTS["list"][c]) for c in ("key", "docs", "groups", "sizes", "l", "side", "long"))
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        rows: list[tuple[int, int, bool]] = []
        for members in np.split(order, cuts):
            if len(members) < 2 or (groups[members] == groups[members[0]]).all():
                continue
            found = _pairs([got["tokens"][m] for m in members], docs[members], groups[members], sizes[members], level[members], side[members], percent)
            sure = bool(long_[members[0]])
            rows += [(a, b, sure) for a, b in (_links(found, {int(docs[m]): (whole_of[int(docs[m])], int(sizes[m])) for m in members}, percent) if sure else found)]
        a, b, c = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.bool_())], ["a", "b", "sure"])

    again = shared_by_groups(prefix, parts).where("size(tokens) > 0")
    dealt = again.join(prefix.select("doc_id", "all"), "doc_id").select("doc_id", "group", "size", "l", "tokens", "times", "all")
    dealt = mapped(dealt, deal, schema_of(_LISTS))
    return exchanged(dealt, parts, meet, "a long, b long, sure boolean").distinct()


def _links(pairs: list[tuple[int, int]], whole: dict[int, tuple[np.ndarray, int]], percent: int) -> list[tuple[int, int]]:
    """Those of the pairs that link; documents of different groups share only n-grams of their whole lists."""
    if not pairs:
        return []
    used = sorted({d for pair in pairs for d in pair})
    row = {d: k for k, d in enumerate(used)}
    lists = [whole[d][0] for d in used]
    names, where = np.unique(np.concatenate(lists), return_inverse=True)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    a, b = (np.array([row[d] for d in side]) for side in zip(*pairs, strict=True))
    shared = np.zeros(len(pairs), np.int64)
    for low in range(0, len(names), 4096):  # some n-grams at a time, so that the table stays small
        table = np.zeros((len(lists), min(4096, len(names) - low)), np.float32)
        some = (where >= low) & (where < low + 4096)
        table[owner[some], where[some] - low] = 1
        common = table @ table.T
        shared += common[a, b].astype(np.int64)
    size = np.array([whole[d][1] for d in used])
    ok = 100 * shared >= percent * (size[a] + size[b] - shared)
    return [pair for pair, good in zip(pairs, ok.tolist(), strict=True) if good]


def _pairs(lists: list[np.ndarray], docs, groups, sizes, level, side, percent: int) -> list[tuple[int, int]]:
    """Pairs of one n-gram's list for which it is the L-th one in common."""
    names, where = np.unique(np.concatenate(lists), return_inverse=True)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    often = np.bincount(where)
    used = often[where] > 1
    owner, column = owner[used], (np.cumsum(often > 1) - 1)[where[used]]
    width = int((often > 1).sum())
    wide = max(64, CELLS // len(lists))  # n-grams of a table at a time
    out = []
    for cut in range(0, len(lists), 512):
        some = np.arange(cut, min(cut + 512, len(lists)))
        common = np.zeros((len(some), len(lists)), np.int32)
        for low in range(0, width, wide):
            table = np.zeros((len(lists), min(wide, width - low)), np.float32)
            mine = (column >= low) & (column < low + wide)
            table[owner[mine], column[mine] - low] = 1
            common += (table[some] @ table.T).astype(np.int32)
        ok = common == np.minimum(level[some][:, None], level[None, :])
        ok &= (groups[some][:, None] != groups[None, :]) & (docs[some][:, None] < docs[None, :])
        ok &= (100 * np.minimum(sizes[some][:, None], sizes[None, :]) >= percent * np.maximum(sizes[some][:, None], sizes[None, :])) & ((side[some][:, None] != side[None, :]) | (side[some][:, None] < 0))
        i, j = np.nonzero(ok)
        out += list(zip(docs[some[i]].tolist(), docs[j].tolist(), strict=True))
    return out


# --- the join ---------------------------------------------------------------------------------------------------


def checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    left, right = (sets.select(F.col("doc_id").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.where(linked(shared, F.size("ta"), F.size("tb"), percent)).select("a", "b").distinct()


def first_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links of each document with the first ones that share one of its least hashes."""
    few = sets.select("doc_id", F.explode(F.slice("tokens", 1, FIRST)).alias("token"))
    lead = few.groupBy("token").agg(F.min("doc_id").alias("a"))
    pairs = few.join(lead, "token").where("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct()
    return checked(pairs, sets, percent)


def similar(df: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, parts: int | None = None, every: bool = False, block: int = BLOCK, long_list: int = LONG_LIST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links): rows (doc_id, n_shingles, mark) of every row; (mark, lead) of every set; links (a, b) between leads.

    The links span every component; those within a first group are not all listed, unless ``every`` asks for all links
    (as many as the square of a group's size, then).
    """
    spark = df.sparkSession
    parts = parts or partitions(spark)
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = written(sieve(rows, n, percent, parts), "join-docs")
    classes = docs.where("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("lead"))
    alive = docs.where("alive").groupBy("mark").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(_WORDS)
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "tokens"])

    alive = written(alive, "join-alive")
    if alive.count() <= MOST_BROADCAST:
        alive = F.broadcast(alive)
    sets = written(mapped(rows.join(alive, "doc_id", "left_semi"), whole, "doc_id long, tokens array<long>"), "join-sets")
    stars = sets.sparkSession.createDataFrame([], "a long, b long") if every else written(first_links(sets, percent), "join-stars")
    grouped = sets.join(components(stars).toDF("doc_id", "group"), "doc_id", "left").select("doc_id", F.coalesce("group", "doc_id").alias("group"), F.size("tokens").alias("size"), F.lit(1).alias("l"), "tokens")
    chosen = written(shared_by_groups(grouped, parts, prefixes(percent), _PREFIXES), "join-prefixes")
    pairs = written(candidates(chosen, percent, parts, block, long_list), "join-pairs")
    found = checked(pairs.where("not sure").select("a", "b"), sets, percent).union(pairs.where("sure").select("a", "b"))
    return docs, classes, stars.union(found).distinct()


def all_links(df: DataFrame, **options) -> DataFrame:
    """Rows (a, b), a before b, of all pairs of different sets that link, each set by its smallest doc_id; options as of ``similar``.

    Rows with equal sets are one class (``join_components`` names it); its members link with each other and with
    whatever their class links with. A null doc_id comes first.
    """
    links = similar(df, every=True, **options)[2]
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID)).alias(c)
    return links.select(real("a"), real("b"))


def join_components(df: DataFrame, **options) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class_id) of every row; options as of ``similar``.

    class_id: the smallest doc_id with an equal set.
    """
    docs, classes, links = similar(df, **options)
    known = classes.join(components(links).withColumnRenamed("node", "lead"), "lead", "left").select("mark", F.col("lead").alias("class_id"), F.coalesce("component", "lead").alias("component_id"))
    found = docs.select("doc_id", "n_shingles", "mark").join(known, "mark", "left")
    real = lambda c: F.nullif(F.col(c), F.lit(NULL_ID)).alias(c)
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id")).select(real("doc_id"), "n_shingles", real("component_id"), real("class_id"))


def one_of_each(df: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """The rows whose document is the smallest of its component, with all their columns."""
    found = join_components(df, key=key, **options)
    gone = found.where("not (doc_id <=> component_id)").select("doc_id")
    return without(df, key, gone, "join-gone")
