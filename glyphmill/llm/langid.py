"""Language identification: known words first, then character n-grams.

Words are runs of letters and the marks on them. A known word adds its smoothed log frequency in each language. An
unseen word is scored by its characters: at each place the longest known n-gram counts, from four characters down to
one. A text's score is the softmax of its mean evidence, as of at most ``EVIDENCE`` words, so that it stays below
certainty for short texts.

Learning reads at most about ``train_rows`` labelled rows (chosen by a hash of the key, all of them if there are
fewer); every word of theirs is kept, so the model's size is bounded by theirs. It is a few sorted arrays: words and
n-grams are named by 64-bit hashes, and each batch's distinct words are looked up together.

Defined cases: a null text, or one without a letter, gives ``und`` with score 0; with nothing to learn from, every
text gives ``und``; ties go to the language that sorts first; repeated rows are kept; an empty table gives no rows; a
text that exceeds ``CHUNK`` is a batch of its own; kept columns with the name of a result give way to it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import held_out, mapped, plain_names, sampled, settle
from glyphmill.llm.runs import Hashes, code_points, pieces_of, ranges

UNKNOWN = "und"
TRAIN_ROWS, LONGEST, EVIDENCE, FLOOR, LEAST_SCORE = 20_000, 4, 30, 0.5, 0.4
#: Bytes of text of a batch.
CHUNK = 1 << 19
_EDGE = 32  # a word's border within its n-grams
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """By code point: 2 for letters, 1 for marks, else 0."""
    if not _KINDS:
        import unicodedata

        _KINDS.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)], np.uint8))
    return _KINDS[0]


class Words:
    """The words of some texts: code points, each word's start, end and text, and the distinct ones by hash."""

    def __init__(self, texts: list[str | None]):
        bodies = [(t or "").lower() for t in texts]
        self.text = "\n".join(bodies) + "\n"
        self.codes = code_points(self.text)
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) + 1
        kind = kinds()[self.codes]
        inside = kind > 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            real = np.maximum.reduceat(kind, starts) > 1  # a mark alone is no word; what follows an end is a gap
            starts, ends = starts[real], ends[real]
        self.starts, self.ends = starts, ends
        self.doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
        self.hashes, self.first, self.back = np.unique(Hashes(self.codes).of(starts, ends), return_index=True, return_inverse=True)

    def distinct(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.starts[self.first].tolist(), self.ends[self.first].tolist(), strict=True)]


def edged(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a border on either side, one after the other: (code points, place within the word, number of the word)."""
    sizes = ends - starts + 2
    out = np.full(int(sizes.sum()), _EDGE, np.uint32)
    number = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(out)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[(place > 0) & (place < sizes[number] - 1)] = codes[ranges(starts, ends - starts)]
    return out, place, number


class Scores:
    """Log frequencies by language of some hashes, sorted; entries: (hash, place of the language, count)."""

    def __init__(self, hashes: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int):
        self.keys, at = np.unique(hashes, return_inverse=True)
        self.logs = np.full((len(self.keys), n_langs), FLOOR, np.float32)
        for k in range(n_langs):
            own = langs == k
            self.logs[:, k] += np.bincount(at[own], counts[own], len(self.keys)).astype(np.float32)
            self.logs[:, k] = np.log(self.logs[:, k]) - np.log(counts[own].sum() + FLOOR * max(1, len(self.keys)))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)


def entries(words: list[str], n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """What distinct words of one language add to its counts: (0, hashes, counts) of words, (size, hashes, counts) of n-grams."""
    codes = code_points("".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    yield 0, Hashes(codes).of(ends - sizes, ends), n
    flat, at, number = edged(codes, ends - sizes, ends)
    hashes = Hashes(flat)
    for size in range(1, LONGEST + 1):  # each word counts once in its language
        from_ = np.flatnonzero(at + size <= (sizes + 2)[number])
        yield size, *np.unique(hashes.of(from_, from_ + size), return_counts=True)


class Model:
    """Log frequencies by language of words and of character n-grams; entries: (kind, hash, language, count)."""

    def __init__(self, kind: np.ndarray, hashes: np.ndarray, langs: list[str], lang: np.ndarray, n: np.ndarray):
        order = sorted(range(len(langs)), key=langs.__getitem__)
        self.langs = [langs[k] for k in order]
        place = np.argsort(np.array(order, np.int64))[lang] if len(langs) else lang
        self.words, *self.grams = (Scores(hashes[kind == k], place[kind == k], n[kind == k], len(langs)) for k in range(LONGEST + 1))

    def unseen(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mean log frequencies over a word's places (after its first border) of the longest known n-gram that ends there."""
        flat, at, number = edged(codes, starts, ends)
        hashes = Hashes(flat)
        total = np.zeros((len(starts), len(self.langs)))
        todo = np.flatnonzero(at > 0)
        for size in range(LONGEST, 0, -1):
            reach = at[todo] + 1 >= size
            some = todo[reach]
            found = self.grams[size - 1].find(hashes.of(some - size + 1, some + 1))
            hit = found >= 0
            logs = self.grams[size - 1].logs[found[hit]]
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(number[some[hit]], logs[:, k], len(starts))
            todo = np.sort(np.concatenate([todo[~reach], some[~hit]]))
        return total / (ends - starts + 1)[:, None]

    def predict_many(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and its score of each text."""
        words = Words(texts)
        if not len(words.starts) or not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found = self.words.find(words.hashes)
        logs = np.empty((len(found), len(self.langs)))
        logs[found >= 0] = self.words.logs[found[found >= 0]]
        new = words.first[found < 0]
        logs[found < 0] = self.unseen(words.codes, words.starts[new], words.ends[new])
        count = np.bincount(words.doc, minlength=len(texts))
        z = np.stack([np.bincount(words.doc, logs[words.back, k], len(texts)) for k in range(len(self.langs))], 1)
        z *= (np.minimum(count, EVIDENCE) / np.maximum(count, 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), count.tolist(), strict=True)], np.where(count > 0, p[np.arange(len(p)), best], 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        langs, scores = self.predict_many([text])
        return langs[0], float(scores[0])


def learn(df: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Learns from the rows outside fold 0 that have a language."""
    rows = sampled(df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(key, text, lang), key, train_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for piece in pieces_of(batch, 0, CHUNK):
                names = np.array(piece.column(1).to_pylist(), object)
                bodies = np.array(piece.column(0).to_pylist(), object)
                for name in sorted(set(names.tolist())):
                    words = Words(bodies[names == name].tolist())
                    yield pa.record_batch([pa.array([name] * len(words.first), pa.string()), pa.array(words.distinct(), pa.string()), pa.array(np.bincount(words.back, minlength=len(words.first)))], ["lang", "word", "n"])

    counted = mapped(rows.select(F.col(text).cast("string"), F.col(lang).cast("string")), count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words, n = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
            for name in sorted(set(names.tolist())):
                own = names == name
                for kind, hashes, count in entries(words[own].tolist(), n[own]):
                    yield pa.record_batch([pa.array(np.full(len(hashes), kind, np.int32)), pa.array(hashes.view(np.int64)), pa.array([name] * len(hashes), pa.string()), pa.array(count, pa.int64())], ["kind", "hash", "lang", "n"])

    summed = mapped(counted, hashed, "kind int, hash long, lang string, n long").groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))
    got = summed.toArrow()  # the distinct words of train_rows rows and their n-grams, as numbers
    lang = got["lang"].combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
    return Model(got["kind"].to_numpy(), got["hash"].to_numpy().view(np.uint64), lang.dictionary.to_pylist(), lang.indices.to_numpy(), got["n"].to_numpy())


def identify(df: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its score, as ``names``, to the columns ``keep`` (default: all)."""
    spark = df.sparkSession
    keep = plain_names(df, df.columns if keep is None else keep, names)
    sent = spark.sparkContext.broadcast(model)  # bounded by the rows that were learned from
    chosen = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for piece in pieces_of(batch, batch.num_columns - 1, CHUNK):
                langs, scores = sent.value.predict_many(piece.column(piece.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    return mapped(chosen, run, f"{schema}{', ' if keep else ''}`{names[0]}` string, `{names[1]}` double")


def recognized(df: DataFrame, model: Model, *, text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is recognized with at least this score, with all their columns."""
    found = identify(df, model, text=text, names=("__lang", "__score"))
    return found.where((F.col("__lang") != UNKNOWN) & (F.col("__score") >= least)).drop("__lang", "__score")
