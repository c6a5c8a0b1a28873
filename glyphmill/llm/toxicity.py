"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

Features: densities of two insult lexicons, the nearness of second-person words to insults, shares of capitals, signs
and disguised words, and the length. The first lexicon is fixed (plain, disguised and spaced-out spellings); the second
holds words and word beginnings that labelled toxic documents have far more often than others. At most about
``train_rows`` labelled rows outside fold 0 are read (chosen by a hash of the key): folds 1 and 2 give the second
lexicon, folds 3 and 4 the trees, and a quarter of these the calibration alone.

Defined cases: null and empty texts have all features 0 and get a score like any other; with no labelled rows of both
classes every score is 0; a document with several labels takes the largest, and of several texts with one labelled key
one is learned from; repeated rows are kept; an empty table of documents gives no rows; texts are read whole, whatever
their length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import Memo, held_out, sampled, settle, written

#: Insults in English, German, French and Spanish.
LEXICON = frozenset(
    "idiot idiots idiotic stupid moron morons moronic loser losers pathetic scum worthless trash clown clowns disgusting dumb dumbass "
    "imbecile imbeciles fool fools foolish garbage vermin filth filthy pig pigs rat rats jerk jerks creep creeps freak freaks "
    "bastard bastards bitch bitches whore slut crap shit bullshit fuck fucking fucker asshole retard retarded cretin dimwit halfwit "
    "nitwit twat wanker prick dick cunt coward cowards degenerate degenerates parasite parasites lowlife scumbag "
    "dumm dummkopf blöd trottel depp arschloch scheiße abschaum versager schwein hurensohn ekelhaft wertlos "
    "connard connasse salaud salope merde débile crétin abruti ordure minable dégoûtant "
    "idiota idiotas estúpido estúpida imbécil imbéciles basura escoria inútil asqueroso patético payaso mierda cabrón puta pendejo gilipollas".split()
)
#: Words that address somebody.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
#: Signs that stand for letters in disguised words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"})

HIT, HIDDEN, SECOND, SHOUTED, MIXED, SINGLE = 1, 2, 4, 8, 16, 32
FEATURES = ("hits_log", "hit_share", "distinct_hits", "hidden_share", "hidden_log", "hits_near_you", "you_share", "capitals", "shouted", "exclamations", "questions", "signs", "mixed", "most_hits_in_60", "length_log", "learned_log", "learned_share", "learned_distinct", "learned_weight", "most_learned_in_60")
TRAIN_ROWS, NEAR, SPAN = 40_000, 6, 60
#: Lengths of word beginnings; a learned entry's least share of toxic documents, least count and least log ratio.
STARTS, LEAST_SHARE, LEAST_COUNT, LEAST_RATIO = range(3, 9), 0.01, 4, 2.5
_EDGE = ".,;:?\"'()[]{}<>«»„“”‚‘’…-–—#%&*$!"
_RUNS = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[\W_]+")
_BY_LENGTH: dict[int, list[str]] = {}
for _w in sorted(LEXICON):
    _BY_LENGTH.setdefault(len(_w), []).append(_w)


def word_class(token: str) -> int:
    """Bit flags of one blank-separated token."""
    bare = token.strip(_EDGE)
    low = bare.lower()
    flags = 0
    if low in LEXICON:
        flags |= HIT
    if low in SECOND_PERSON:
        flags |= SECOND
    if len(bare) > 2 and bare.isupper():
        flags |= SHOUTED
    if len(bare) == 1 and bare.isalpha():
        flags |= SINGLE
    if low and not low.isalpha() and any(c.isalpha() for c in low):
        if not low.replace("-", "").replace("'", "").replace("’", "").isalnum() or any(c.isdigit() for c in low):
            flags |= MIXED
    if not flags & HIT and len(low) > 2 and _hidden(token.strip(".,;:?\"'()").lower()):
        flags |= HIDDEN
    return flags


def _hidden(low: str) -> bool:
    """Whether it is a lexicon word with signs, digits, doubled letters or stars."""
    plain = _INNER.sub("", low.translate(LEET))
    if plain in LEXICON and plain != low:
        return True
    once = _RUNS.sub(r"\1", plain)
    if once != plain and (once in LEXICON or _RUNS.sub(r"\1\1", plain) in LEXICON):
        return True
    if "*" in low and not low.endswith("**") and sum(c.isalpha() for c in low) > 1:
        body = low.strip(".,;:!?")
        return any(all(a == b or a == "*" for a, b in zip(body, w, strict=True)) for w in _BY_LENGTH.get(len(body), ()))
    return False


def keys(word: str) -> list[str]:
    """What the learned lexicon may hold of a lower-case word: itself, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in STARTS if len(word) > n)]


class Reader:
    """Features of a text under a learned lexicon (entry -> weight)."""

    def __init__(self, learned: dict[str, float]):
        self.learned = learned
        self.memo: Memo | None = None

    def __getstate__(self):
        return {"learned": self.learned, "memo": None}

    @property
    def cache(self) -> Memo:
        if self.memo is None:
            self.memo = Memo(self._token, 250_000)
        return self.memo

    def _token(self, token: str) -> tuple[int, float]:
        word = token.strip(_EDGE).lower()
        return word_class(token), max((self.learned.get(k, 0.0) for k in keys(word)), default=0.0)

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * len(FEATURES)
        tokens = text.split()
        n = max(1, len(tokens))
        pairs = np.array(list(map(self.cache.__getitem__, tokens))).reshape(-1, 2)
        flags, weight = pairs[:, 0].astype(np.uint8), pairs[:, 1]
        bad, told = np.flatnonzero(flags & (HIT | HIDDEN)), np.flatnonzero(weight)
        n_hidden = int(np.count_nonzero(flags & HIDDEN))
        words = {tokens[i].strip(_EDGE).lower() for i in bad}
        single = (flags & SINGLE) > 0
        spaced = 0
        if len(tokens) > 3 and np.any(single[3:] & single[2:-1] & single[1:-2] & single[:-3]):
            for run in re.findall(r"(?:\b[^\W\d_][ .\-_]+){3,}[^\W\d_]\b", text):
                spaced += _INNER.sub("", run).lower() in LEXICON
        hits = len(bad) + spaced
        raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        size = max(1, len(text))
        letters = max(1, int(raw[65:91].sum() + raw[97:123].sum()))
        signs = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
        return [
            math.log1p(hits), hits / n, float(len(words) + spaced), (n_hidden + spaced) / n, math.log1p(n_hidden + spaced), _near(bad, np.flatnonzero(flags & SECOND)), np.count_nonzero(flags & SECOND) / n,
            float(raw[65:91].sum()) / letters, np.count_nonzero(flags & SHOUTED) / n, raw[33] / size, raw[63] / size, signs / size, np.count_nonzero(flags & MIXED) / n, _densest(bad), math.log1p(len(tokens)),
            math.log1p(len(told)), len(told) / n, float(len({tokens[i].strip(_EDGE).lower() for i in told})), float(weight.sum()) / n, _densest(told),
        ]


def _near(bad: np.ndarray, you: np.ndarray) -> float:
    """The share of insults with a second-person word close by."""
    if not len(bad) or not len(you):
        return 0.0
    at = np.searchsorted(you, bad)
    gap = np.minimum(np.abs(bad - you[np.minimum(at, len(you) - 1)]), np.abs(bad - you[np.maximum(at - 1, 0)]))
    return float((gap <= NEAR).mean())


def _densest(at: np.ndarray) -> float:
    return float((np.searchsorted(at, at + SPAN) - np.arange(len(at))).max()) if len(at) else 0.0


class Boosted:
    """Boosted regression trees on binned features, logistic loss, complete trees of a fixed depth."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, least: int = 20, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins + 1)[1:-1])) if len(np.unique(x[:, j])) > 1 else np.array([0.0]) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        width = self.bins + 1
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first = 2**level - 1
                self._split(codes, cuts, node, grad, hess, first, width, feature, cut)
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            g, h = np.bincount(leaf, grad, 2**self.depth), np.bincount(leaf, hess, 2**self.depth)
            value = self.rate * g / (h + self.ridge)
            self.nodes.append((feature, cut, value))
            raw += value[leaf]
        return self

    def _split(self, codes, cuts, node, grad, hess, first, width, feature, cut) -> None:
        """The best split of each node of a level."""
        count = first + 1
        local = node - first
        best = np.full(count, 1e-6)
        for j in range(codes.shape[1]):
            at = local * width + codes[:, j]
            g, h, n = (np.bincount(at, w, count * width).reshape(count, width).cumsum(1) for w in (grad, hess, None))
            gl, hl, nl = g[:, :-1], h[:, :-1], n[:, :-1]
            gr, hr, nr = g[:, -1:] - gl, h[:, -1:] - hl, n[:, -1:] - nl
            gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
            gain[(nl < self.least) | (nr < self.least)] = 0
            k = gain[:, : len(cuts[j])].argmax(1)
            found = gain[np.arange(count), k]
            for i in np.flatnonzero(found > best):
                best[i], feature[first + i], cut[first + i] = found[i], j, cuts[j][k[i]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.nodes:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots of a rising function (mean score and mean label of each pool)."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        pools.append([s, float(v), 1.0])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            s2, v2, n2 = pools.pop()
            pools[-1][0] = (pools[-1][0] * pools[-1][2] + s2 * n2) / (pools[-1][2] + n2)
            pools[-1][1] += v2
            pools[-1][2] += n2
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Scorer:
    """Trees and calibration; without any, every score is 0."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        self.trees = None
        learn = ~calibrate
        if len(y) and len(set(y[learn])) == 2:
            self.trees = Boosted().fit(x[learn], y[learn])
            held = calibrate if len(set(y[calibrate])) == 2 else learn
            self.knots = isotonic(self.trees.raw(x[held]), y[held])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(x))
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)


def _counted(rows: DataFrame, wanted: frozenset | None) -> DataFrame:
    """Documents by entry of the learned lexicon; all entries, or only the wanted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        seen: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["entry", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = {k for w in {t.strip(_EDGE).lower() for t in (text or "").split()} if w for k in keys(w)}
                seen.update(own if wanted is None else own & wanted)
                if len(seen) > 300_000:
                    yield flush()
        yield flush()

    return rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))


def learned_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries over-represented in toxic rows (text, label), with their log ratio; at most average entries / least share."""
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return {}
    least = max(LEAST_COUNT, LEAST_SHARE * sizes[1])
    toxic = {r["entry"]: r["n"] for r in _counted(rows.where("label = 1"), None).where(F.col("n") >= least).collect()}
    other = {r["entry"]: r["n"] for r in _counted(rows.where("label = 0"), frozenset(toxic)).collect()}
    ratio = {k: math.log((n + 0.5) / sizes[1]) - math.log((other.get(k, 0) + 0.5) / sizes[0]) for k, n in toxic.items()}
    return {k: v for k, v in ratio.items() if v >= LEAST_RATIO}


def feature_table(df: DataFrame, reader: Reader, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(reader)  # bounded by the least share of an entry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle(sent.value.cache)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([sent.value.features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "features"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, features array<double>")


def toxicity(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of every document."""
    spark = df.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where(F.col(label).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    few = written(sampled(known, "doc_id", train_rows).withColumn("fold", fold), "toxicity-labels")
    bodies = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    first = bodies.join(F.broadcast(few.where("fold in (1, 2)")), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text"))
    first = written(first.select("text", "label"), "toxicity-texts")  # a text for each of at most train_rows keys
    table = written(feature_table(df, Reader(learned_lexicon(first)), key=key, text=text), "toxicity-features")
    rows = table.join(F.broadcast(few.where("fold in (3, 4)")), "doc_id").groupBy("doc_id", "label").agg(F.max("features").alias("features"))  # a row for each key
    rows = sorted(rows.select("doc_id", "features", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0).alias("calibrate")).collect(), key=lambda r: r["doc_id"])
    x = np.array([r["features"] for r in rows]).reshape(-1, len(FEATURES))
    scorer = Scorer(x, np.array([r["label"] for r in rows], np.int64), np.array([r["calibrate"] for r in rows], bool))
    sent = spark.sparkContext.broadcast(scorer)  # a fixed number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist()).reshape(-1, len(FEATURES))
            yield pa.record_batch([batch.column(0), pa.array(sent.value.score(x))], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
