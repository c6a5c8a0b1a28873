"""Quality by compression: how many bits a byte of text costs under a dictionary of bad texts, less those under one of good ones.

Two zstandard dictionaries are built from blocks of labelled texts. A text is compressed block by block under each of
them, from its first byte to its last, so that the evidence of a long text is that of all its blocks and not what the
compressor has learned from the text itself. The difference of the compressed sizes by the text's size is its evidence;
a rising function, fitted on other labelled texts, turns it into the probability of label 1.

At most about ``train_rows`` labelled rows outside fold 0 are read (chosen by a hash of the key, one text for each key):
folds 1 and 2 give the dictionaries, at most about ``train_blocks`` blocks of each label (chosen by a hash of key and
place), folds 3 and 4 the calibration.

Defined cases: a null text is an empty one; an empty text has no evidence, and its score is the share of label 1 among
the calibrated; with no dictionary text of both labels, or nothing to calibrate on, every score is the share of label 1
among the labelled rows that were read (0.5 if there are none); a document with several labels takes the largest; of
several texts of a labelled key the largest is learned from; repeated rows are kept, each with the score of its own
text; an empty table of documents gives no rows; texts are read whole, whatever their length; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import held_out, sampled, settle, written
from glyphmill.llm.runs import pieces_of
from glyphmill.llm.toxicity import isotonic

TRAIN_ROWS, TRAIN_BLOCKS = 20_000, 4_000
#: Bytes that are compressed on their own, bytes of a dictionary, level of compression.
BLOCK, DICTIONARY, LEVEL = 1024, 112_640, 3
#: From this score on the label is 1.
GOOD = 0.3
#: Calibrated texts that are averaged before the rising fit.
POOL = 20
#: Bytes of text of a batch.
CHUNK = 1 << 20


def blocks_of(body: bytes) -> list[bytes]:
    return [body[at : at + BLOCK] for at in range(0, len(body), BLOCK)]


def dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary; the blocks themselves where they are too few or too alike to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[:DICTIONARY]


class Compressors:
    """Compressed sizes under two dictionaries (of label 0 and of label 1)."""

    def __init__(self, bodies: tuple[bytes, bytes]):
        self.bodies = bodies
        self.own: list[zstandard.ZstdCompressor] = []

    def __getstate__(self):
        return {"bodies": self.bodies, "own": []}

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not self.own:
            for body in self.bodies:
                known = zstandard.ZstdCompressionDict(body)
                known.precompute_compress(level=LEVEL)
                self.own.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self.own

    def evidence(self, bodies: list[bytes]) -> np.ndarray:
        """Compressed bytes under the first dictionary less those under the second, by the text's bytes; 0 for empty texts."""
        bad, good = (c.compress for c in self._compressors())
        out = np.zeros(len(bodies))
        for k, body in enumerate(bodies):
            if body:
                out[k] = sum(len(bad(b)) - len(good(b)) for b in blocks_of(body)) / len(body)
        return out


class Model:
    """Dictionaries and calibration; without them every score is the share of label 1."""

    def __init__(self, compressors: Compressors | None, evidence: np.ndarray, labels: np.ndarray, share: float):
        self.compressors, self.share = compressors, share
        self.knots: tuple[np.ndarray, np.ndarray] | None = None
        if compressors is not None and len(labels):
            self.share = float(labels.mean())
            self.knots = calibration(evidence, labels)

    def score(self, bodies: list[bytes]) -> np.ndarray:
        if self.knots is None or self.compressors is None:
            return np.full(len(bodies), self.share)
        known = np.interp(self.compressors.evidence(bodies), *self.knots)
        return np.clip(np.where(np.fromiter(map(len, bodies), np.int64, len(bodies)) > 0, known, self.share), 0.0, 1.0)


def calibration(evidence: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising fit; texts are averaged ``POOL`` at a time before, so that no single one sets an end to 0 or 1."""
    order = np.argsort(evidence, kind="stable")
    groups = np.array_split(order, max(1, len(order) // POOL))
    means = [(evidence[g].mean(), labels[g].mean()) for g in groups if len(g)]
    return isotonic(np.array([m[0] for m in means]), np.array([m[1] for m in means]))


def bodies_of(column: pa.Array) -> list[bytes]:
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def _chosen_blocks(texts: DataFrame, most: int) -> dict[int, list[bytes]]:
    """About ``most`` blocks of the texts (doc_id, text, label) of each label, in the order of doc_id and place."""
    sizes = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.sum(F.ceil(F.octet_length("text") / BLOCK)).alias("n")).collect()}
    bound = {label: int((1 << 32) * min(1.0, most / max(1, n or 0))) for label, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces_of(batch, 1, CHUNK)):
            rows = []
            for key, body, label in zip(piece.column(0).to_pylist(), bodies_of(piece.column(1)), piece.column(2).to_pylist(), strict=True):
                for place, block in enumerate(blocks_of(body)):
                    if zlib.crc32(f"{key}:{place}".encode()) < bound[label]:
                        rows.append((key, place, label, block))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["doc_id", "place", "label", "block"])

    got = texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, place long, label int, block binary").collect()
    out: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["place"])):
        out[r["label"]].append(bytes(r["block"]))
    return out


def learn(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS, train_blocks: int = TRAIN_BLOCKS) -> Model:
    """The model of the labelled rows (labels 0 and 1) outside fold 0."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    few = sampled(known, "doc_id", train_rows).withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5)
    few = written(few, "quality-labels")
    bodies = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = bodies.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label", "fold").agg(F.max("text").alias("text"))  # few: bounded by train_rows
    texts = written(texts, "quality-texts")
    share = texts.agg(F.avg("label")).first()[0]
    chosen = _chosen_blocks(texts.where("fold in (1, 2)"), train_blocks)
    if not (any(chosen[0]) and any(chosen[1])):
        return Model(None, np.zeros(0), np.zeros(0), 0.5 if share is None else float(share))
    compressors = Compressors((dictionary(chosen[0]), dictionary(chosen[1])))
    sent = df.sparkSession.sparkContext.broadcast(compressors)  # two dictionaries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in pieces_of(batch, 2, CHUNK)):
            yield pa.record_batch([piece.column(0), piece.column(1), pa.array(sent.value.evidence(bodies_of(piece.column(2))))], ["doc_id", "label", "evidence"])

    rows = texts.where("fold in (3, 4) and text <> ''").select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, evidence double")
    held = sorted((r["doc_id"], r["label"], r["evidence"]) for r in rows.collect())  # bounded by train_rows
    return Model(compressors, np.array([h[2] for h in held]), np.array([h[1] for h in held], float), float(share))


def scored(df: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of every document; no shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # two dictionaries and at most train_rows / POOL knots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for piece in (p for batch in batches for p in pieces_of(batch, 1, CHUNK)):
            yield pa.record_batch([piece.column(0), pa.array(sent.value.score(bodies_of(piece.column(1))), pa.float64())], ["doc_id", "score"])

    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def quality(df: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS, train_blocks: int = TRAIN_BLOCKS) -> DataFrame:
    """Every document's score by what the labelled ones teach."""
    return scored(df, learn(df, labels, key=key, text=text, label=label, train_rows=train_rows, train_blocks=train_blocks), key=key, text=text)
