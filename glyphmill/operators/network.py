"""The character network's forward pass over tables, and its checkpoints.

Three blocks of 3 x 3 convolutions (32, 32 | 64, 64 | 128 maps), each layer with batch norm and ReLU, each block with a
2 x 2 maximum; then 2048 -> 256 with batch norm and ReLU, and 256 -> classes. Batch norms are folded into the layers
before them, so a layer is one matrix product. The weights (some 0.7 million numbers, whatever the data) are broadcast.

A checkpoint is a Parquet folder with a row for each tensor (name, shape, values) and one for the vocabulary and the
best accuracy; without one there is no model, and every glyph reads as ``?`` at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import constants as C

# The layers' names and sizes, which are those of a checkpoint's tensors.
CONVOLUTIONS = (("conv1a", "bn1a", 1, 32), ("conv1b", "bn1b", 32, 32), ("conv2a", "bn2a", 32, 64), ("conv2b", "bn2b", 64, 64), ("conv3a", "bn3a", 64, 128))
POOLED_AFTER = ("conv1b", "conv2b", "conv3a")
DENSE, DENSE_NORM, OUT, HIDDEN, FLAT = "fc1", "bn_fc1", "fc_out", 256, 128 * 4 * 4
EPSILON = 1e-5
META = "vocabulary"
BATCH = 64


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    """Names and shapes of all tensors."""
    out: dict[str, tuple[int, ...]] = {}
    for conv, norm, before, after in CONVOLUTIONS:
        out |= {f"{conv}.weight": (after, before, 3, 3), f"{conv}.bias": (after,)} | _norm_shapes(norm, after)
    return out | {f"{DENSE}.weight": (HIDDEN, FLAT), f"{DENSE}.bias": (HIDDEN,)} | _norm_shapes(DENSE_NORM, HIDDEN) | {f"{OUT}.weight": (classes, HIDDEN), f"{OUT}.bias": (classes,)}


def _norm_shapes(norm: str, size: int) -> dict[str, tuple[int, ...]]:
    return {f"{norm}.{part}": (size,) for part in ("weight", "bias", "running_mean", "running_var")}


def drawn_weights(seed: int, classes: int = len(C.FULL_VOCABULARY)) -> dict[str, np.ndarray]:
    """Weights by a seed, for tests and as a start."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in shapes(classes).items():
        if len(shape) > 1:
            out[name] = rng.normal(0, (2 / np.prod(shape[1:])) ** 0.5, shape).astype(np.float32)
        else:
            out[name] = (rng.uniform(0.5, 1.5, shape) if name.endswith(("var", "weight")) else rng.normal(0, 0.1, shape)).astype(np.float32)
    return out


class Network:
    """Folded layers: matrices (inputs x outputs) and offsets."""

    def __init__(self, weights: dict[str, np.ndarray], vocabulary: str = C.FULL_VOCABULARY):
        self.vocabulary = vocabulary
        want = shapes(len(vocabulary))
        if {n: tuple(w.shape) for n, w in weights.items()} != want:
            raise ValueError("the tensors are not those of this network")
        self.layers = []
        for conv, norm, before, _ in CONVOLUTIONS:
            matrix, offset = self._folded(weights, conv, norm)
            self.layers.append((conv, matrix.reshape(len(offset), before * 9).T.copy(), offset))
        matrix, offset = self._folded(weights, DENSE, DENSE_NORM)
        self.dense = (matrix.T.copy(), offset)
        self.out = (weights[f"{OUT}.weight"].T.copy(), weights[f"{OUT}.bias"])

    @staticmethod
    def _folded(weights: dict[str, np.ndarray], layer: str, norm: str) -> tuple[np.ndarray, np.ndarray]:
        gain = weights[f"{norm}.weight"] / np.sqrt(weights[f"{norm}.running_var"] + EPSILON)
        matrix = weights[f"{layer}.weight"]
        return matrix * gain.reshape(-1, *[1] * (matrix.ndim - 1)), (weights[f"{layer}.bias"] - weights[f"{norm}.running_mean"]) * gain + weights[f"{norm}.bias"]

    def forward(self, patches: np.ndarray) -> np.ndarray:
        """Logits of patches (n, side, side)."""
        x = patches[:, None].astype(np.float32)
        for name, matrix, offset in self.layers:
            n, maps, h, w = x.shape
            around = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
            windows = np.lib.stride_tricks.sliding_window_view(around, (3, 3), (2, 3)).transpose(0, 2, 3, 1, 4, 5)
            x = np.maximum(windows.reshape(n * h * w, maps * 9) @ matrix + offset, 0).reshape(n, h, w, -1).transpose(0, 3, 1, 2)
            if name in POOLED_AFTER:
                x = x.reshape(n, x.shape[1], h // 2, 2, w // 2, 2).max((3, 5))
        x = np.maximum(x.reshape(len(x), -1) @ self.dense[0] + self.dense[1], 0)
        return x @ self.out[0] + self.out[1]


def classify(glyphs: DataFrame, network: Network | None, features: str = "features", side: int = 32) -> DataFrame:
    """Adds ``logits`` (in the network's vocabulary) to rows with patches; null without a network or a patch."""
    if network is None:
        return glyphs.withColumn("logits", F.lit(None).cast("array<double>"))
    sent = glyphs.sparkSession.sparkContext.broadcast(network)  # of a fixed size
    names = glyphs.columns
    at = names.index(features)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in glyphs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BATCH):
                part = batch.slice(low, BATCH)
                patches = part.column(at).to_pylist()
                real = [k for k, p in enumerate(patches) if p is not None]
                logits: list = [None] * len(patches)
                if real:
                    for k, row in zip(real, sent.value.forward(np.array([patches[k] for k in real], np.float32).reshape(-1, side, side)).astype(float).tolist(), strict=True):
                        logits[k] = row
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(logits, pa.list_(pa.float64()))], names=[*names, "logits"])

    return glyphs.mapInArrow(run, schema + ", logits array<double>")


def save_checkpoint(spark: SparkSession, weights: dict[str, np.ndarray], path: str, vocabulary: str = C.FULL_VOCABULARY, best_accuracy: float | None = None) -> None:
    rows = [(n, list(w.shape), bytearray(np.ascontiguousarray(w, "<f4").tobytes()), None, None) for n, w in weights.items()]
    rows.append((META, [len(vocabulary)], None, vocabulary, best_accuracy))
    spark.createDataFrame(rows, "name string, shape array<int>, data binary, vocabulary string, best_accuracy double").coalesce(1).write.mode("overwrite").parquet(path)


def load_checkpoint(spark: SparkSession, path: str | None) -> Network | None:
    """The network of a checkpoint; none where there is no such path."""
    if not path:
        return None
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    rows = spark.read.parquet(path).collect()  # a row for each tensor
    vocabulary = next(r["vocabulary"] for r in rows if r["name"] == META)
    return Network({r["name"]: np.frombuffer(r["data"], "<f4").reshape(r["shape"]) for r in rows if r["data"] is not None}, vocabulary)
