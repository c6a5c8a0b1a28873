"""Training by mini-batches: AdamW with a cosine rate, gradients worked out where the rows are.

Rows are dealt into shards by a hash of their key. An epoch takes the shards in an order drawn from seed and epoch,
``SPREAD`` of them a step, and its rows are shuffled into blocks of steps. Each step needs the weights of the one before,
so a block is one Spark job: weights and moments go out as a broadcast, a task takes the block's steps one after the other
as its rows stream in, and gives both back. A block has ``BLOCK`` values at most; where a single step has more, its gradient
is summed where its rows are and the driver moves the weights. What the driver holds is the size of the network, a task
also the order of the shards (four bytes for ``BATCH / SPREAD`` rows). The numbers are those of one process that sees the
same batches, but for rounding.

Defined cases: rows without a label, or whose features are null, hold null or non-finite entries or are of another length
than the network's input are left out; labels may be any whole numbers, each is a class; with no rows there is no epoch;
of equally good epochs the first is the best; repeated rows count as often as they stand.
"""

from __future__ import annotations

import math
from copy import copy
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.session import delete, fresh_path
from glyphmill.functions.sums import total_of

# The surveyed optimiser's settings.
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.002, 1e-4
MOMENTS, TINY = (0.9, 0.999), 1e-8
#: Shards a step reads, part of the rows that is held for validation (one in so many), tasks that add first.
SPREAD, HELD, ADDERS = 4, 5, 16
#: Values of the features in one block of steps (64 MB).
BLOCK = 1 << 23


class Perceptron:
    """Fully connected layers with rectifiers between them; weights are one flat vector."""

    def __init__(self, layers: list[int]):
        self.layers = layers
        self.shapes = [(a, b) for a, b in zip(layers[:-1], layers[1:], strict=True)]
        self.size = sum(a * b + b for a, b in self.shapes)

    def drawn(self, seed: int) -> np.ndarray:
        draws = np.random.default_rng(seed)
        return np.concatenate([np.concatenate([draws.standard_normal(a * b) * math.sqrt(2 / a), np.zeros(b)]) for a, b in self.shapes])

    def _parts(self, weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in self.shapes:
            out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def logits(self, weights: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        """What each layer gives, the input first."""
        seen = [x]
        parts = self._parts(weights)
        for k, (w, b) in enumerate(parts):
            out = seen[-1] @ w + b
            seen.append(np.maximum(out, 0) if k < len(parts) - 1 else out)
        return seen

    def losses(self, weights: np.ndarray, x: np.ndarray, y: np.ndarray, gradient: bool = True) -> np.ndarray:
        """Sums over the rows: cross entropy, right predictions, rows, then the gradient."""
        seen = self.logits(weights, x)
        shifted = seen[-1] - seen[-1].max(1, keepdims=True)
        log_sum = np.log(np.exp(shifted).sum(1))
        at = np.arange(len(y))
        head = [float((log_sum - shifted[at, y]).sum()), float((shifted.argmax(1) == y).sum()), float(len(y))]
        if not gradient:
            return np.array(head)
        back = np.exp(shifted - log_sum[:, None])
        back[at, y] -= 1
        parts, out = self._parts(weights), []
        for k in range(len(parts) - 1, -1, -1):
            out = [(seen[k].T @ back).ravel(), back.sum(0), *out]
            if k:
                back = (back @ parts[k][0].T) * (seen[k] > 0)
        return np.concatenate([head, *out])


class AdamW:
    """Moments of the gradient; decay apart from them."""

    def __init__(self, size: int, decay: float = DECAY):
        self.first, self.second, self.steps, self.decay = np.zeros(size), np.zeros(size), 0, decay

    def moved(self, weights: np.ndarray, gradient: np.ndarray, rate: float) -> np.ndarray:
        self.steps += 1
        a, b = MOMENTS
        self.first = a * self.first + (1 - a) * gradient
        self.second = b * self.second + (1 - b) * gradient**2
        step = (self.first / (1 - a**self.steps)) / (np.sqrt(self.second / (1 - b**self.steps)) + TINY)
        return weights * (1 - rate * self.decay) - rate * step


def cosine(rate: float, epoch: int, epochs: int) -> float:
    """The rate of an epoch (from 0): from the first rate down towards 0."""
    return rate * (1 + math.cos(math.pi * epoch / epochs)) / 2


@lru_cache(maxsize=1)
def steps_of(shards: int, epoch: int, seed: int) -> np.ndarray:
    """The step of each shard in an epoch."""
    out = np.empty(shards, np.int32)
    out[np.random.default_rng([seed, epoch]).permutation(shards)] = np.arange(shards) // SPREAD
    return out


@dataclass
class Trained:
    """The best epoch's weights, the classes in the order of the outputs, and (epoch, rate, loss, accuracy) of all."""

    net: Perceptron
    weights: np.ndarray
    classes: list[int]
    history: list[tuple[int, float, float, float]]


def usable(rows: DataFrame, features: str, label: str, key: str) -> DataFrame:
    """Rows (key, x, label) that can be learned from."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    x = F.col(f"`{features}`").cast("array<double>")
    good = F.coalesce((F.size(x) > 0) & F.forall(x, finite), F.lit(False)) & F.col(f"`{label}`").isNotNull()
    return rows.where(good).select(F.col(f"`{key}`").alias("key"), x.alias("x"), F.col(f"`{label}`").cast("long").alias("label"))


def matrix(batch: pa.RecordBatch, classes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Features and class numbers of a batch (x, label)."""
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, np.searchsorted(classes, batch.column(1).to_numpy(zero_copy_only=False))


def train(rows: DataFrame, *, key: str, features: str = "features", label: str = "label", hidden: tuple[int, ...] = (32,), epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 7) -> Trained:
    """Fits a perceptron on four fifths of the rows (by a hash of the key); the others tell the best epoch."""
    spark = rows.sparkSession
    good = usable(rows, features, label, key)
    width = good.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if width is None:
        return Trained(Perceptron([0, 0]), np.zeros(0), [], [])
    good = good.where(F.size("x") == width["n"]).withColumn("fold", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(HELD)))
    sizes = good.groupBy("label").agg(F.count_if(F.col("fold") != 0).alias("n")).collect()  # a row a class
    classes, n = sorted(r["label"] for r in sizes), sum(r["n"] for r in sizes)
    steps = max(1, math.ceil(n / batch))
    blocks = min(steps, math.ceil(steps * batch * width["n"] / BLOCK))
    path = fresh_path(spark, "training")
    good.select("x", "label", F.xxhash64("key", F.lit(seed + 1)).alias("dealt"), (F.col("fold") == 0).alias("held")).write.partitionBy("held").parquet(path)
    data = spark.read.schema("x array<double>, label long, dealt long, held boolean").parquet(path)
    net = Perceptron([width["n"], *hidden, len(classes)])
    weights, mover = net.drawn(seed), AdamW(net.size, decay)
    best, history = weights, []
    for epoch in range(epochs):
        now, loss, count = cosine(rate, epoch, epochs), 0.0, 0.0
        ordered, own = in_blocks(data.where("not held"), steps, blocks, epoch, seed)
        for block in range(blocks):
            rows = ordered.where(F.col("block") == block)
            if batch * width["n"] > BLOCK:
                got = summed(rows, net, weights, classes, True, 0)
                weights = mover.moved(weights, got[3:] / got[2], now) if got[2] else weights
            else:
                got, weights, mover = chained(rows, net, weights, mover, classes, now)
            loss, count = loss + got[0], count + got[2]
        delete(spark, own)
        held = summed(data.where("held"), net, weights, classes, False, ADDERS)
        history.append((epoch + 1, now, float(loss / max(count, 1.0)), float(100.0 * held[1] / max(held[2], 1.0))))
        if history[-1][3] > max((h[3] for h in history[:-1]), default=-1.0):
            best = weights
    return Trained(net, best, classes, history)


def in_blocks(rows: DataFrame, steps: int, blocks: int, epoch: int, seed: int) -> tuple[DataFrame, str]:
    """The rows of an epoch as a table (x, label, dealt, step, block), and its folder; a block is some steps that follow each other."""
    shards = steps * SPREAD
    step = F.arrow_udf(lambda shard: pa.array(steps_of(shards, epoch, seed)[shard.to_numpy(zero_copy_only=False)]), "int")
    placed = rows.drop("held").withColumn("step", step(F.pmod("dealt", F.lit(shards))))
    dealt = placed.withColumn("block", F.floor(F.col("step").cast("long") * blocks / steps).cast("int"))
    path = fresh_path(rows.sparkSession, "epoch")
    dealt.repartitionById(blocks, F.col("block")).write.partitionBy("block").parquet(path)
    return rows.sparkSession.read.schema("x array<double>, label long, dealt long, step int, block int").parquet(path), path


def chained(rows: DataFrame, net: Perceptron, weights: np.ndarray, mover: AdamW, classes: list[int], rate: float) -> tuple[np.ndarray, np.ndarray, AdamW]:
    """The steps of a block one after the other: sums of losses, right predictions and rows, then weights and mover after them."""
    sent = rows.sparkSession.sparkContext.broadcast((weights, mover))  # three times the size of the network

    def run(batches):
        w, own = sent.value[0], copy(sent.value[1])
        at, got, sums = -1, np.zeros(3 + net.size), np.zeros(3)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch, classes)
            step = batch.column(2).to_numpy()
            starts = np.flatnonzero(np.diff(step, prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(step)], strict=True):
                if step[a] != at and got[2]:
                    w, sums, got = own.moved(w, got[3:] / got[2], rate), sums + got[:3], np.zeros(3 + net.size)
                at = step[a]
                got = got + net.losses(w, x[a:b], y[a:b])
        if got[2]:
            w, sums = own.moved(w, got[3:] / got[2], rate), sums + got[:3]
        state = np.concatenate([sums, [own.steps], w, own.first, own.second])
        yield pa.record_batch([pa.array([state.tobytes()], pa.binary())], ["state"])

    try:
        told = rows.coalesce(1).sortWithinPartitions("step", "dealt").select("x", "label", "step").mapInArrow(run, "state binary").first()
    finally:
        sent.destroy()
    if told is None:  # no rows at all
        return np.zeros(3), weights, mover
    state, after = np.frombuffer(told["state"]), copy(mover)
    after.steps = int(state[3])
    w, after.first, after.second = np.split(state[4:], 3)
    return state[:3], w, after


def summed(rows: DataFrame, net: Perceptron, weights: np.ndarray, classes: list[int], gradient: bool, adders: int) -> np.ndarray:
    """Losses, and the gradient if wanted, over rows (x, label)."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)  # the size of the network
    try:
        return total_of(rows.select("x", "label"), lambda b: net.losses(sent.value, *matrix(b, classes), gradient), 3 + net.size * gradient, adders)
    finally:
        sent.destroy()


def predicted(rows: DataFrame, trained: Trained, *, key: str, features: str = "features") -> DataFrame:
    """Rows (key, prediction, probability) of all rows with features of the network's length; no shuffle."""
    x = F.col(f"`{features}`").cast("array<double>")
    chosen = rows.where(F.size(x) == trained.net.layers[0]).select(F.col(f"`{key}`"), x.alias("x"))
    sent = rows.sparkSession.sparkContext.broadcast(trained)

    def run(batches):
        model = sent.value
        for batch in batches:
            if batch.num_rows:
                z = model.net.logits(model.weights, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))[-1]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(model.classes, np.int64)[p.argmax(1)]), pa.array(p.max(1))], names=[key, "prediction", "probability"])

    return chosen.mapInArrow(run, f"`{key}` {chosen.schema.fields[0].dataType.simpleString()}, prediction long, probability double")


def history_of(rows: DataFrame, trained: Trained) -> DataFrame:
    """A row an epoch: (epoch, rate, loss, accuracy), accuracy in percent of the held rows."""
    return rows.sparkSession.createDataFrame(trained.history, "epoch int, rate double, loss double, accuracy double")


def save(rows: DataFrame, trained: Trained, path: str) -> None:
    """The best weights with layers and classes, as one row of Parquet."""
    one = [(trained.net.layers, trained.classes, trained.weights.tolist())]
    rows.sparkSession.createDataFrame(one, "layers array<int>, classes array<long>, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Trained:
    row = spark.read.parquet(path).first()
    return Trained(Perceptron(list(row["layers"])), np.array(row["weights"]), list(row["classes"]), [])
