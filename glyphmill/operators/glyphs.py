"""Pixel-level steps that need Python: components, crops, drawing, and the recognizer's training set."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import constants as C
from glyphmill.operators.fields import components, normalized

#: A 5 x 7 drawing of a character, made by rule: strokes chosen by the bits of its place in the vocabulary.
_GRID = (7, 5)


def shape_of(place: int) -> np.ndarray:
    """A distinct blob-free pattern for each vocabulary place."""
    rng = np.random.default_rng(1000 + place)
    grid = np.zeros(_GRID, np.uint8)
    at = np.array([3, 2])
    for _ in range(14):
        grid[tuple(at)] = 1
        at = np.clip(at + [(0, 1), (1, 0), (0, -1), (-1, 0)][rng.integers(4)], 0, np.array(_GRID) - 1)
    return grid


def image_components(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Rows (img_id, seq, x, y, w, h, area) of the ink (img_id, y, x) of each image."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros((height, width), bool)
        mask[frame.y, frame.x] = True
        rows = [(frame.img_id.iloc[0], k, *c) for k, c in enumerate(sorted(components(mask)[1]))]
        return pd.DataFrame(rows, columns=["img_id", "seq", "x", "y", "w", "h", "area"])

    return pixels.select("img_id", "y", "x").groupBy("img_id").applyInPandas(run, "img_id long, seq int, x int, y int, w int, h int, area int")


def drawn(place: int, seed: int, height: int = 40, width: int = 40) -> np.ndarray:
    """One noisy drawing of a vocabulary place, light on dark: its strokes jittered, turned by up to 12 degrees, one in five blurred.

    Signs are drawn smaller than letters and digits, and a stroke now and then drops out.
    """
    rng = np.random.default_rng([place, seed])
    room = max(1.0, min((height - 6) / _GRID[0], (width - 6) / _GRID[1]))
    small = 0.5 if C.FULL_VOCABULARY[place] == "." else 0.8 if C.FULL_VOCABULARY[place] in "/-" else 1.0
    scale = room * small * rng.uniform(0.75, 0.95)
    angle = np.deg2rad(rng.uniform(-12, 12))
    top, left = (height / 2 + rng.integers(-2, 3), width / 2 + rng.integers(-2, 3))
    y, x = np.mgrid[:height, :width]
    dy, dx = (y + 0.5 - top) / scale, (x + 0.5 - left) / scale
    row = np.floor(np.cos(angle) * dy - np.sin(angle) * dx + _GRID[0] / 2).astype(int)
    column = np.floor(np.sin(angle) * dy + np.cos(angle) * dx + _GRID[1] / 2).astype(int)
    inside = (row >= 0) & (row < _GRID[0]) & (column >= 0) & (column < _GRID[1])
    out = np.where(inside, shape_of(place)[np.clip(row, 0, _GRID[0] - 1), np.clip(column, 0, _GRID[1] - 1)], 0).astype(np.uint8) * 255
    out[rng.random(out.shape) < 0.02] = 0  # ink drops out; specks would move the box
    return blurred(out) if rng.random() < 0.2 else out


def blurred(image: np.ndarray) -> np.ndarray:
    """A 3 x 3 binomial blur; edges are mirrored."""
    one = np.pad(image.astype(float), ((1, 1), (1, 1), *[(0, 0)] * (image.ndim - 2)), mode="reflect")
    one = (one[:-2] + 2 * one[1:-1] + one[2:]) / 4
    return np.rint((one[:, :-2] + 2 * one[:, 1:-1] + one[:, 2:]) / 4).astype(np.uint8)


def glyph_set(spark: SparkSession, per_class: int, seed: int = 7, vocabulary: str = C.FULL_VOCABULARY) -> DataFrame:
    """Rows (label, sample, features): normalized drawings of every character."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            label, sample = frame.id % len(vocabulary), frame.id // len(vocabulary)
            patches = [normalized(drawn(int(a), seed * 1_000_003 + int(b), 44, 44)).reshape(-1).tolist() for a, b in zip(label, sample, strict=True)]
            yield pd.DataFrame({"label": label.astype("int32"), "sample": sample, "features": patches})

    return spark.range(per_class * len(vocabulary)).mapInPandas(run, "label int, sample long, features array<float>")


def split(rows: DataFrame, key: str = "sample", held: int = 5) -> tuple[DataFrame, DataFrame]:
    """80/20 by a hash of the key: the same rows on every run."""
    fold = F.pmod(F.xxhash64(F.col(key), F.col("label")), F.lit(held))
    return rows.where(fold != 0), rows.where(fold == 0)


def train_recognizer(rows: DataFrame, hidden: int = 64, rounds: int = 60, seed: int = 7):
    """A perceptron on the patches averaged to 16 x 16; returns the fitted pipeline (its own model, saved with ``write()``)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    classes = len(C.FULL_VOCABULARY)
    data = rows.select(F.col("label").cast("double").alias("label"), array_to_vector(pooled("features")).alias("features"))
    net = MultilayerPerceptronClassifier(layers=[256, hidden, classes], maxIter=rounds, seed=seed, blockSize=128)
    return Pipeline(stages=[net]).fit(data)


def pooled(column: str):
    """Means of 2 x 2 pixels of a 32 x 32 patch."""

    @F.pandas_udf("array<double>")
    def run(patches: pd.Series) -> pd.Series:
        stacked = np.stack(patches.to_numpy()).reshape(-1, 16, 2, 16, 2)
        return pd.Series(list(stacked.mean((2, 4)).reshape(-1, 256).astype(float)))

    return run(F.col(column))


def recognized(model, rows: DataFrame) -> DataFrame:
    """Adds logits and the predicted label."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = rows.withColumn("patch", F.col("features")).withColumn("features", array_to_vector(pooled("patch")))
    return model.transform(data).withColumn("logits", vector_to_array("rawPrediction")).withColumn("prediction", F.col("prediction").cast("int")).drop("rawPrediction", "probability", "features")


def accuracy(recognized_rows: DataFrame) -> DataFrame:
    """One row: the share of right predictions in percent."""
    return recognized_rows.agg((100.0 * F.avg((F.col("label") == F.col("prediction")).cast("int"))).alias("accuracy"))


def train_with_history(rows: DataFrame, epochs: int = 12, rounds: int = 5, hidden: int = 64, seed: int = 7):
    """(the best epoch's model, history (epoch, loss, accuracy)): each epoch goes on from the last one's weights.

    The loss is that of the training rows, the accuracy (in percent) that of the held fifth.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    train, held = split(rows)
    data = train.select(F.col("label").cast("double").alias("label"), array_to_vector(pooled("features")).alias("features")).cache()
    net = MultilayerPerceptronClassifier(layers=[256, hidden, len(C.FULL_VOCABULARY)], maxIter=rounds, seed=seed, blockSize=128)
    history, best = [], None
    for epoch in range(1, epochs + 1):
        model = net.fit(data)
        net = net.setInitialWeights(model.weights)
        own = PipelineModel([model])
        score = accuracy(recognized(own, held)).first()["accuracy"]
        history.append((epoch, float(model.summary().objectiveHistory[-1]), float(score or 0.0)))
        if best is None or history[-1][2] > best[0]:
            best = (history[-1][2], own)
    data.unpersist()
    return best[1], rows.sparkSession.createDataFrame(history, "epoch int, loss double, accuracy double")


def best_epoch(history: DataFrame) -> DataFrame:
    """The first epoch with the best accuracy."""
    return history.agg(F.min_by("epoch", F.struct(-F.col("accuracy"), F.col("epoch"))).alias("epoch"), F.max("accuracy").alias("accuracy"))


def png(image: np.ndarray) -> bytes:
    """A gray or BGR image as PNG."""
    gray = image.ndim == 2
    body = image if gray else image[:, :, ::-1]
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(body, np.uint8))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    header = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0 if gray else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def field_image(text: str, seed: int, comb: bool) -> np.ndarray:
    """A field as BGR: bright paper, a grid of cells or an underline, dark ink where a drawing is bright, all blurred."""
    rng = np.random.default_rng([seed, len(text)])
    wide, high = int(rng.integers(34, 47)), int(rng.integers(45, 56))
    left, top = 12, 10
    out = np.full((2 * top + high, 2 * left + len(text) * wide, 3), rng.integers(245, 256), np.uint8)
    line = rng.integers(120, 161, 3) if comb else rng.integers(140, 181, 3)
    right, bottom = left + len(text) * wide, top + high
    if comb:
        for k in range(len(text) + 1):
            out[top : bottom + 1, left + k * wide] = line
        out[[top, bottom], left : right + 1] = line
    else:
        out[bottom - 4, left : right + 1] = line
    ink = np.array([rng.integers(20, 46), rng.integers(20, 41), rng.integers(30, 61)])
    for k, c in enumerate(text):
        if c in C.FULL_VOCABULARY:
            mask = drawn(C.FULL_VOCABULARY.index(c), seed * 31 + k, high - 8, wide - 6) > 80
            area = out[top + 4 : top + high - 4, left + k * wide + 3 : left + (k + 1) * wide - 3]
            area[mask] = ink
    return blurred(out)


def field_images(spark: SparkSession, fields: DataFrame) -> DataFrame:
    """Rows (field_type, id, filename, content) of fields (field_type, id, ground_truth, is_comb_box): each drawn, as PNG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            images = [png(field_image(text, int(key), bool(comb))) for text, key, comb in zip(frame.ground_truth, frame.id, frame.is_comb_box, strict=True)]
            yield pd.DataFrame({"field_type": frame.field_type, "id": frame.id, "filename": [f"field_{i:04d}_{t}.png" for t, i in zip(frame.field_type, frame.id, strict=True)], "content": images})

    return fields.select("field_type", "id", "ground_truth", "is_comb_box").mapInPandas(run, "field_type string, id long, filename string, content binary")


def benchmark_fields(spark: SparkSession, n: int = 150, seed: int = 7) -> DataFrame:
    """n labelled fields (field_type, id, ground_truth, is_comb_box): types, layouts and texts by a hash, each as likely."""
    pick = lambda salt, many: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(many))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    sep = F.when(pick(2, 2) == 0, "/").otherwise("-")
    date = F.concat(two(1 + pick(3, 31)), sep, two(1 + pick(4, 12)), sep, (1970 + pick(5, 57)).cast("string"))
    letter = lambda k: F.chr(65 + pick(10 + k, 26))
    code = F.concat(letter(0), letter(1), F.when(pick(6, 2) == 0, letter(2)).otherwise(""), F.lit("-"), (1000 + pick(7, 9000)).cast("string"))
    kind = F.element_at(F.array(F.lit("date"), F.lit("pin"), F.lit("code")), (1 + pick(0, 3)).cast("int"))
    text = F.when(F.col("field_type") == "date", date).when(F.col("field_type") == "pin", (100_000 + pick(8, 900_000)).cast("string")).otherwise(code)
    return spark.range(1, n + 1).withColumn("field_type", kind).select("field_type", "id", text.alias("ground_truth"), (pick(1, 2) == 0).alias("is_comb_box"))
