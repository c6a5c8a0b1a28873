"""From a field's image to its glyphs: whole-image segmentation, one row an image, and the normalization of a glyph.

Input rows are images as ``sources.read_images`` gives them (height, width, nChannels, data: BGR or gray bytes). An
image is small and stands alone, so it is cut in one map without a shuffle; ``operators.segment`` has the same steps as
relations over pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.segment import FIELD_INK, GLYPH_DARK, POLARITY

SIDE, PAD = 32, 4
SLICES = 6


def gray(image: np.ndarray) -> np.ndarray:
    """Luminance of BGR bytes; gray images stay."""
    if image.ndim == 2:
        return image
    return np.rint(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def runs(mask: np.ndarray, least: int) -> np.ndarray:
    """The pixels of a mask in horizontal runs of at least ``least`` pixels."""
    height, width = mask.shape
    flat = np.zeros((height, width + 2), np.int8)
    flat[:, 1:-1] = mask
    row, start = np.nonzero(np.diff(flat, axis=1) == 1)
    _, end = np.nonzero(np.diff(flat, axis=1) == -1)
    long_ = end - start >= least
    marks = np.zeros((height, width + 1), np.int32)
    np.add.at(marks, (row[long_], start[long_]), 1)
    np.add.at(marks, (row[long_], end[long_]), -1)
    return marks.cumsum(1)[:, :width] > 0


def components(ink: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int, int]]]:
    """8-connected components: (labels from 1 on, 0 elsewhere; boxes (x, y, w, h, area) by label)."""
    label = np.where(ink, np.arange(1, ink.size + 1).reshape(ink.shape), 0)
    while True:
        padded = np.pad(label, 1)
        new = np.where(ink, np.max([padded[i : i + ink.shape[0], j : j + ink.shape[1]] for i in range(3) for j in range(3)], 0), 0)
        new = np.where(ink, new.ravel()[np.maximum(new, 1) - 1], 0)  # follow the label's own pixel: long shapes settle fast
        if (new == label).all():
            break
        label = new
    names, back = np.unique(label, return_inverse=True)
    back = back.reshape(ink.shape) + (names[0] != 0)
    boxes = []
    for k in range(1, int(back.max()) + 1 if back.size else 1):
        y, x = np.nonzero(back == k)
        boxes.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, len(x)))
    return back, boxes


def comb_spans(ink: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """Columns (from, to) of each cell of a comb field, after its line columns or else a fixed padding."""
    height, width = ink.shape
    columns = np.flatnonzero(runs(ink.T, max(10, int(0.4 * height))).any(1))
    if len(columns) > 1 and columns[-1] - columns[0] > 0.5 * width:
        low, high = int(columns[0]), int(columns[-1])
    else:
        low = max(4, (width % cells) // 2)
        high = width - low
    step = max(10, high - low) / cells
    out = []
    for k in range(cells):
        left, right = max(0, round(low + k * step) + 2), min(width, round(low + (k + 1) * step) - 2)
        out.append((left, right if right > left else min(width, left + int(step))))
    return out


def free_boxes(ink: np.ndarray, cells: int | None) -> list[tuple[int, int, int, int]]:
    """Boxes (x, y, w, h) of the characters of a field without cells, from left to right; none without plausible ink."""
    height, width = ink.shape
    clear = ink & ~runs(ink, max(20, int(0.2 * width)))
    m = max(2, int(0.05 * min(height, width)))
    frame = np.zeros_like(clear)
    frame[m : height - m, m : width - m] = True
    found = sorted((x, y, w, h) for x, y, w, h, area in components(clear & frame)[1] if area >= 6 and h >= 3 and 2 <= w < 0.85 * width)
    if not found:
        return []
    limit = max(1.3 * float(np.median([b[2] for b in found])), 0.8 * width / (cells or len(found)))
    done: list[list[int]] = []  # left, top, right, bottom
    for x, y, w, h in found:
        last = done[-1] if done else None
        if last and (min(last[2], x + w) > x or (x - last[2] < 6 and x + w - last[0] <= limit)):
            done[-1] = [last[0], min(last[1], y), max(last[2], x + w), max(last[3], y + h)]
        else:
            done.append([x, y, x + w, y + h])
    return [(a, b, c - a, d - b) for a, b, c, d in done]


def cut(image: np.ndarray, comb: bool, cells: int | None) -> list[tuple[tuple[int, int, int, int], np.ndarray]]:
    """The glyphs of a field: (box, crop). Cells need a number; a field without plausible ink gives equal slices."""
    level = gray(image)
    ink = level <= FIELD_INK
    height, width = ink.shape
    if comb and cells and cells > 0:
        return [((a, 0, b - a, height), level[:, a:b]) for a, b in comb_spans(ink, cells)]
    boxes = free_boxes(ink, cells)
    if not boxes:
        n = cells or SLICES
        edges = [int(k * (width / n)) for k in range(n + 1)]
        return [((a, 0, int(width / n), height), level[:, a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for x, y, w, h in boxes:
        px, py = max(2, int(0.15 * w)), max(2, int(0.15 * h))
        out.append(((x, y, w, h), level[max(0, y - py) : min(height, y + h + py), max(0, x - px) : min(width, x + w + px)]))
    return out


# --- one glyph --------------------------------------------------------------------------------------------------


def glyph_ink(level: np.ndarray) -> np.ndarray:
    """Dark on light if the median is above the bound, else light on dark."""
    return level <= FIELD_INK if np.median(level) > POLARITY else level > GLYPH_DARK


def without_grid(ink: np.ndarray) -> np.ndarray:
    """Without components that are long thin lines or slivers at the edges."""
    height, width = ink.shape
    label, boxes = components(ink)
    gone = [
        k
        for k, (x, y, w, h, _) in enumerate(boxes, 1)
        if (w > 0.6 * width and h <= 3) or (h > 0.6 * height and w <= 3) or ((y <= 1 or y + h >= height - 1) and h <= 2) or ((x <= 1 or x + w >= width - 1) and w <= 2)
    ]
    return ink & ~np.isin(label, gone)


def _shares(size: int, new: int) -> np.ndarray:
    """Which part of each old pixel falls on each new one."""
    step = size / new
    low, high = np.arange(new)[:, None] * step, (np.arange(new)[:, None] + 1) * step
    at = np.arange(size)[None, :]
    return np.clip(np.minimum(high, at + 1) - np.maximum(low, at), 0, None) / step


def resized(patch: np.ndarray, height: int, width: int, shrink: bool) -> np.ndarray:
    """By the covered area when it shrinks, else by the nearest pixel."""
    h, w = patch.shape
    if shrink:
        return np.rint(_shares(h, height) @ patch @ _shares(w, width).T).astype(np.uint8)
    return patch[np.arange(height) * h // height][:, np.arange(width) * w // width]


def scale_of(w: int, h: int, room: int) -> float:
    """Dots grow by 1.2 at most, dashes by 2; everything else fits the room."""
    if max(w, h) <= 8:
        return min(1.2, room / w)
    if h <= 6 and w >= 8:
        return min(2.0, room / w)
    return min(room / w, room / h)


def normalized(level: np.ndarray, side: int = SIDE, pad: int = PAD) -> np.ndarray:
    """A gray crop as a square patch of [0, 1]: its ink without grid parts (else all ink, else nothing), scaled and centred by its box."""
    out = np.zeros((side, side), np.float32)
    if not level.size:
        return out
    ink = glyph_ink(level)
    kept = without_grid(ink)
    kept = kept if kept.any() else ink
    y, x = np.nonzero(kept)
    if not len(y):
        return out
    tight = kept[y.min() : y.max() + 1, x.min() : x.max() + 1].astype(np.uint8) * 255
    h, w = tight.shape
    room = side - 2 * pad
    scale = scale_of(w, h, room)
    new_w, new_h = (max(1, min(room, round(n * scale))) for n in (w, h))
    top, left = (side - new_h) // 2, (side - new_w) // 2
    out[top : top + new_h, left : left + new_w] = resized(tight, new_h, new_w, scale < 1) / np.float32(255)
    return out


# --- over tables ------------------------------------------------------------------------------------------------


def segment(images: DataFrame, keys: list[str], comb: str = "is_comb_box", cells: str = "cells") -> DataFrame:
    """Rows (keys, pos, x, y, w, h, features) of every glyph: its box in the field and its normalized patch.

    Images without data give no rows; of a field with a known number of cells the glyphs beyond it are left out.
    """
    chosen = images.select(*keys, F.col(comb).alias("comb"), F.col(cells).cast("int").alias("cells"), "height", "width", "nChannels", "data")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[: len(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                comb, cells, height, width, channels, data = (batch.column(len(keys) + j)[k].as_py() for j in range(6))
                if not data or not height or not width:
                    continue
                image = np.frombuffer(data, np.uint8).reshape((height, width) if channels == 1 else (height, width, channels))
                found = cut(image, bool(comb), cells)[: cells or None]
                own = [pa.array([batch.column(j)[k].as_py()] * len(found), batch.column(j).type) for j in range(len(keys))]
                boxes = np.array([b for b, _ in found], np.int32).reshape(-1, 4).T
                patches = [normalized(crop).reshape(-1) for _, crop in found]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(len(found), dtype=np.int32)), *(pa.array(b) for b in boxes), pa.array(patches, pa.list_(pa.float32()))], names=[*keys, "pos", "x", "y", "w", "h", "features"])

    return chosen.mapInArrow(run, f"{kept}, pos int, x int, y int, w int, h int, features array<float>")


def hypotheses_of(glyphs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, hyp) of recognized glyphs (keys, pos, ch, conf, alts), in order of their place."""
    hyp = F.array_sort(F.collect_list(F.struct("pos", "ch", "conf", "alts")))
    return glyphs.groupBy(*keys).agg(F.transform(hyp, lambda g: F.struct(g["ch"].alias("ch"), g["conf"].alias("conf"), g["alts"].alias("alts"))).alias("hyp"))
