"""Segmentation geometry as relations: pixels (img_id, y, x, v), boxes (img_id, seq, x, y, w, h, area), images (img_id).

Images are small and independent, so every step groups by image; nothing crosses images. ``fields.segment`` runs the
same steps on whole images, one row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELD_INK, GLYPH_DARK, POLARITY = 210, 45, 120


def gray(b: Column, g: Column, r: Column) -> Column:
    return F.bround(0.114 * b + 0.587 * g + 0.299 * r, 0).cast("int")


def field_ink(pixels: DataFrame) -> DataFrame:
    return pixels.where(F.col("v") <= FIELD_INK)


def glyph_ink(pixels: DataFrame) -> DataFrame:
    """Dark on light if the image's median is above the bound, else light on dark.

    The levels, one row an image, are the side that is built, by partition: Spark takes pixels for as few rows as the
    images that they are made of, and would broadcast them.
    """
    level = pixels.groupBy("img_id").agg(F.median("v").alias("level"))
    rows = pixels.join(level.hint("shuffle_hash"), "img_id")
    return rows.where(F.when(F.col("level") > POLARITY, F.col("v") <= FIELD_INK).otherwise(F.col("v") > GLYPH_DARK)).drop("level")


def long_runs(ink: DataFrame, along: str, across: str, least: Column | int) -> DataFrame:
    """Ink in straight runs of at least ``least`` pixels (an opening by a line)."""
    line = Window.partitionBy("img_id", across).orderBy(along)
    runs = ink.withColumn("run", F.col(along) - F.row_number().over(line))
    whole = Window.partitionBy("img_id", across, "run")
    return runs.withColumn("n", F.count("*").over(whole)).where(F.col("n") >= least).drop("run", "n")


def vertical_lines(ink: DataFrame, height: int) -> DataFrame:
    return long_runs(ink, "y", "x", max(10, int(0.4 * height)))


def underlines(ink: DataFrame, width: int) -> DataFrame:
    return long_runs(ink, "x", "y", max(20, int(0.2 * width)))


def without(ink: DataFrame, lines: DataFrame) -> DataFrame:
    return ink.join(lines.select("img_id", "y", "x"), ["img_id", "y", "x"], "left_anti")


def border_cleared(ink: DataFrame, height: int, width: int) -> DataFrame:
    m = max(2, int(0.05 * min(height, width)))
    return ink.where(F.col("y").between(m, height - m - 1) & F.col("x").between(m, width - m - 1))


def column_sums(ink: DataFrame) -> DataFrame:
    return ink.groupBy("img_id", "x").agg(F.count("*").alias("ink"))


def grid_extent(images: DataFrame, columns: DataFrame, width: int) -> DataFrame:
    """Of images (img_id, cells): first and last line column if they span over half the width, else a fixed padding."""
    pad = F.greatest(F.lit(4), F.floor((F.lit(width) % F.col("cells")) / 2)).cast("int")
    found = columns.groupBy("img_id").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    wide = (F.col("n") >= 2) & (F.col("high") - F.col("low") > 0.5 * width)  # null, so not wide, where there is no line
    return images.join(found, "img_id", "left").select("img_id", "cells", F.when(wide, F.col("low")).otherwise(pad).alias("x0"), F.when(wide, F.col("high")).otherwise(width - pad).alias("x1"))


def cells(extents: DataFrame, width: int, inset: int = 2, least: int = 10) -> DataFrame:
    """Equal cells from x0 on; bounds rounded half to even, inset and clamped.

    A cell that the inset leaves empty keeps its left edge and gets the whole pixels of a cell's width.
    """
    rows = extents.select("*", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    step = F.greatest(F.lit(least), F.col("x1") - F.col("x0")) / F.col("cells")
    edge = lambda k: F.bround(F.col("x0") + k * step, 0).cast("int")
    rows = rows.withColumn("left", F.greatest(F.lit(0), edge(F.col("cell")) + inset)).withColumn("right", F.least(F.lit(width), edge(F.col("cell") + 1) - inset))
    repaired = F.least(F.lit(width), F.col("left") + F.floor(step)).cast("int")
    return rows.select("img_id", "x0", "x1", "cell", "left", F.when(F.col("right") <= F.col("left"), repaired).otherwise(F.col("right")).alias("right"))


def plausible_boxes(boxes: DataFrame, width: int) -> DataFrame:
    """Components of at least 6 ink pixels, 3 rows and 2 columns that don't span the image."""
    return boxes.where((F.col("area") >= 6) & (F.col("h") >= 3) & (F.col("w") >= 2) & (F.col("w") < 0.85 * width))


def blank(images: DataFrame, ink: DataFrame) -> DataFrame:
    """Images without ink; the ink is reduced to its images before it is shuffled, and is broadcast in no case."""
    return images.join(ink.select("img_id").distinct().hint("merge"), "img_id", "left_anti")


def equal_slices(images: DataFrame, width: int, n: int = 6) -> DataFrame:
    """For images without ink: n slices between whole pixels; w is a slice's width in whole pixels."""
    step = F.lit(float(width)) / n
    rows = images.select("img_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cell"))
    return rows.select("img_id", "cell", F.floor(F.col("cell") * step).cast("int").alias("x"), F.floor((F.col("cell") + 1) * step).cast("int").alias("right"), F.floor(step).cast("int").alias("w"))


def merged_boxes(boxes: DataFrame, pitch: float, gap: int = 6) -> DataFrame:
    """Boxes of an image from left to right, joined when they overlap in x, or nearly touch and stay narrow together.

    The width test looks at the box grown so far, so this is an ordered fold over one image's boxes; boxes that start
    in the same column follow seq, then y, w and h.
    """
    item = F.struct("x", "seq", "y", "w", "h")
    lists = boxes.groupBy("img_id").agg(F.array_sort(F.collect_list(item)).alias("boxes"), F.median("w").alias("median_w"))
    limit = F.greatest(1.3 * F.col("median_w"), F.lit(0.8 * pitch))
    start = F.array().cast("array<struct<x:int,y:int,r:int,b:int>>")

    def step(done: Column, box: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        new = F.struct(box["x"].cast("int").alias("x"), box["y"].cast("int").alias("y"), (box["x"] + box["w"]).cast("int").alias("r"), (box["y"] + box["h"]).cast("int").alias("b"))
        shared = F.least(last["r"], new["r"]) - F.greatest(last["x"], new["x"])
        close = (new["x"] - last["r"] < gap) & (F.greatest(last["r"], new["r"]) - F.least(last["x"], new["x"]) <= limit)
        joined = F.struct(F.least(last["x"], new["x"]).alias("x"), F.least(last["y"], new["y"]).alias("y"), F.greatest(last["r"], new["r"]).alias("r"), F.greatest(last["b"], new["b"]).alias("b"))
        grows = (F.size(done) > 0) & ((shared > 0) | close)
        return F.when(grows, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(new)))

    out = lists.select("img_id", F.posexplode(F.aggregate("boxes", start, step)).alias("pos", "box"))
    return out.select("img_id", "pos", "box.x", "box.y", (F.col("box.r") - F.col("box.x")).alias("w"), (F.col("box.b") - F.col("box.y")).alias("h"))


def padded_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """15 % (2 pixels at least) on every side, clamped to the image."""
    px, py = F.greatest(F.lit(2), F.floor(0.15 * F.col("w"))), F.greatest(F.lit(2), F.floor(0.15 * F.col("h")))
    x0, y0 = F.greatest(F.lit(0), F.col("x") - px), F.greatest(F.lit(0), F.col("y") - py)
    return boxes.select("*", x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), F.least(F.lit(width), F.col("x") + F.col("w") + px).cast("int").alias("x1"), F.least(F.lit(height), F.col("y") + F.col("h") + py).cast("int").alias("y1"))


def without_grid_parts(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Leaves out long thin boxes and slivers at the four edges."""
    flat = (F.col("w") > 0.6 * width) & (F.col("h") <= 3)
    tall = (F.col("h") > 0.6 * height) & (F.col("w") <= 3)
    side = ((F.col("x") <= 1) | (F.col("x") + F.col("w") >= width - 1)) & (F.col("w") <= 2)
    end = ((F.col("y") <= 1) | (F.col("y") + F.col("h") >= height - 1)) & (F.col("h") <= 2)
    return boxes.where(~(flat | tall | side | end))


def tight_crop(images: DataFrame, kept: DataFrame, ink: DataFrame) -> DataFrame:
    """Of every image the bounds of the kept ink, else of all ink, else none; ``source`` says which."""
    names = ("x0", "x1", "y0", "y1")
    bounds = lambda rows, tag: rows.groupBy("img_id").agg(*[f(c).alias(f"{tag}_{n}") for n, f, c in zip(names, (F.min, F.max, F.min, F.max), "xxyy", strict=True)])
    both = images.select("img_id").join(bounds(kept, "kept"), "img_id", "left").join(bounds(ink, "all"), "img_id", "left")
    source = F.when(F.col("kept_x0").isNotNull(), "kept").when(F.col("all_x0").isNotNull(), "all").otherwise("blank")
    return both.select("img_id", *[F.coalesce(f"kept_{n}", f"all_{n}").alias(n) for n in names], source.alias("source"))


def scale_factor(w: Column, h: Column, room: int = 24) -> Column:
    """Dots grow by 1.2 at most, dashes by 2; everything else fits the room."""
    fit = F.least(room / w, room / h)
    return F.when(F.greatest(w, h) <= 8, F.least(fit, F.lit(1.2))).when((h <= 6) & (w >= 8), F.least(fit, F.lit(2.0))).otherwise(fit)


def unit_scaled(values: Column) -> Column:
    return F.transform(values, lambda v: v / 255.0)
