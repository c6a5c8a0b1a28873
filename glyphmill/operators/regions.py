"""8-connected regions of ink of images of any size.

An image is cut into square tiles, each a group of a bounded number of pixels. Within a tile, pixels that follow each
other in a row are a run, and runs of neighbouring rows that touch are joined. What lies on a tile's edge meets its
neighbours' edges by an equi-join on pixels, and the regions' pairs are merged by star contraction; so a region may wind
through any number of tiles and no task sees more than one of them.

Defined cases: repeated pixels count once; null coordinates are no pixels; without ink there is no region; coordinates
may be negative.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.ranks import ranked
from glyphmill.functions.session import fresh_path

TILE = 256
_PARTS = "img_id long, ty long, tx long, first long, x0 long, y0 long, x1 long, y1 long, area long, edge array<struct<y:long,x:long>>"


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def runs_of(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of distinct pixels that are sorted by row and column."""
    begins = np.flatnonzero((np.diff(y, prepend=y[:1] - 1) != 0) | (np.diff(x, prepend=x[:1] - 1) != 1))
    ends = np.append(begins[1:], len(x)) - 1
    return y[begins], x[begins], x[ends]


def joined_runs(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest run of each run's region; runs are sorted, and touch if one row apart and at most one column."""
    span = int(last.max()) - int(first.min()) + 4
    key = lambda rows, at: (rows - row[0]) * span + (at - first.min())
    low = np.searchsorted(key(row, last), key(row + 1, first - 1), side="left")  # the next row's runs that end late enough
    high = np.searchsorted(key(row, first), key(row + 1, last + 1), side="right")  # ... and begin early enough
    sizes = np.maximum(high - low, 0)
    a, b = np.repeat(np.arange(len(row)), sizes), _ranges(low, sizes)
    label = np.arange(len(row))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def tile_regions(table: pa.Table, tile: int) -> pa.Table:
    """The regions within one tile: their first pixel, box, area, and the pixels on the tile's edge."""
    img, ty, tx = (table.column(c)[0].as_py() for c in ("img_id", "ty", "tx"))
    y, x = (table.column(c).to_numpy() for c in ("y", "x"))
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    distinct = np.append(True, (np.diff(y) != 0) | (np.diff(x) != 0))
    y, x = y[distinct], x[distinct]
    row, first, last = runs_of(y, x)
    names, region = np.unique(joined_runs(row, first, last), return_inverse=True)
    n = len(names)
    least, most = (lambda v, fill: (np.minimum.at(out := np.full(n, fill), region, v), out)[1]), (lambda v, fill: (np.maximum.at(out := np.full(n, fill), region, v), out)[1])
    big = np.iinfo(np.int64).max
    pixel = np.repeat(region, last - first + 1)
    rim = np.isin(y - ty * tile, (0, tile - 1)) | np.isin(x - tx * tile, (0, tile - 1))
    at = np.flatnonzero(rim)[np.argsort(pixel[rim], kind="stable")]
    cells = pa.StructArray.from_arrays([pa.array(y[at]), pa.array(x[at])], ["y", "x"])
    ends = np.searchsorted(pixel[at], np.arange(n + 1))
    return pa.table(
        [
            pa.array(np.full(n, img)), pa.array(np.full(n, ty)), pa.array(np.full(n, tx)),
            pa.array((row[names] - ty * tile) * tile + first[names] - tx * tile),
            pa.array(least(first, big)), pa.array(least(row, big)), pa.array(most(last, -big)), pa.array(most(row, -big)),
            pa.array(np.bincount(region, last - first + 1, n).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells),
        ],
        names=["img_id", "ty", "tx", "first", "x0", "y0", "x1", "y1", "area", "edge"],
    )


def merged(pairs: DataFrame) -> DataFrame:
    """Rows (a, root) of all ids in pairs (a, b): the smallest id they are connected with; see the module."""
    spark = pairs.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = fresh_path(spark, "pairs")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    now = kept(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        least = now.union(now.select("b", "a")).groupBy("a").agg(F.min("b").alias("m"))
        large = now.union(now.select("b", "a")).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = kept(small.distinct())
        same = after.count() == now.count() and now.join(after, ["a", "b"], "left_anti").isEmpty()
        now = after
        if same:
            return now.select("a", F.col("b").alias("root"))


def regions(ink: DataFrame, tile: int = TILE) -> DataFrame:
    """Rows (img_id, seq, x, y, w, h, area) of the ink (img_id, y, x); seq counts an image's regions by x, y, w, h, area."""
    spark = ink.sparkSession
    cut = F.floor(F.col("y") / tile).alias("ty"), F.floor(F.col("x") / tile).alias("tx")
    pixels = ink.select(F.col("img_id").cast("long"), F.col("y").cast("long"), F.col("x").cast("long")).where("y is not null and x is not null and img_id is not null")
    path = fresh_path(spark, "tiles")
    pixels.select("*", *cut).groupBy("img_id", "ty", "tx").applyInArrow(lambda pixels: tile_regions(pixels, tile), _PARTS).write.parquet(path)
    parts = spark.read.schema(_PARTS).parquet(path).withColumn("a", F.struct("img_id", "ty", "tx", "first"))
    edge = parts.select("a", "img_id", "ty", "tx", F.explode("edge").alias("p")).select("a", "img_id", "ty", "tx", "p.y", "p.x")
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))])  # each pair of neighbours once
    reach = edge.select(F.col("a").alias("b"), "img_id", "ty", "tx", "y", "x", F.explode(steps).alias("s")).select("b", "img_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), F.col("ty").alias("ty0"), F.col("tx").alias("tx0"))
    reach = reach.where((F.floor(F.col("y") / tile) != F.col("ty0")) | (F.floor(F.col("x") / tile) != F.col("tx0")))
    pairs = edge.join(reach, ["img_id", "y", "x"]).select("a", "b").distinct()
    roots = merged(pairs)
    whole = parts.join(roots, "a", "left").groupBy("img_id", F.coalesce("root", "a").alias("root")).agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area"))
    boxes = whole.select("img_id", *[F.col(c).cast("int").alias(c) for c in ("x", "y")], (F.col("x1") - F.col("x") + 1).cast("int").alias("w"), (F.col("y1") - F.col("y") + 1).cast("int").alias("h"), F.col("area").cast("int").alias("area"))
    out = ranked(boxes, ["img_id"], ["x", "y", "w", "h", "area"], "seq")
    return out.select("img_id", (F.col("seq") - 1).cast("int").alias("seq"), "x", "y", "w", "h", "area")
