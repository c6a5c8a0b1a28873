"""Substring search by a trigram index: packed posting lists that are intersected, then verified.

Rows are numbered in the order of their key and stored in blocks of ``BLOCK`` numbers. Every character of a row's texts
begins a trigram (the last two are filled up), and a posting list holds the numbers of one block's rows with one trigram,
as packed differences; so a list has at most ``BLOCK`` numbers, however common its trigram is. A needle of three or more
characters asks for all its trigrams: their lists are intersected block by block, and the rows that are left are read and
compared. A shorter needle is the beginning of trigrams, so the union of their lists is the answer itself. Of the stored
rows only the blocks that are left are read, by ranges that the files' bounds answer.

Defined cases: an empty or null needle matches every row; null texts match nothing; repeated rows are each found; case is
ignored on both sides; characters of any kind; an empty table gives an empty index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.ranks import ranked

BLOCK, GRAM, FILL = 1 << 14, 3, "\0"
#: Ranges of blocks that a search reads; with more gaps than that the smallest are read, too.
MOST_RANGES = 64
_LISTS = "gram string, block int, n int, packed binary"


def packed(numbers: np.ndarray) -> bytes:
    """Ascending numbers of a block as compressed differences of 16 bits."""
    return zlib.compress(np.diff(numbers, prepend=0).astype("<u2").tobytes(), 1)


def unpacked(body: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(body), "<u2").astype(np.int64))


def grams_of(text: Column) -> Column:
    """The distinct trigrams that a text's characters begin."""
    filled = F.concat(text, F.lit(FILL * (GRAM - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(filled, i, F.lit(GRAM))))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting lists of rows (gram, block, place) that come sorted."""
    held: list[tuple[str, int, np.ndarray]] = []

    def flush(whole: bool) -> pa.RecordBatch | None:
        ready = held if whole else held[:-1]
        rest = [] if whole else held[-1:]
        if not ready:
            return None
        out = pa.record_batch([pa.array([h[0] for h in ready]), pa.array([h[1] for h in ready], pa.int32()), pa.array([len(h[2]) for h in ready], pa.int32()), pa.array([packed(h[2]) for h in ready], pa.binary())], ["gram", "block", "n", "packed"])
        held[:] = rest
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        gram = batch.column(0).dictionary_encode()
        code, block, place = gram.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        begins = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        names = gram.dictionary.to_pylist()
        for low, high in zip(begins.tolist(), [*begins[1:].tolist(), len(code)], strict=True):
            name, at = names[code[low]], int(block[low])
            if held and held[-1][:2] == (name, at):
                held[-1] = (name, at, np.concatenate([held[-1][2], place[low:high]]))
            else:
                held.append((name, at, place[low:high]))
        if (out := flush(False)) is not None:
            yield out
    if (out := flush(True)) is not None:
        yield out


class TextIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, rows: DataFrame, key: list[str], texts: list[str]) -> None:
        """Numbers and stores the rows, in the order of ``key``, and writes the lists of their ``texts`` (by name)."""
        number = ranked(rows, [], key, "__number").withColumn("__number", F.col("__number") - 1).withColumn("__block", F.floor(F.col("__number") / BLOCK).cast("int"))
        number.repartitionByRange("__number").sortWithinPartitions("__number").write.option("parquet.block.size", str(1 << 20)).mode("overwrite").parquet(f"{self.path}/rows")
        self.spark.createDataFrame([(",".join(texts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/texts")
        stored = self.spark.read.schema(number.schema).parquet(f"{self.path}/rows")
        each = F.array_distinct(F.flatten(F.array(*[F.when(F.length(t) > 0, grams_of(t)).otherwise(F.array().cast("array<string>")) for t in (F.coalesce(F.lower(F.col(f"`{c}`").cast("string")), F.lit("")) for c in texts)])))
        pairs = stored.select("__block", (F.col("__number") % BLOCK).cast("int").alias("place"), F.explode(each).alias("gram"))
        sorted_ = pairs.select("gram", F.col("__block").alias("block"), "place").repartition("gram", "block").sortWithinPartitions("gram", "block", "place")
        lists = sorted_.mapInArrow(_lists, _LISTS)
        lists.repartitionByRange("gram").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{self.path}/lists")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def candidates(self, needle: str) -> DataFrame:
        """(block, places) of the rows that may hold a needle; of a needle of fewer than three characters those that do."""
        low = needle.lower()
        lists = self.spark.read.schema(_LISTS).parquet(f"{self.path}/lists")
        wanted = sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})
        own = lists.where(F.col("gram").isin(wanted)) if wanted else lists.where(F.col("gram").startswith(low))
        need = len(wanted)

        def meet(table: pa.Table) -> pa.Table:
            """One block's lists: a needle's trigrams, or those that begin with it."""
            found = [unpacked(b) for b in table.column("packed").to_pylist()]
            if need:
                places = reduce(np.intersect1d, sorted(found, key=len)) if len(found) == need else np.zeros(0, np.int64)
            else:
                places = np.unique(np.concatenate(found))
            return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([places.tolist()], pa.list_(pa.int64()))], names=["block", "places"])

        return own.groupBy("block").applyInArrow(meet, "block int, places array<long>").where(F.size("places") > 0)

    def search(self, needle: str | None) -> DataFrame:
        """The rows one of whose texts holds the needle, in any case."""
        rows = self.rows()
        if not needle:
            return rows.drop("__number", "__block")
        texts = self.spark.read.text(f"{self.path}/texts").first()["value"].split(",")
        found = self.candidates(needle).persist()
        blocks = sorted(r["block"] for r in found.select("block").collect())  # a number for each block of rows
        near = reduce(lambda a, b: a | b, [F.col("__block").between(a, b) for a, b in joined_ranges(blocks)], F.lit(False))
        numbers = found.select((F.col("block").cast("long") * BLOCK).alias("base"), F.explode("places").alias("place")).select((F.col("base") + F.col("place")).alias("__number"))
        held = reduce(lambda a, b: a | b, [F.lower(F.col(f"`{c}`").cast("string")).contains(needle.lower()) for c in texts])
        return rows.where(near).join(numbers, "__number", "left_semi").where(held).drop("__number", "__block")

    def read_share(self, needle: str) -> float:
        """The part of the rows that a search compares."""
        n = self.rows().count()
        return (self.candidates(needle).agg(F.sum(F.size("places"))).first()[0] or 0) / max(1, n)


def joined_ranges(blocks: list[int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all blocks; the smallest gaps are closed first."""
    if not blocks:
        return []
    gaps = np.diff(blocks)
    widest = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
    cuts = [k for k in widest.tolist() if gaps[k] > 1]
    starts, ends = [0, *[k + 1 for k in cuts]], [*cuts, len(blocks) - 1]
    return [(blocks[a], blocks[b]) for a, b in zip(starts, ends, strict=True)]
