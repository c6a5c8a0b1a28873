"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.session import fresh_path, importable

#: Ids (8 bytes each) that may be broadcast; beyond, the texts are shuffled.
MOST_BROADCAST = 2_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_MEMOS: list[weakref.ref] = []
#: glibc's call that returns freed memory; other C libraries do without.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def small_batches(spark: SparkSession) -> None:
    """Sends texts to Python workers in batches of some MB, where the session has Spark's own bound (64 MB).

    By the number of rows alone a batch of long texts has tens of MB, which the JVM and the worker hold several times.
    """
    if spark.conf.get(_BATCH, None) in (None, "64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(_BATCH, "8m")


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` by tasks that give their memory back to the system in the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, key: str, gone: DataFrame, what: str, most: int = MOST_BROADCAST) -> DataFrame:
    """The rows whose key is none of the ids in the one column of ``gone`` (null is an id, too), with all their columns."""
    gone = written(gone.toDF("__gone").distinct(), what)
    if gone.count() <= most:
        gone = F.broadcast(gone)
    return df.join(gone, F.col(key).cast("long").eqNullSafe(F.col("__gone")), "left_anti")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_tree(column: Column, bounds: list, low: int = 0) -> Column:
    """How many of the ascending ``bounds`` are <= the column, by binary search in one expression; null counts as 0."""
    if not bounds:
        return F.lit(low).cast("int")
    mid = len(bounds) // 2
    right = bucket_tree(column, bounds[mid + 1 :], low + mid + 1)
    return F.when(column >= F.lit(bounds[mid]), right).otherwise(bucket_tree(column, bounds[:mid], low))


def id_bounds(df: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` ascending key values that cut the rows into even ranges; reads only the key column."""
    if parts < 2:
        return []
    got = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    return sorted(set(got or []))


def held_out(key: str | Column, folds: int = 5) -> Column:
    """True for rows whose crc32 of the key's text falls into fold 0; a null key counts as empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % folds == 0


def sampled(df: DataFrame, key: str, most: int) -> DataFrame:
    """Rows chosen by a hash of the key so that about ``most`` are kept; all of them when there are fewer."""
    count = df.count()
    if count <= most:
        return df
    scale = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(scale)) < int(scale * most / count))


def plain_names(df: DataFrame, names: list[str], results) -> list[str]:
    """Those of the columns that don't bear the name of a result (which takes their place), each once."""
    taken = {r.lower() for r in results}
    return [n for n in dict.fromkeys(names) if n.lower() not in taken]


def remembered(cache):
    """Marks a cache (with ``clear``) as one that ``settle`` empties."""
    _MEMOS.append(weakref.ref(cache))
    return cache


class Kept(dict):
    """Tables that ``settle`` can empty."""


class Memo(dict):
    """Bounded cache: forgets everything when it is full. Its results never depend on what it holds."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most
        remembered(self)

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def settle(*keep) -> None:
    """Empties all caches of this process but ``keep``, and gives their memory back to the system.

    A Python worker serves one operator after the other; what an earlier one left behind would add up.
    """
    for ref in _MEMOS:
        cache = ref()
        if cache is not None and all(cache is not k for k in keep):
            cache.clear()
    release()


def release() -> None:
    """Gives freed memory of this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)
