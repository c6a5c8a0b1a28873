"""The newest records and the log's total as a stream keeps them: a bounded list and a count in one state.

Rows are dealt over ``shards`` by a hash of their id, so that no task sees the whole log; each shard's state holds its own
count and its newest ``kept`` records, which are sure to hold those of them that are among the newest of all. Order of
arrival does not matter. After a restart the state comes back from the checkpoint, and a batch that had not been
committed is run again from it, so that each row counts once. Every batch writes a snapshot of all shards, from which the
history is read.

Defined cases: rows without a time count, but are the oldest; equal times are ordered by id; a row that the source repeats
counts again (leave repeats out before, see ``AuditLog``); with no rows there is no history and no total.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from glyphmill.functions.session import delete

KEPT, SHARDS = 500, 16
_ITEM = "array<struct<t:bigint,id:bigint,record:string>>"
#: transformWithState needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    def __init__(self, kept: int):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", f"total bigint, items {_ITEM}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        total, items = 0, []
        if self.state.exists():
            total, before = self.state.get()
            items = [tuple(i) for i in before]
        for row in rows:
            total += 1
            item = (row["t"], row["id"], row["record"])
            if len(items) < self.kept:
                heapq.heappush(items, item)
            else:
                heapq.heappushpop(items, item)
        self.state.update((total, items))
        yield Row(shard=key[0], total=total, items=items)

    def close(self) -> None:
        pass


def shards_of(log: DataFrame, key: str = "event_id", time: str = "ts", kept: int = KEPT, shards: int = SHARDS) -> DataFrame:
    """Of a stream of records: (shard, total, items) of each shard that a batch changes."""
    t = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(-(1 << 62)))
    rows = log.select(F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"), t.alias("t"), F.col(key).cast("long").alias("id"), F.to_json(F.struct(*log.columns)).alias("record"))
    return rows.groupBy("shard").transformWithState(Newest(kept), f"shard int, total bigint, items {_ITEM}", "Update", "None")


def snapshots(path: str):
    """Writes every batch's shards, with the last state of the others, as a folder of its own; the last two stay."""

    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        own = rows.withColumn("batch", F.lit(batch).cast("bigint"))
        older = _numbers(spark, path, batch)
        if older:
            before = _read(spark, path, older[-1:]).join(own.select("shard"), "shard", "left_anti")
            own = own.unionByName(before.withColumn("batch", F.lit(batch).cast("bigint")))
        own.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch-{batch:010d}")  # a row a shard; again: the same
        for number in older[:-1]:
            delete(spark, f"{path}/batch-{number:010d}")

    return put


def _read(spark: SparkSession, path: str, numbers: list[int]) -> DataFrame:
    return spark.read.schema(f"shard int, total bigint, items {_ITEM}, batch bigint").parquet(*[f"{path}/batch-{n:010d}" for n in numbers])


def _numbers(spark: SparkSession, path: str, below: int = 1 << 62) -> list[int]:
    """The whole snapshots there are, oldest first."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/batch-*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    return sorted(n for n in (int(f.getPath().getParent().getName().removeprefix("batch-")) for f in found) if n < below)


def follow(log: DataFrame, path: str, checkpoint: str, **options):
    """Runs the stream over what is there; ``path``: where the snapshots go."""
    conf, name = log.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKS)
    try:
        return shards_of(log, **options).writeStream.outputMode("update").foreachBatch(snapshots(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(name, before)


def state_of(spark: SparkSession, path: str) -> DataFrame:
    """The last (shard, total, items) of every shard."""
    numbers = _numbers(spark, path)
    if not numbers:
        return spark.createDataFrame([], f"shard int, total bigint, items {_ITEM}")
    return _read(spark, path, numbers[-1:]).select("shard", "total", "items")


def history(spark: SparkSession, path: str, schema: StructType, kept: int = KEPT) -> DataFrame:
    """The newest records of all, with the log's total: at most ``kept`` rows out of ``kept`` a shard."""
    states = state_of(spark, path)
    total = states.agg(F.sum("total").alias("total"))
    items = states.select(F.explode("items").alias("i")).select("i.*").orderBy(F.desc("t"), F.desc("id")).limit(kept)
    return items.select(F.from_json("record", schema).alias("r")).join(F.broadcast(total)).select("r.*", "total")
