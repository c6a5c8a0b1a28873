"""A log that may be appended to again: batches with a manifest, repeated records left out, small files compacted.

Layout under a folder that all executors share: ``data/<batch>/`` holds a batch's rows, ``manifest/<batch>/`` one row that
is written after them (batch, folders it stands for, rows, first and last time). Only what the manifest names is read, so
a batch that failed half-way leaves nothing, and one that is run again writes its own folder anew. A record is known by
its key and time. A repeated record has the time of the first, so a batch is compared only with committed batches whose
times overlap its own, read by their key and ts alone, with the times pushed down to the files. The key has to be unique:
the audit_id of ``audit.appended`` has 32 bits, and two of the first 100,000 events share one; such a log takes event_id.

One writer at a time (a stream has one; batch jobs take turns). Defined cases: within a batch, of records with one key and
ts the smallest by the text of all columns stays; a null key or ts is refused with a count; an empty batch is committed
with no rows; columns must be those of the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphmill.functions.session import delete

_MANIFEST = "batch string, folders array<string>, covers array<string>, n long, first timestamp_ntz, last timestamp_ntz, seq long"


class AuditLog:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, key: str = "audit_id", time: str = "ts"):
        self.spark, self.path, self.schema, self.key, self.time = spark, path.rstrip("/"), schema, key, time

    def _exists(self, folder: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def manifest(self) -> list:
        """The committed batches that count, oldest first: a row each, those that a compaction covers left out."""
        if not self._exists("manifest"):
            return []
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/*").collect()
        covered = {c for r in rows for c in r["covers"]}
        return sorted((r for r in rows if r["batch"] not in covered), key=lambda r: (r["seq"], r["batch"]))

    def _done(self, known: list) -> set[str]:
        return {b for r in known for b in (r["batch"], *r["covers"])}

    def _read(self, rows: list) -> DataFrame:
        folders = [f"{self.path}/data/{f}" for r in rows for f in r["folders"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self) -> DataFrame:
        """All records."""
        return self._read(self.manifest())

    def _commit(self, batch: str, folders: list[str], covers: list[str], seq: int) -> dict:
        data = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])
        sums = data.agg(F.count("*").alias("n"), F.min(self.time).cast("timestamp_ntz").alias("first"), F.max(self.time).cast("timestamp_ntz").alias("last"))
        text = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
        row = sums.select(F.lit(batch).alias("batch"), text(folders).alias("folders"), text(covers).alias("covers"), "n", "first", "last", F.lit(seq).cast("long").alias("seq"))
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")
        return row.first().asDict()

    def append(self, records: DataFrame, batch: str) -> int:
        """Adds the records of a batch that the log does not hold; returns how many. The same batch again changes nothing."""
        known = self.manifest()
        if batch in self._done(known):
            return 0
        columns = self.spark.createDataFrame([], self.schema).columns
        records = records.select(*columns)
        time = F.col(self.time).cast("timestamp_ntz")
        missing, low, high = records.agg(F.count_if(F.col(self.key).isNull() | time.isNull()), F.min(time), F.max(time)).first()
        if missing:
            raise ValueError(f"{missing} records without {self.key} or {self.time}")
        fresh = records.groupBy(self.key, self.time).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("r")).select("r.*")
        near = [r for r in known if r["n"] and low is not None and r["first"] <= high and low <= r["last"]]
        if near:
            old = self._read(near).where(time.between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))).select(self.key, self.time)
            fresh = fresh.join(old, [self.key, self.time], "left_anti").select(*columns)
        fresh.write.mode("overwrite").parquet(f"{self.path}/data/{batch}")
        return self._commit(batch, [batch], [], 1 + max((r["seq"] for r in known), default=0))["n"]

    def compact(self, rows_per_file: int = 1_000_000) -> str | None:
        """Writes all committed batches as few files in time order; they count in the old batches' place from then on."""
        known = self.manifest()
        if len(known) < 2:
            return None
        n, seq = sum(r["n"] for r in known), known[-1]["seq"]
        batch = f"compacted-{seq}"
        self._read(known).repartitionByRange(max(1, -(-n // rows_per_file)), self.time).sortWithinPartitions(self.time).write.mode("overwrite").parquet(f"{self.path}/data/{batch}")
        self._commit(batch, [batch], sorted(self._done(known)), seq)
        return batch

    def vacuum(self) -> int:
        """Deletes what compactions stand for; returns how many batches went. Readers that began before must have ended."""
        known = self.manifest()
        gone = [b for r in known for b in r["covers"] if self._exists(f"data/{b}")]
        for b in gone:  # the names stay in the compaction's manifest
            delete(self.spark, f"{self.path}/manifest/{b}")
            delete(self.spark, f"{self.path}/data/{b}")
        return len(gone)

    def sink(self, records: DataFrame, checkpoint: str, name: str = "stream"):
        """Appends a stream, batch by batch; a batch that is run again after a failure is the same batch."""
        put = lambda rows, number: self.append(rows, f"{name}-{number:010d}")
        return records.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
