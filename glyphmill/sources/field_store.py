"""A stored layout for look-ups and joins by id: hash buckets, sorted within, with row-group bounds and bloom filters.

A table is written once for each version of its source: as many buckets as wanted, one file each, sorted by the key. A
look-up reads the one file of the key's bucket, and in it the row groups whose bounds and bloom filter admit the key. Two
tables with as many buckets on their keys join bucket by bucket, without an exchange.

The version is given by the caller or taken from the source's files (path, size, time of change), so that a changed source
is written anew and an unchanged one is not; the pointer to the current version is written last. Old versions stay for
readers that use them, until ``vacuum``.

Defined cases: null keys are kept (they are in one bucket and match nothing); repeated keys are kept; an empty source gives
an empty table; a look-up of a key that is not there gives no row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.session import delete


def version_of(source: DataFrame) -> str:
    """A name of the state of a DataFrame's files; reads no columns."""
    files = source.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    known = files.select(F.sum(F.xxhash64("*").cast("decimal(38,0)")), F.count("*")).first()  # a row a file, added in any order
    return hashlib.sha256(repr(tuple(known)).encode()).hexdigest()[:12]


class FieldStore:
    def __init__(self, spark: SparkSession, path: str, name: str, key: str = "id", buckets: int = 16, row_group: int = 8 << 20):
        self.spark, self.path, self.name, self.key, self.buckets, self.row_group = spark, path.rstrip("/"), name, key, buckets, row_group

    def _current(self) -> str | None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current/_SUCCESS")
        if not target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return None
        row = self.spark.read.text(f"{self.path}/current").first()
        return row["value"] if row else None

    def _table(self, version: str) -> str:
        return f"{self.name}_{version}"

    def refresh(self, rows: DataFrame, version: str) -> bool:
        """Writes the rows if their version is not the current one; returns whether it did."""
        if self._current() == version:
            return False
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(version)}")
        delete(self.spark, f"{self.path}/{version}")
        dealt = rows.repartition(self.buckets, self.key)  # one task, so one file, a bucket
        options = {"path": f"{self.path}/{version}", "parquet.block.size": str(self.row_group), f"parquet.bloom.filter.enabled#{self.key}": "true"}
        dealt.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).options(**options).mode("overwrite").saveAsTable(self._table(version))
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/current")
        return True

    def table(self) -> DataFrame:
        """The current version."""
        version = self._current()
        if version is None:
            raise ValueError(f"nothing is stored under {self.path}")
        if not self.spark.catalog.tableExists(self._table(version)):  # another session wrote it
            schema = self.spark.read.parquet(f"{self.path}/{version}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {self._table(version)} ({columns}) USING parquet OPTIONS (path '{self.path}/{version}') CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS")
        return self.spark.table(self._table(version))

    def lookup(self, key: int, **also) -> DataFrame:
        """The rows of a key, and of given values of other columns."""
        rows = self.table().where(F.col(self.key) == F.lit(key))
        for column, value in also.items():
            rows = rows.where(F.col(column) == F.lit(value))
        return rows

    def vacuum(self) -> int:
        """Drops the versions before the current one; returns how many."""
        now = self._current()
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        listed = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
        old = [n for n in (s.getPath().getName() for s in listed) if n not in (now, "current")]
        for version in old:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._table(version)}")
            delete(self.spark, f"{self.path}/{version}")
        return len(old)
