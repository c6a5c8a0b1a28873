"""The review log as a stream: late records are dropped after a watermark, state is one row per open hour and action."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from glyphmill.operators.audit import hourly_actions


def read_log_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def action_stream(log: DataFrame, late: str = "2 hours") -> DataFrame:
    return hourly_actions(log.withWatermark("ts", late))


def append_log(records: DataFrame, path: str, checkpoint: str):
    """Appends records as Parquet files, exactly once."""
    return records.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
