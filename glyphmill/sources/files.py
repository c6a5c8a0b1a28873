"""Readers and writers of field metadata, reports, logs and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("field_id", T.LongType()),
        T.StructField("field_type", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("is_comb_box", T.BooleanType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("num_chars", T.IntegerType()),
    ]
)
AUDIT = "audit_id string, ts timestamp_ntz, field_id long, field_type string, original_text string, verified_text string, action string, status string, min_conf double, operator_latency_s double, notes string"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Field metadata from CSV; texts of digits stay texts."""
    return spark.read.schema(METADATA).option("header", True).csv(path)


def write_metadata(fields: DataFrame, path: str) -> None:
    fields.write.mode("overwrite").option("header", True).csv(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images as BGR bytes; unreadable files are left out."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def read_image_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def write_images(images: DataFrame, path: str) -> DataFrame:
    """Writes each row's content under its filename into a folder that all executors share; returns (filename, image_path, n_bytes).

    A file is written under another name and moved, so that a repeated task leaves whole files.
    """
    import uuid

    def run(batches):
        import pandas as pd
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(folder, recursive=True)
        for frame in batches:
            for name, content in zip(frame.filename, frame.content, strict=True):
                own = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(own) as out:
                    out.write(content)
                system.move(own, f"{folder}/{name}")
            yield pd.DataFrame({"filename": frame.filename, "image_path": [f"{path}/{n}" for n in frame.filename], "n_bytes": [len(c) for c in frame.content]})

    return images.select("filename", "content").mapInPandas(run, "filename string, image_path string, n_bytes long")


def build_benchmark(fields: DataFrame, images: DataFrame, path: str) -> DataFrame:
    """Writes images and their metadata (CSV) under a folder; returns the metadata."""
    named = images.select("field_type", "id", "filename")
    stored = write_images(images, f"{path}/images").select("filename", "image_path")
    rows = fields.join(named, ["field_type", "id"]).join(stored, "filename")
    meta = rows.select(F.col("id").alias("field_id"), "field_type", "ground_truth", "is_comb_box", "image_path", F.length("ground_truth").alias("num_chars"))
    write_metadata(meta, f"{path}/metadata")
    return read_metadata(fields.sparkSession, f"{path}/metadata")


def write_history(history: DataFrame, path: str) -> None:
    """Training history as JSON lines, a row an epoch."""
    history.coalesce(1).write.mode("overwrite").json(path)


def write_report(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


REPORT = (
    "summary array<struct<mode:string,fields:long,chars:long,exact:long,char_accuracy:double,exact_rate:double,error_rate:double>>, "
    "top_confusions array<struct<truth:string,pred:string,n:long>>, "
    "threshold_sweep array<struct<theta:double,accepted:long,auto_rate:double,accuracy:double,review_rate:double>>"
)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation reports, a row each."""
    raw = spark.read.schema("report string").json(path)
    return raw.select(F.from_json("report", REPORT).alias("r")).select("r.*")


def report_json(summary: DataFrame, confusions: DataFrame, sweep: DataFrame) -> DataFrame:
    """One row with the whole evaluation report as JSON; the inputs are a few rows each."""
    packed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    joined = packed(summary, "summary").join(packed(confusions, "top_confusions")).join(packed(sweep, "threshold_sweep"))
    return joined.select(F.to_json(F.struct("summary", "top_confusions", "threshold_sweep")).alias("report"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The log from JSON lines; a line that can't be parsed is dropped."""
    return spark.read.schema(AUDIT + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).where("audit_id is not null").drop("_bad")


def append_audit(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def write_audit_json(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def write_csv_export(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def history_rows(losses: list[float], accuracies: list[float], spark: SparkSession) -> DataFrame:
    """Training history as rows (epoch, loss, accuracy)."""
    one = spark.createDataFrame([(losses, accuracies)], "loss array<double>, accuracy array<double>")
    return one.select(F.posexplode(F.arrays_zip("loss", "accuracy")).alias("i", "h")).select((F.col("i") + 1).alias("epoch"), "h.loss", "h.accuracy")
