"""The review log: append, bounded history, counts and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.ranks import ranked

KEPT, SHOWN = 500, 50


def appended(events: DataFrame) -> DataFrame:
    """Log records with defaults; the id is the first eight digits of the event id's hash, so that a repeat gives the same."""
    return events.select(
        F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 8).alias("audit_id"),
        "event_id",
        "ts",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.coalesce("field_type", F.lit("Custom")).alias("field_type"),
        "action",
        F.when(F.col("action") == "REJECT", "[REJECTED]").otherwise(F.col("verified_text")).alias("verified_text"),
        F.round("latency_s", 2).alias("latency_s"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def newest(log: DataFrame, n: int) -> DataFrame:
    """The latest n records; a bounded top-k, not a sort of the log."""
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def history(log: DataFrame, kept: int = KEPT) -> DataFrame:
    return newest(log, kept)


def latest(log: DataFrame, shown: int = SHOWN) -> DataFrame:
    """The latest records with the log's total."""
    return newest(log, shown).join(F.broadcast(log.agg(F.count("*").alias("total"))))


def action_counts(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), *[F.count_if(F.col("action") == a).alias(a.lower()) for a in ("ACCEPT", "CORRECT", "REJECT")])


def decision_log(log: DataFrame, status: str = "status") -> DataFrame:
    """Who decided: accepted records by status, the others by action."""
    label = F.when(F.col("action") == "ACCEPT", F.when(F.col(status) == "APPROVED", "AUTO-APPROVED").otherwise("HUMAN-APPROVED")).when(F.col("action") == "CORRECT", "CORRECTED").otherwise("REJECTED")
    return log.withColumn("decision", label)


def numbered(log: DataFrame, parts: int | None = None) -> DataFrame:
    """Sequential record ids in time order, ties by event_id, without a global sort in one task; see ``ranks``."""
    return ranked(log, [], ["ts", "event_id"], "__rank", parts).withColumn("record_id", F.concat(F.lit("REC-"), (F.col("__rank") + 1000).cast("string"))).drop("__rank")


def payload(predictions: DataFrame) -> DataFrame:
    """What an operator's action sends: a corrected text carries a note, a rejected one a sentinel."""
    action = F.when(F.col("text") == F.col("ground_truth"), "ACCEPT").when(F.length("text") == F.length("ground_truth"), "CORRECT").otherwise("REJECT")
    rows = predictions.withColumn("action", action)
    return rows.select("field_type", "id", "mode", "action", F.when(F.col("action") == "REJECT", "[REJECTED]").when(F.col("action") == "CORRECT", F.col("ground_truth")).otherwise(F.col("text")).alias("verified_text"), F.when(F.col("action") == "CORRECT", F.concat(F.lit("was "), "text")).otherwise("").alias("notes"))


def next_field(fields: DataFrame, key: str = "id", within: str = "field_type") -> DataFrame:
    """The field with the id that follows, or null: an equi-join on id + 1, so no group has to fit one task."""
    after = fields.select(within, (F.col(key) - 1).alias(key), F.col(key).alias("next_id"))
    return fields.join(after, [within, key], "left")


def hourly_actions(log: DataFrame) -> DataFrame:
    """Actions per hour; the same plan runs on a stream (see streaming.audit_stream).

    Latencies are added as whole ten-thousandths and the mean is rounded half up, so that it depends on no order.
    """
    unit = 10_000
    sums = log.groupBy(F.window("ts", "1 hour").alias("w"), "action").agg(F.count("*").alias("n"), F.count("latency_s").alias("m"), F.sum(F.round(F.col("latency_s") * unit, 0).cast("long")).alias("units"))
    mean = F.floor((2 * F.col("units") + F.col("m")) / (2 * F.col("m"))).cast("double") / unit
    return sums.select(F.col("w.start").alias("hour"), "action", "n", F.when(F.col("m") > 0, mean).alias("mean_latency"))
