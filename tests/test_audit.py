"""Log ids under skew, appends that are repeated, and the streamed history after a failure."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import ranks
from glyphmill.operators import audit
from glyphmill.plans.registry import QUERIES
from glyphmill.sources.audit_log import AuditLog
from glyphmill.streaming import history_stream
from glyphmill.streaming.audit_stream import read_log_stream

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, action string"


def burst(n):
    """Nine of ten rows at one second, in no order of ids."""
    return [(i * 7919 % n, START + dt.timedelta(seconds=i if i % 10 == 0 else 5), "ACCEPT") for i in range(n)]


def test_a_burst_is_dealt_over_all_tasks_and_numbered_in_order(spark):
    log = spark.createDataFrame(burst(20_000), SCHEMA).repartition(5)
    sizes = sorted(r["count"] for r in ranks.placed(log, ["ts", "event_id"], 12).groupBy("__part").count().collect())
    assert len(sizes) == 12 and sizes[-1] <= 2 * sizes[6]
    got = audit.numbered(log.withColumn("part", F.lit("own")), 12).collect()
    want = {e: f"REC-{1001 + k}" for k, (_, e) in enumerate(sorted((r[1], r[0]) for r in burst(20_000)))}
    assert {r.event_id: r.record_id for r in got} == want and {r.part for r in got} == {"own"}


def test_numbers_of_few_and_no_rows(spark):
    one = spark.createDataFrame([(1, None, "ACCEPT"), (2, START, "ACCEPT")], SCHEMA)
    assert {r.event_id: r.record_id for r in audit.numbered(one).collect()} == {1: "REC-1001", 2: "REC-1002"}
    assert audit.numbered(one.limit(0)).count() == 0


LOG = "audit_id string, ts timestamp_ntz, notes string"


def records(spark, ids, note="n"):
    return spark.createDataFrame([(f"id{i}", START + dt.timedelta(minutes=i), note) for i in ids], LOG)


def ids_of(log):
    return sorted((int(r.audit_id[2:]), r.notes) for r in log.read().collect())


def test_repeated_batches_and_records_leave_the_log_as_it_is(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"), LOG)
    assert log.read().count() == 0 and log.compact() is None
    assert log.append(records(spark, range(10)), "a") == 10
    assert log.append(records(spark, range(10), "other"), "a") == 0  # the same batch again
    assert log.append(records(spark, [*range(5, 15), 12, 12]), "b") == 5
    assert log.append(records(spark, [2, 99]), "late") == 1
    assert log.append(records(spark, []), "none") == 0
    want = [(i, "n") for i in [*range(15), 99]]
    assert ids_of(log) == want
    assert log.compact() == "compacted-4" and ids_of(log) == want
    assert log.vacuum() == 4 and ids_of(log) == want
    assert log.append(records(spark, [7, 300]), "b") == 0  # a batch that a compaction stands for
    assert log.append(records(spark, [7, 300]), "c") == 1
    log.compact()
    log.vacuum()
    assert ids_of(log) == [*want, (300, "n")] and len(list((tmp_path / "log" / "data").iterdir())) == 1


def test_records_that_share_an_audit_id_all_stay(spark, tmp_path):
    """The ids of 69,235 and 95,303 have the same first eight digits."""
    ids = [69_235, 95_303, 3]
    events = spark.createDataFrame([(i, START, "ACCEPT", "pin", "v", 1.0, None) for i in ids], "event_id long, ts timestamp_ntz, action string, field_type string, verified_text string, latency_s double, notes string")
    rows = audit.appended(events)
    assert rows.select("audit_id").distinct().count() == 2
    apart, together = (AuditLog(spark, str(tmp_path / name), rows.schema, key="event_id") for name in ("apart", "together"))
    assert [apart.append(rows.where(F.col("event_id") == i), f"b{k}") for k, i in enumerate([*ids, 3])] == [1, 1, 1, 0]
    assert together.append(rows, "a") == 3 and together.append(rows, "b") == 0
    later = rows.withColumn("ts", F.when(F.col("event_id") == ids[1], F.lit(START + dt.timedelta(minutes=9)).cast("timestamp_ntz")).otherwise(F.col("ts")))
    by_id = AuditLog(spark, str(tmp_path / "by_id"), rows.schema)  # of one audit_id, another time is another record
    assert by_id.append(later, "a") == 3 and by_id.append(later, "b") == 0
    for log in (apart, together, by_id):
        assert sorted(r.event_id for r in log.read().collect()) == sorted(ids)
    table = events.select("event_id", "ts", F.col("event_id").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"))
    table.write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r.event_id for r in QUERIES["s9_a9_repeatable_append"](spark, str(tmp_path)).collect()) == sorted(ids)


def test_a_batch_that_failed_half_way_leaves_nothing_and_can_be_run_again(spark, tmp_path, monkeypatch):
    log = AuditLog(spark, str(tmp_path / "log"), LOG)
    log.append(records(spark, range(3)), "a")
    with monkeypatch.context() as m:
        m.setattr(log, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            log.append(records(spark, range(3, 6)), "b")
    assert ids_of(log) == [(i, "n") for i in range(3)]
    assert log.append(records(spark, range(3, 6)), "b") == 3
    assert ids_of(log) == [(i, "n") for i in range(6)]


def test_records_without_an_id_or_time_are_refused(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"), LOG)
    bad = spark.createDataFrame([("a", None, ""), (None, START, "")], LOG)
    with pytest.raises(ValueError, match="2 records"):
        log.append(bad, "a")


def test_a_streamed_append_takes_each_record_once(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "log"), LOG)
    for k, ids in enumerate((range(8), range(4, 12), [1, 11])):
        records(spark, ids).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "in"))
        log.sink(stream, str(tmp_path / "mark")).awaitTermination()
        if k == 1:  # the checkpoint is lost: all files come again, as other batches
            log.sink(stream, str(tmp_path / "mark2"), "again").awaitTermination()
    assert ids_of(log) == [(i, "n") for i in range(12)]


def test_the_history_goes_on_after_a_failure(spark, tmp_path):
    rows = [(i * 37 % 500, START + dt.timedelta(seconds=i % 50), "ACCEPT") for i in range(500)] + [(1_000, None, "REJECT")]
    log = spark.createDataFrame(rows, SCHEMA)
    log.repartition(6, "event_id").write.parquet(str(tmp_path / "in"))
    stream = read_log_stream(spark, str(tmp_path / "in"), log.schema, files_per_batch=2)
    out, mark, seen = str(tmp_path / "out"), str(tmp_path / "mark"), []

    def fails(batch_rows, number):
        seen.append(number)
        history_stream.snapshots(out)(batch_rows, number)
        if number == 1:
            raise RuntimeError("the driver dies after the snapshot, before the commit")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", history_stream.ROCKS)
    first = history_stream.shards_of(stream, kept=40, shards=3).writeStream.outputMode("update").foreachBatch(fails).option("checkpointLocation", mark).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="dies"):
        first.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    history_stream.follow(stream, out, mark, kept=40, shards=3).awaitTermination()
    got = history_stream.history(spark, out, log.schema, 40).collect()
    want = audit.history(log.where("ts is not null"), 40).collect()
    assert sorted((r.event_id, r.ts) for r in got) == sorted((r.event_id, r.ts) for r in want)
    assert {r.total for r in got} == {501} and seen == [0, 1] and len(history_stream._numbers(spark, out)) == 2
