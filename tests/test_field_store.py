"""The stored layout: what a look-up reads, joins without an exchange, and versions."""

import uuid

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import catalog
from glyphmill.sources.field_store import FieldStore, version_of


def store(spark, path, name, **options):
    return FieldStore(spark, str(path / name), f"{name}_{uuid.uuid4().hex[:8]}", **options)


def fields(spark, n):
    return spark.range(n).select(F.lit("pin").alias("field_type"), ((F.col("id") * 7919) % n).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("ground_truth"), (F.col("id") % 2 == 0).alias("is_comb_box"), F.lit(6).alias("num_chars"))


def scans(df):
    """The rows that the scans of a plan that has run have read."""
    df.collect()
    plan, out = [df._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            plan.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            out.append(node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_a_look_up_reads_one_row_group_of_one_file(spark, tmp_path):
    n = 400_000
    own = store(spark, tmp_path, "fields", buckets=4, row_group=1 << 18)
    own.refresh(fields(spark, n), "1")
    assert [r.id for r in own.lookup(4_711).collect()] == [4_711] and own.lookup(-1).count() == 0
    assert own.lookup(4_711, field_type="date").count() == 0
    [rows] = scans(own.lookup(4_711))
    groups = spark.read.parquet(f"{own.path}/1").where("id = 4711").select("_metadata.file_path").first()[0]
    import pyarrow.parquet as pq

    sizes = [pq.ParquetFile(groups.removeprefix("file:")).metadata.row_group(k).num_rows for k in range(pq.ParquetFile(groups.removeprefix("file:")).metadata.num_row_groups)]
    assert len(sizes) > 3 and sum(sizes) < n / 2 and rows <= max(sizes)


def test_stores_join_without_an_exchange(spark, tmp_path):
    left, right = store(spark, tmp_path, "requests", buckets=4), store(spark, tmp_path, "fields", buckets=4)
    left.refresh(spark.createDataFrame([(i, "Date", True, 8) for i in (1, 5, 5, 2_000, None)], "id long, field_type string, is_comb_box boolean, cells int"), "1")
    right.refresh(fields(spark, 1_000), "1")
    got = catalog.enriched_stored(left, right)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = catalog.enriched(left.table(), fields(spark, 1_000))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5
    with pytest.raises(ValueError):
        catalog.enriched_stored(left, store(spark, tmp_path, "fields", buckets=8))


def test_a_changed_source_is_written_anew_and_an_unchanged_one_is_not(spark, tmp_path):
    source = str(tmp_path / "source")
    fields(spark, 10).write.parquet(source)
    own = store(spark, tmp_path, "fields", buckets=2)
    read = lambda: spark.read.parquet(source)
    with pytest.raises(ValueError):
        own.table()
    assert own.refresh(read(), version_of(read())) and not own.refresh(read(), version_of(read()))
    before = own.table()
    fields(spark, 5).write.mode("append").parquet(source)
    assert own.refresh(read(), version_of(read())) and own.table().count() == 15 and before.count() == 10
    assert own.vacuum() == 1 and own.table().count() == 15
    other = FieldStore(spark, own.path, own.name + "_other", buckets=2)  # a session whose catalog doesn't know it
    assert other.table().count() == 15 and "Exchange" not in other.table().groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
