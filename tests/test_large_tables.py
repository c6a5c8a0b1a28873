"""What large tables or a fresh session break: broadcasts of made rows, filters that Spark moves."""

import os
import subprocess
import sys

import duckdb
import pytest

from glyphmill.plans.registry import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def wanted(name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return sorted(con.sql(ORACLES[name]).fetchall())


@pytest.mark.parametrize("name", ["i3_glyph_ink", "i14_slices"])
def test_pixels_are_never_broadcast(spark, name):
    got = QUERIES[name](spark, SF)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == wanted(name)


@pytest.mark.parametrize("name", ["a4_confusions"])
def test_runs_as_the_first_query_of_a_session(name):
    code = f"""from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from glyphmill.plans.registry import QUERIES
print("got", sorted(map(tuple, QUERIES[{name!r}](spark, {SF!r}).collect())))"""
    ended = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=300)
    assert f"got {wanted(name)}" in ended.stdout, ended.stderr[-2000:]
