"""Registered field queries against their DuckDB oracles at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from glyphmill.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = [None if pd.isna(v) else str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool" else repr(round(float(v), 9)) for v in frame[c]]
    return sorted(frame.itertuples(index=False, name=None), key=str)


#: One for each group of rules; the driver compares all of them.
NAMES = ["t2_generated_fields", "p4_s4_described", "p6_enriched", "p9_vocabulary", "r2_r3_masked_topk_date", "r4_no_model", "g2_g9_dates", "g7_date_notes", "g11_g12_pins", "g14_g18_codes", "v2_v3_raw_verified", "m1_m3_predictions", "a7_threshold_sweep", "a9_appended", "a13_record_ids", "i5_i7_cells", "i8_i10_cleaned", "i12_i13_plausible", "i14_slices", "i15_merged_boxes", "i17_without_grid", "i18_tight_crop", "ext_hourly_actions", "i19_scale"]


@pytest.mark.parametrize("name", NAMES)
def test_equals_oracle(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(ORACLES[name]).df())
