"""The table of all thresholds against counts at each of them."""

import itertools

import numpy as np
import pytest

from glyphmill.operators import evaluate

SCHEMA = "mode string, field_type string, is_comb_box boolean, text string, ground_truth string, conf double, syntax_valid boolean"


def predictions(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        conf = None if rng.random() < 0.05 else float(rng.choice([rng.random(), 0.96, 0.5, 0.0, 1.0, 0.7 + rng.random() / 10_000]))
        rows.append((str(rng.choice(["raw", "tri"])), rng.choice(["pin", "date", None]), bool(rng.random() < 0.5), "a", rng.choice(["a", "b", None]), conf, rng.choice([True, False, None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_counts_at_each_threshold(spark, seed):
    rows = predictions(600, seed)
    thetas = [0.0, 0.25, 0.5, 0.50001, 0.7, 0.70005, 0.96, 0.97, 1.0, 1.5]
    table = evaluate.confidence_table(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = {(r.mode, r.field_type, r.is_comb_box, r.theta): (r.total, r.accepted, r.approved, r.right) for r in evaluate.at_thresholds(table, thetas).collect()}
    want = {}
    for r in rows:
        for mode, kind, comb, t in itertools.product((r[0], "all"), (r[1] or "none", "all"), (str(r[2]).lower(), "all"), thetas):
            over = r[5] is not None and r[5] >= t
            own = want.setdefault((mode, kind, comb, t), [0, 0, 0, 0])
            for k, v in enumerate((True, over, over and r[6] is True, over and r[3] == r[4])):
                own[k] += v
    assert got == {k: tuple(v) for k, v in want.items()}


def test_reads_the_predictions_once(spark, tmp_path):
    spark.createDataFrame(predictions(50, 3), SCHEMA).write.parquet(str(tmp_path / "p"))
    table = evaluate.at_thresholds(evaluate.confidence_table(spark.read.parquet(str(tmp_path / "p"))), [0.5])
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path) not in plan and "NestedLoop" not in plan and table.count() > 0


def test_no_rows(spark):
    assert evaluate.at_thresholds(evaluate.confidence_table(spark.createDataFrame([], SCHEMA)), [0.5]).count() == 0
