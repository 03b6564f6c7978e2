"""Units, gates and held-out predictions of the evaluation jobs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import learn
from tracewright.operators.guards import GuardError
from tracewright.plans import evaluation as ev


def test_units_are_sources(spark):
    rows = [("s1", "i1", 10.0, 10.0, 8.0, 12.0), ("s1", "i2", 10.0, 14.0, 13.0, 15.0), ("s2", "i3", 5.0, 6.0, 4.0, 8.0)]
    df = spark.createDataFrame(rows, "matched_source_id string, indication_id string, y double, sev_pred double, sev_lo double, sev_hi double")
    got = {(r.metric, r.unit): r.value for r in ev.severity_units(df, "y").collect()}
    assert got == {("coverage", "s1"): 0.5, ("coverage", "s2"): 1.0, ("mae", "s1"): 2.0, ("mae", "s2"): 1.0, ("interval_width", "s1"): 3.0, ("interval_width", "s2"): 4.0}
    assert ev.severity_units(df.limit(0), "y").isEmpty()
    rows = [("s1", "i1", "scc", "scc", [1.0, 0.0]), ("s1", "i2", "scc", "interference", [0.0, 1.0]), ("s2", "i3", "interference", "interference", [0.5, 0.5])]
    df = spark.createDataFrame(rows, "matched_source_id string, indication_id string, defect_type string, pred_type string, probabilities array<double>")
    got = {(r.metric, r.unit): r.value for r in ev.class_units(df, ["scc", "interference"]).collect()}
    assert got == {
        ("recall_scc", "s1"): 0.5, ("recall_interference", "s2"): 1.0, ("interference_precision", "s1"): 0.0, ("interference_precision", "s2"): 1.0,
        ("brier", "s1"): 1.0, ("brier", "s2"): 0.5,
    }


def test_gates_judge_the_lower_end(spark):
    rows = [
        ("gap", "recall_gap", 0.5, 0.15, 0.9), ("gap", "interference_gap", 0.5, 0.0, 0.9), ("severity_model", "coverage", 0.93, 0.1, 1.0),
        ("severity_baseline", "coverage", 0.1, 0.1, 1.0), ("classes_model", "recall_scc", 1.0, 0.89, 1.0), ("classes_model", "recall_weld", 0.0, 0.0, 0.0),
        ("classes_model", "forbidden_features", 1.0, None, None),
    ]
    report = spark.createDataFrame(rows, "scoring string, metric string, value_point double, value_lo double, value_hi double")
    got = {(r.scoring, r.metric): r.passed for r in ev._gated(report, "scc").collect()}
    assert got == {
        ("gap", "recall_gap"): True, ("gap", "interference_gap"): False, ("severity_model", "coverage"): True, ("severity_baseline", "coverage"): None,
        ("classes_model", "recall_scc"): False, ("classes_model", "recall_weld"): None, ("classes_model", "forbidden_features"): False,
    }


def test_mad_model(spark):
    x = np.random.default_rng(0).normal(3, 2, 999)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    m = learn.MadModel("x", 0.1).fit(df)
    med = np.median(x)
    mad = np.median(np.abs(x - med))
    assert (m.med, m.mad) == (pytest.approx(med), pytest.approx(mad))
    assert m.threshold == pytest.approx(np.quantile((x - med) / (1.4826 * mad), 0.9))
    with pytest.raises(GuardError):
        learn.MadModel("x").fit(df.filter("x > 1e9"))


def test_calibration_shares_no_source_and_folds_stay_apart(spark):
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "s": np.arange(60) % 10, "fold": np.arange(60) % 10 % 2, "c": "x", "y": 1.0, "a": 2.0}))
    train, calibration = learn.split_for_calibration(df, "s", 0.3, 1)
    a, b = ({r[0] for r in side.select("s").distinct().collect()} for side in (train, calibration))
    assert not a & b and len(b) == 3 and len(a) == 7
    # a single group trains and nothing calibrates
    train, calibration = learn.split_for_calibration(df.filter("s = 1"), "s", 0.3, 1)
    assert train.count() == 6 and calibration.isEmpty()
    assert [(k, t.count(), h.count()) for k, t, h in learn.fold_parts(df, "fold", 5)] == [(0, 30, 30), (1, 30, 30)]
    got = learn.predict_severity(df.filter("s = 1"), df.filter("s = 2"), "s", "y", "id", learn.SeverityModel(["a"], trees=3), 0.3, 1)
    base = got.filter("method = 'baseline'").select("sev_lo", "sev_pred", "sev_hi").distinct().collect()
    assert [tuple(r) for r in base] == [(1.0, 1.0, 1.0)] and got.count() == 12
