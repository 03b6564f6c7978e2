import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import feedback as fb
from tracewright.operators.guards import GuardError
from tracewright.plans.catalogue_surveys import _digs

TRUTH = "defect_id string, line_id string, revision int, chainage_m double, defect_type string, source string, verified_at timestamp, valid_from timestamp, valid_to timestamp"
CHECK = "verification_id string, line_id string, chainage_m double, defect_type string, verified_at timestamp"
JAN = dt.datetime(2024, 1, 1)


def day(n):
    return JAN + dt.timedelta(days=n)


def test_new_object_and_revision(spark):
    truth = spark.createDataFrame([("D1", "L", 0, 99.5, "scc", "survey", None, JAN, None)], TRUTH)
    checks = spark.createDataFrame([("v1", "L", 100.0, "weld", day(5)), ("v2", "L", 500.0, None, day(6))], CHECK)
    table, routed = fb.record_excavations(checks, truth)
    rows = {(r.defect_id, r.revision): r for r in table.collect()}
    to = {r.verification_id: r.defect_id for r in routed.collect()}
    assert rows[("D1", 0)].valid_to == day(5)
    assert rows[("D1", 1)].valid_to is None and rows[("D1", 1)].chainage_m == 100.0
    assert to["v1"] == "D1" and rows[(to["v2"], 0)].defect_type == "unknown" and len(rows) == 3


@pytest.mark.parametrize("walk_rows", [fb.WALK_ROWS, 6, 0])
def test_batch_equals_one_after_another(spark, walk_rows):
    rng = np.random.default_rng(9)
    checks = [(f"v{i:02d}", str(rng.choice(["A", "B"])), float(rng.integers(0, 200)), "scc", day(int(d))) for i, d in enumerate(rng.permutation(30))]
    start = [("D0", "A", 0, 50.0), ("D1", "A", 0, 120.0), ("D2", "B", 0, 80.0)]
    truth = spark.createDataFrame([(*s, "scc", "survey", None, JAN, None) for s in start], TRUTH)
    table, routed = fb.record_excavations(spark.createDataFrame(checks, CHECK), truth, 15.0, walk_rows)
    got = {r.verification_id: (r.defect_id, r.closed_revision) for r in routed.collect()}
    current, want, new = {d: (l, r, c) for d, l, r, c in start}, {}, {}
    for vid, line, c, _, _ in sorted(checks, key=lambda x: x[4]):
        near = sorted((abs(cc - c), cc, d) for d, (l, _, cc) in current.items() if l == line and abs(cc - c) <= 15)
        # equal distances and positions fall to the smaller id, which the made ids of new objects need mapped
        if near:
            d = min((x for x in near if x[:2] == near[0][:2]), key=lambda x: new.get(x[2], x[2]))[2]
            want[vid] = (new.get(d, d), current[d][1])
            current[d] = (line, current[d][1] + 1, c)
        else:
            new[vid] = got[vid][0]
            want[vid] = (got[vid][0], None)
            current[vid] = (line, 0, c)
            assert got[vid][0].startswith("excavation_")
    assert got == want
    # one present revision an object, each revision closed by the next one's time
    rows = sorted(table.collect(), key=lambda r: (r.defect_id, r.revision))
    assert len(rows) == len(start) + len(checks)
    for a, b in zip(rows, rows[1:]):
        if a.defect_id == b.defect_id:
            assert b.revision == a.revision + 1 and a.valid_to == b.valid_from
        else:
            assert a.valid_to is None and b.revision == 0


def test_batches_without_or_with_broken_rows(spark):
    truth = spark.createDataFrame([("D1", "L", 0, 99.5, "scc", "survey", None, JAN, None, "mine")], TRUTH + ", note string")
    none = spark.createDataFrame([], CHECK)
    table, routed = fb.record_excavations(none, truth)
    assert table.collect() == truth.collect() and routed.isEmpty()
    for bad in ([("v", "L", None, "scc", JAN)], [("v", None, 1.0, "scc", JAN)], [("v", "L", 1.0, "scc", None)], [("v", "L", 1.0, "scc", JAN)] * 2):
        with pytest.raises(GuardError, match="v"):
            fb.record_excavations(spark.createDataFrame(bad, CHECK), truth)
    empty, _ = fb.record_excavations(spark.createDataFrame([("v", "L", 1.0, None, JAN)], CHECK), truth.limit(0))
    assert [(r.line_id, r.revision, r.note) for r in empty.collect()] == [("L", 0, None)]


def test_unknown_indication_is_an_error(spark):
    v = spark.createDataFrame([("nope",)], "indication_id string")
    ind = spark.createDataFrame([("i", "S", 1.0)], "indication_id string, survey_id string, chainage_peak_m double")
    with pytest.raises(GuardError, match="nope"):
        fb.locate(v, ind, spark.createDataFrame([("S", "L")], "survey_id string, line_id string"))


def test_median_days(spark):
    truth = spark.createDataFrame([(f"D{i}", "L", 0, 100.0 * i, "scc", "excavation", day(10 * (i + 1)), day(0), None) for i in range(3)], TRUTH)
    ind = spark.createDataFrame([("L", 100.0 * i + 3, JAN) for i in range(3)] + [("L", 100.0 * i, day(5)) for i in range(3)], "line_id string, chainage_peak_m double, created_at timestamp")
    assert fb.median_days(truth, ind).first().median_days == 20.0
    assert fb.median_days(truth.filter(F.lit(False)), ind).count() == 0


def test_verified_coverage(spark):
    truth = spark.createDataFrame([("D0", "L", 0, 100.0, "scc", "excavation", JAN, JAN, None), ("D1", "L", 0, 200.0, "scc", "excavation", JAN, JAN, None)], TRUTH)
    obs = spark.createDataFrame([("D0", "S", 50.0), ("D1", "S", 90.0)], "defect_id string, survey_id string, severity_smys double")
    ind = spark.createDataFrame(
        [("i0", "S", 101.0, 40.0, 60.0, "v1"), ("i1", "S", 199.0, 40.0, 60.0, "v1"), ("i2", "S", 200.0, 0.0, 100.0, "v2")],
        "indication_id string, survey_id string, chainage_peak_m double, sev_lo double, sev_hi double, pipeline_version string")
    r = fb.verified_coverage(obs, truth, ind, "v1", 0.9).first()
    assert (r.empirical, r.n, r.below_nominal) == (0.5, 2, True)
    assert fb.verified_coverage(obs, truth, ind, "v9", 0.9).first().n == 0


def test_the_earliest_of_equal_peaks_is_dug(spark, tmp_path):
    start, values = dt.datetime(2024, 1, 22), [10.0, 80.0, 10.0, 80.0, 10.0, 80.0, 10.0]
    rows = [(100 * u + i, start + dt.timedelta(days=i), u, "view", x) for u in range(40) for i, x in enumerate(values)]
    e = spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, event_type string, value double")
    e.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    _, truth = _digs(spark, str(tmp_path))
    assert [r.verified_at for r in truth.select("verified_at").collect()] == [start + dt.timedelta(days=2)] * 40
