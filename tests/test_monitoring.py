import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import drift
from tracewright.operators.guards import GuardError
from tracewright.plans.monitoring import monitor_surveys, training_reference


def survey(name, line, rng, shift=0.0, n=400):
    return pd.DataFrame({
        "survey_id": name, "line_id": line, "row": [f"{name}_{i}" for i in range(n)], "chainage_m": np.arange(n) * 1.0,
        "a": rng.normal(shift, 1, n), "b": rng.normal(5, 2, n),
    })


def shown(name, n, rng):
    return pd.DataFrame({"indication_id": [f"{name}_{i}" for i in range(n)], "survey_id": name, "p": rng.uniform(0.2, 0.9, n)})


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(3)
    frames = [survey("t0", "T", rng), survey("t1", "T", rng)]
    frames += [survey(f"a{i}", "A", rng) for i in range(4)] + [survey("moved", "A", rng, 4.0), survey("many", "B", rng), survey("none", "B", rng)]
    rows = spark.createDataFrame(pd.concat(frames)).persist()
    found = spark.createDataFrame(pd.concat([shown(n, k, rng) for n, k in (("t0", 20), ("t1", 20), ("a0", 22), ("a1", 18), ("moved", 20), ("many", 200))]))
    registry = rows.select("survey_id", "line_id").distinct().withColumn("status", F.lit("accepted")).persist()
    train = F.col("line_id") == "T"
    ref = training_reference(rows.filter(train), "row", ["a", "b"], found.filter("survey_id in ('t0', 't1')"), "p")
    return rows, found, registry, ref


def run(spark, case, names, **more):
    rows, found, registry, ref = case
    return monitor_surveys(spark.createDataFrame([(n,) for n in names], "survey_id string"), registry, rows, found, ref, ["a", "b"], **more)


def test_each_check_raises_its_survey(spark, case):
    got = run(spark, case, ["a0", "moved", "many", "none"])
    by = {r.survey_id: r for r in got.report.collect()}
    assert by["a0"].status == "ok" and by["a0"].n_raised == 0 and by["a0"].ratio == pytest.approx(1.1)
    # the shifted feature blocks, and its median stands out among the line's others
    assert by["moved"].status == "block" and by["moved"].psi_feature == "a" and by["moved"].n_blocking == 1 and by["moved"].n_shifted == 1
    # ten times the rate only warns; two surveys of a line are too few for the background
    assert by["many"].status == "warn" and by["many"].ratio == pytest.approx(10.0) and by["many"].n_shifted == 0
    assert by["none"].status == "warn" and by["none"].rate == 0.0 and by["none"].prediction_ks is None
    assert got.features.count() == 8


def test_stale_coverage_warns_all(spark, case):
    below = spark.createDataFrame([(True,)], "below_nominal boolean")
    assert {r.status for r in run(spark, case, ["a0", "a1"], coverage=below).report.collect()} == {"warn"}
    assert {r.status for r in run(spark, case, ["a0", "a1"], coverage=below.limit(0)).report.collect()} == {"ok"}


def test_refused_surveys_stop_the_job(spark, case):
    rows, found, registry, ref = case
    with pytest.raises(GuardError, match="nowhere"):
        run(spark, case, ["a0", "nowhere"])
    held = registry.withColumn("status", F.when(F.col("survey_id") == "a1", "quarantined").otherwise(F.col("status")))
    with pytest.raises(GuardError, match="a1"):
        run(spark, (rows, found, held, ref), ["a0", "a1"])
    with pytest.raises(GuardError, match="without features"):
        run(spark, (rows.filter("survey_id <> 'a0'"), found, registry, ref), ["a0"])


def test_stored_sample_equals_the_pairwise_tests(spark):
    rng = np.random.default_rng(1)
    make = lambda v, k: pd.DataFrame({"g": k, "feature": "f", "x": np.round(v, 1)})
    ref = spark.createDataFrame(make(rng.normal(size=300), "r")).drop("g")
    cur = spark.createDataFrame(pd.concat([make(rng.normal(0.5, 2, n), f"g{n}") for n in (1, 2, 40, 500)]))
    edges = drift.feature_summary(ref)
    sample = drift.StoredSample(ref, edges.select("feature", "bin_edges"))
    got = sample.psi(cur, ["g"]).join(sample.ks(cur, ["g"]), ["g", "feature"]).toPandas().set_index("g")
    for n in (1, 2, 40, 500):
        mine = cur.filter(F.col("g") == f"g{n}").drop("g")
        want = drift.psi(ref, mine, edges).join(drift.ks(ref, mine), "feature").first()
        assert got.loc[f"g{n}"][["psi", "ks_stat", "ks_pvalue"]].tolist() == pytest.approx([want.psi, want.ks_stat, want.ks_pvalue])
    assert sample.psi(cur.limit(0), ["g"]).isEmpty() and sample.ks(cur.withColumn("feature", F.lit("new")), ["g"]).isEmpty()


def test_rows_of_a_feature_are_not_dealt_out_by_it(spark):
    sample = spark.range(200).select(F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("feature"), F.col("id").cast("double").alias("x"))
    edges = spark.createDataFrame([(f, [0.0, 50.0, 100.0, 200.0]) for f in ("f0", "f1")], "feature string, bin_edges array<double>")
    stored = drift.StoredSample(sample, edges)
    current = sample.withColumn("survey_id", F.col("x") % 5)
    for got in (stored.psi(current, ["survey_id"]), stored.ks(current, ["survey_id"])):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(feature#" not in plan
        assert got.count() == 10
