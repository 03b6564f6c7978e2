"""Releases, forecasts and excavations of a stored corpus, on small made tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tracewright.operators.features import FeatureConfig
from tracewright.operators.guards import GuardError
from tracewright.plans import jobs

JAN = dt.datetime(2024, 1, 1)


def day(n):
    return JAN + dt.timedelta(days=n)


@pytest.fixture
def store(spark, tmp_path):
    """Two lines, three runs of the first: one source grows from 20 by a half per run, always found at its place."""
    root = str(tmp_path / "store")
    surveys = [("007_R0", "007", 0, "accepted", day(0)), ("007_R1", "007", 1, "accepted", day(30)), ("007_R2", "007", 2, "accepted", day(60)), ("X_R0", "X", 0, "accepted", day(0))]
    registry = spark.createDataFrame(surveys, "survey_id string, line_id string, run_id long, status string, surveyed_at timestamp")
    registry.write.parquet(f"{root}/registry")
    rows = registry.select("survey_id", "line_id", "run_id").crossJoin(spark.range(40).select(F.col("id").alias("sample_idx")))
    rows = rows.withColumn("severity_smys", 20 * F.pow(F.lit(1.5), F.col("run_id")))
    rows.write.partitionBy("line_id", "run_id").parquet(f"{root}/readings")
    rows.withColumn("fv", F.lit(FeatureConfig().version)).write.partitionBy("fv", "line_id", "run_id").parquet(f"{root}/features")
    found = registry.select(
        F.concat("survey_id", F.lit("_i")).alias("indication_id"), "survey_id", F.lit(10).alias("peak_sample_idx"), F.lit(100.0).alias("chainage_peak_m"),
        *[(20 * F.pow(F.lit(1.5), F.col("run_id")) * k).alias(c) for c, k in (("sev_lo", 0.9), ("sev_pred", 1.0), ("sev_hi", 1.1))], F.lit("v1").alias("pipeline_version"),
    )
    found.unionByName(found.withColumn("pipeline_version", F.lit("v0")).withColumn("sev_pred", F.lit(1.0))).write.parquet(f"{root}/indications")
    return root


def test_latest_release(spark, store):
    with pytest.raises(GuardError, match="no release"):
        jobs.latest_release(spark, store)
    jobs.add_release(spark, store, "v0", day(1), anomaly="a0")
    jobs.add_release(spark, store, "v1", day(2), anomaly="a1", severity="s1")
    jobs.add_release(spark, store, "v0", day(9), anomaly="other")
    got = jobs.latest_release(spark, store)
    assert got["release"] == "v1" and '"severity":"s1"' in got["models"]


def test_forecast_as_of(spark, store):
    jobs.add_release(spark, store, "v1", day(1))
    sources = spark.createDataFrame([("d", "007", "defect", 101.0, "scc")], "source_id string, line_id string, kind string, chainage_m double, defect_type string")
    got = jobs.forecast_store(spark, store, sources, 100.0).collect()
    assert [(r.matched_source_id, r.n_obs, r.run_id) for r in got] == [("d", 3, 2)]
    assert got[0].shrunk_rate == pytest.approx(math.log(1.5)) and got[0].life_med == pytest.approx(math.log(100 / 45) / math.log(1.5))
    # at the second survey's time, inclusive, the third was not known
    then = jobs.forecast_store(spark, store, sources, 100.0, as_of=day(30)).collect()
    assert [(r.n_obs, r.run_id, r.sev_pred) for r in then] == [(2, 1, pytest.approx(30.0))]
    assert jobs.forecast_store(spark, store, sources, 100.0, as_of=day(-1)).isEmpty()


def test_excavations_reach_the_store_once(spark, store):
    shape = "verification_id string, indication_id string, defect_type string, severity_smys double, verified_at timestamp"
    one = spark.createDataFrame([("v1", "007_R0_i", "scc", 21.0, day(5)), ("v2", "X_R0_i", None, 22.0, day(6))], shape)
    spark.read.parquet(f"{store}/indications").filter("pipeline_version = 'v1'").write.parquet(f"{store}/one")
    spark.read.parquet(f"{store}/one").write.mode("overwrite").parquet(f"{store}/indications")
    assert jobs.verify_store(spark, store, one).count() == 2

    def table(name, *columns):
        return sorted(tuple(r) for r in spark.read.parquet(f"{store}/{name}").select(*columns).collect())

    assert table("truth", "verification_id", "revision", "defect_type") == [("v1", 0, "scc"), ("v2", 0, "unknown")]
    before = table("truth", "defect_id", "revision", "verification_id")
    # the same batch again changes nothing
    assert jobs.verify_store(spark, store, one).isEmpty()
    assert table("truth", "defect_id", "revision", "verification_id") == before
    again = spark.createDataFrame([("v3", "007_R0_i", "weld", 33.0, day(8)), ("v4", "007_R1_i", "weld", 34.0, day(9))], shape)
    jobs.verify_store(spark, store, again)
    assert [(r.verification_id, r.revision, r.valid_to) for r in spark.read.parquet(f"{store}/truth").filter("line_id = '007'").orderBy("revision").collect()] == [
        ("v1", 0, day(8)), ("v3", 1, day(9)), ("v4", 2, None)]
    assert table("observations", "survey_id", "severity_smys") == [("007_R0", 33.0), ("007_R1", 34.0), ("X_R0", 22.0)]
    with pytest.raises(GuardError, match="nope"):
        jobs.verify_store(spark, store, spark.createDataFrame([("v9", "nope", "scc", 1.0, day(1))], shape))
