"""Results count rows: holes in the index, nulls, repeats and split files change nothing."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_surveys import CFG, walk, write
from tracewright.operators import baseline, quality
from tracewright.operators import features as ft
from tracewright.operators import series as s
from tracewright.operators.ordered import indexed
from tracewright.plans import jobs
from tracewright.streaming import arrivals


def bumps(n=600, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.normal(size=n).round(1)
    for c in range(40, n - 40, 90):
        y += 40 / (1 + ((np.arange(n) - c) / 4) ** 2)
    y[200:203] = y[200]  # a flat top or ledge
    return y.round(2)


def series_of(spark, idx, y, chunk, longest):
    return indexed(spark.createDataFrame(pd.DataFrame({"k": "a", "i": idx, "y": y, "w": 21, "st": 0.5})), ["k"], "i", longest, chunk)


HOLES = np.cumsum(np.random.default_rng(1).integers(1, 40, 600))
MODES = [(1 << 16, 1000), (1 << 16, None), (16, None), (5, None)]


@pytest.mark.parametrize("chunk,longest", MODES)
def test_frames_count_rows(spark, chunk, longest):
    y = bumps()
    with_holes = series_of(spark, HOLES, y, chunk, longest)
    got = s.rolling_stats(with_holes, "y", {"w": "w"}, 21).df.orderBy("i").toPandas()
    roll = pd.Series(y).rolling(21, center=True, min_periods=21)
    np.testing.assert_allclose(got["w_mean"].to_numpy(float), roll.mean(), atol=1e-9)
    np.testing.assert_allclose(got["w_max"].to_numpy(float), roll.max())
    med = s.rolling_median(with_holes, "y", "w", 21, "m").df.orderBy("i").toPandas()["m"]
    np.testing.assert_allclose(med.to_numpy(float), pd.Series(y).rolling(21, center=True, min_periods=1).median())
    framed = with_holes.framed(30, c=lambda w: F.count("y").over(w)).df.orderBy("i").toPandas()["c"]
    assert framed.tolist() == pd.Series(y).rolling(61, center=True, min_periods=1).count().astype(int).tolist()


@pytest.mark.parametrize("chunk,longest", MODES[:3])
def test_peaks_count_rows(spark, chunk, longest):
    y = np.abs(bumps())

    def table(idx):
        ser = series_of(spark, idx, y, chunk, longest)
        peaks = s.decay_exponents(ser, "y", s.peak_shapes(ser, "y", 4.0), (0.5, 3.0), "st")
        near = s.assign_to_peaks(ser, peaks, ["prominence"], 2.0, "d").df.orderBy("i").toPandas()
        return peaks.orderBy("i").toPandas(), near

    (a, near_a), (b, near_b) = table(np.arange(600)), table(HOLES)
    assert len(a) > 3 and b["i"].tolist() == HOLES[a["i"]].tolist()
    for c in ("value", "prominence", "width", "asymmetry", "decay_exponent"):
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float))
    np.testing.assert_array_equal(near_a["d"].to_numpy(float), near_b["d"].to_numpy(float))


def test_feature_frame_keeps_the_index_as_a_label(spark):
    cfg = ft.FeatureConfig(windows_m=(2.0, 5.0), detrend_window_m=10.0)
    df = walk(5, n=700)
    df["survey_id"] = "LINE000_R0"
    rows = spark.createDataFrame(df).replace(float("nan"), None)
    stretched = rows.withColumn("sample_idx", F.col("sample_idx") * 5 + F.col("sample_idx") % 3)
    a, b = (jobs.build_features(r, CFG, cfg)[0].orderBy("sample_idx").toPandas() for r in (rows, stretched))
    assert b["sample_idx"].tolist() == (a["sample_idx"] * 5 + a["sample_idx"] % 3).tolist()
    for c in ft.pinned_columns(cfg):
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-4, atol=1e-4, err_msg=c)


@pytest.mark.parametrize("longest", [1000, None])
def test_fit_without_the_rows_that_have_no_value(spark, longest):
    x = np.linspace(0, 10, 200)
    y = 1 + 2 * x - 0.3 * x**2
    y[150] += 500
    rows = [(("a"), float(a), float(b)) for a, b in zip(x, y)] + [("a", 3.0, None), ("a", None, 4.0), ("a", 5.0, float("nan")), ("n", 1.0, None)]
    rows += [("flat", float(a), 7.0) for a in x] + [("few", 1.0, 2.0), ("few", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r["coef"] for r in baseline.robust_polynomial(df, ["k"], "x", "y", 2, longest=longest).collect()}
    assert set(got) == {"a", "flat", "few"}
    at = 2 * x / 10 - 1
    np.testing.assert_allclose(np.polyval(got["a"][::-1], at), 1 + 2 * x - 0.3 * x**2, atol=1e-6)
    np.testing.assert_allclose(got["flat"], [7, 0, 0], atol=1e-6)
    np.testing.assert_allclose([np.polyval(got["few"][::-1], v) for v in (-1, 1)], [2, 3], atol=1e-6)


def test_overlap_of_files_that_repeat_an_index(spark):
    n = 3000
    rows = pd.concat([pd.DataFrame({"line_id": "L", "survey_id": f"S{k}", "sample_idx": 5, "v": np.arange(n) * 1.0}) for k in (0, 1)] + [
        pd.DataFrame({"line_id": "L", "survey_id": f"S{k}", "sample_idx": np.arange(20), "v": np.arange(20) * (1.0 + k)}) for k in (2, 3)])
    spans = spark.createDataFrame([("L", f"S{k}", 0.0, 20.0, 1.0) for k in range(4)], "line_id string, survey_id string, start_m double, end_m double, step_m double")
    got = quality.overlap_correlation(spark.createDataFrame(rows), spans, "line_id", "survey_id", "sample_idx", "v")
    assert [(r["a"], r["b"], r["n"]) for r in got.collect()] == [("S2", "S3", 20)] and got.first()["r"] == pytest.approx(1.0)


def test_a_survey_of_several_files_is_one_survey(spark, tmp_path):
    root, store, ck = (str(tmp_path / n) for n in ("raw", "store", "ck"))
    cfg = ft.FeatureConfig(windows_m=(2.0, 5.0), detrend_window_m=10.0)
    whole = walk(80, 0, "007", n=900)
    write(root, whole[:450])
    (tmp_path / "raw/line_id=007/run_id=0/survey.parquet").rename(tmp_path / "raw/line_id=007/run_id=0/first.parquet")
    write(root, whole[450:])
    arrivals.run(spark, root, store, ck, CFG, cfg, files_per_batch=1)
    assert spark.read.parquet(f"{store}/features").count() == 900
    assert [r["status"] for r in spark.read.parquet(f"{store}/registry").filter("outcome = 'accepted'").collect()] == ["accepted"]
    report = spark.read.parquet(f"{store}/dq_report")
    assert report.count() == report.distinct().count() > 0


def test_a_repeated_run_replaces_its_report(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "raw"), str(tmp_path / "store")
    cfg = ft.FeatureConfig(windows_m=(2.0, 5.0), detrend_window_m=10.0)
    write(root, walk(80, 0, "007", n=900))
    jobs.full_run(spark, root, store, CFG, cfg)
    report = spark.read.parquet(f"{store}/dq_report").count()
    # killed before the registry was written
    (tmp_path / "store/registry").rename(tmp_path / "gone")
    jobs.full_run(spark, root, store, CFG, cfg)
    assert spark.read.parquet(f"{store}/dq_report").count() == report > 0
    assert spark.read.parquet(f"{store}/features").count() == 900 and spark.read.parquet(f"{store}/registry").count() == 1


def test_predict_from_the_store(spark, tmp_path):
    from tracewright.operators.guards import GuardError
    from tracewright.operators.learn import IsolationForest
    from tracewright.sources import surveys as io

    root, store = str(tmp_path / "raw"), str(tmp_path / "store")
    cfg = ft.FeatureConfig(windows_m=(2.0, 5.0), detrend_window_m=10.0)
    write(root, walk(80, 0, "007", n=900))
    bad = walk(81, 1, "007", n=900)
    bad.loc[5, "b_lo_nt"] = 999999.0
    write(root, bad)
    jobs.full_run(spark, root, store, CFG, cfg)
    rows = io.read_keyed(spark, f"{store}/features")
    columns = ["r_lo_nt", "r_mid_nt", "r_hi_nt"]
    forest = IsolationForest(tuple(columns), trees=10, contamination=0.02).fit(rows.withColumn("row", F.monotonically_increasing_id()), "row")
    for names in (["007_R0", "007_R9"], ["007_R1"]):
        with pytest.raises(GuardError):
            jobs.predict_store(spark, store, names, forest, "v1", columns, cfg)
    assert not (tmp_path / "store/indications").exists()
    n = jobs.predict_store(spark, store, ["007_R0"], forest, "v1", columns, cfg)
    assert n > 0 and jobs.predict_store(spark, store, ["007_R0"], forest, "v1", columns, cfg) == 0
    assert spark.read.parquet(f"{store}/indications").count() == n
    assert 0 < spark.read.text(f"{store}/geojson/v1").count() <= n
