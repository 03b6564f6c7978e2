"""Raw files to features, predictions and revisions, on small made walks."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import features as ft
from tracewright.operators import quality as dq
from tracewright.operators import registration as reg
from tracewright.operators.identity import canonical, content_hashes
from tracewright.operators.ordered import indexed
from tracewright.plans import jobs
from tracewright.sources import surveys as io
from tracewright.streaming import arrivals

CFG = reg.RegistrationConfig()
PITCH = 12.0


def walk(seed, run=0, line="LINE000", n=4200, dropout=0.3, rate=10.0):
    """A walk of about 500 m with weld anomalies every 12 m and two buried sources."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) / rate
    speed = np.clip(1.2 + np.convolve(rng.normal(0, 1.5, n), np.ones(80) / 80, "same"), 0.6, 1.8)
    s = np.concatenate([[0.0], np.cumsum((speed[1:] + speed[:-1]) / 2 / rate)])
    b = 48850 + 0.02 * s + rng.normal(0, 2.0, n)
    for k in range(1, int(s[-1] // PITCH) + 1):
        b = b + rng.choice([-1, 1]) * 90 / (1 + ((s - k * PITCH) / 0.6) ** 2) ** 1.5
    defect = np.zeros(n, dtype=int)
    for c in (130.0, 300.0):
        b = b + 300 / (1 + ((s - c) / 2.0) ** 2) ** 1.5
        defect[np.abs(s - c) < 4] = 1
    brg = np.radians(CFG.bearing_deg)
    g = s + rng.normal(0, 1.0, n)
    lat = CFG.lat0 + g * np.cos(brg) / 111320.0
    lon = CFG.lon0 + g * np.sin(brg) / (111320.0 * np.cos(np.radians(CFG.lat0)))
    gone = np.convolve(rng.random(n) < dropout / 100, np.ones(100), "same") > 0 if dropout < 1 else np.ones(n, dtype=bool)
    lat[gone], lon[gone] = np.nan, np.nan
    return pd.DataFrame({
        "line_id": line, "run_id": np.int64(run), "sample_idx": np.arange(n), "t_s": t, "lat": lat, "lon": lon, "b_lo_nt": b + rng.normal(0, 3, n) + 5,
        "b_mid_nt": b, "b_hi_nt": b + rng.normal(0, 3, n) - 5, "defect": defect, "defect_type": np.where(defect == 1, "scc", "none"),
        "severity_smys": np.where(defect == 1, 40.0, np.nan), "interference": 0, "girth_weld": 0, "chainage_true_m": s,
    })


def write(root, df):
    path = f"{root}/line_id={df['line_id'].iloc[0]}/run_id={df['run_id'].iloc[0]}"
    os.makedirs(path, exist_ok=True)
    out = df.drop(columns=["line_id", "run_id"])
    out.astype({c: "int64" for c in ("defect", "interference", "girth_weld", "sample_idx")}).to_parquet(f"{path}/survey.parquet")


@pytest.fixture(scope="module")
def series(spark):
    df = pd.concat([walk(1, 0), walk(2, 1), walk(3, 2, dropout=1.0)])
    df["survey_id"] = df["line_id"] + "_R" + df["run_id"].astype(str)
    sdf = spark.createDataFrame(df).select("*")
    for c in ("lat", "lon", "severity_smys"):
        sdf = sdf.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return indexed(sdf.persist(), ["survey_id"], "sample_idx", 4200)


@pytest.fixture(scope="module")
def placed(series):
    rows, info = reg.register(series, CFG)
    return rows.persist(), {r.survey_id: r for r in info.collect()}


def numpy_dead_reckoning(d):
    t, lat, lon = d["t_s"].to_numpy(), d["lat"].to_numpy(), d["lon"].to_numpy()
    brg = np.radians(CFG.bearing_deg)
    s = (lat - CFG.lat0) * 111320.0 * np.cos(brg) + (lon - CFG.lon0) * 111320.0 * np.cos(np.radians(CFG.lat0)) * np.sin(brg)
    ok = ~np.isnan(s)
    w = max(1, round(2.0 / (1.2 * np.median(np.diff(t)))))
    w += w % 2 == 0
    pad = np.r_[np.repeat(s[ok][0], w // 2), s[ok], np.repeat(s[ok][-1], w // 2)]
    sm = np.array([np.median(pad[i : i + w]) for i in range(ok.sum())])
    vel = np.interp(t, t[ok], np.clip(np.gradient(sm, t[ok]), 0.6, 1.8))
    raw = np.r_[0, np.cumsum((vel[1:] + vel[:-1]) / 2 * np.diff(t))]
    return np.maximum.accumulate(raw + np.interp(t, t[ok], sm - raw[ok]))


@pytest.mark.parametrize("chunk", [1 << 16, 1000])
def test_dead_reckoning_equals_the_array_version(series, chunk):
    s = indexed(series.df.filter("run_id < 2"), ["survey_id"], "sample_idx", 4200, chunk)
    got = reg.dead_reckon(s, CFG).df.toPandas().sort_values(["survey_id", "sample_idx"])
    for _, d in got.groupby("survey_id"):
        np.testing.assert_allclose(d["dr_m"], numpy_dead_reckoning(d), atol=1e-6)


def test_the_grid_is_written_once(spark, monkeypatch):
    written, cut = [], reg.cut
    monkeypatch.setattr(reg, "cut", lambda df: written.append(df.columns) or cut(df))
    n = 400
    rows = spark.createDataFrame(pd.DataFrame({
        "survey_id": "a", "sample_idx": np.arange(n), "t_s": np.arange(n, dtype=float), "lat": CFG.lat0, "lon": CFG.lon0,
        "b_mid_nt": 48000.0 + 50.0 * (np.arange(n) % 10 == 0),
    }))
    reg.register(indexed(rows.withColumn("lat", F.when(F.col("sample_idx") == 0, F.col("lat"))), ["survey_id"], "sample_idx", n), CFG)
    assert [c for c in written if "grid_i" in c] == [["survey_id", "grid_i", "grid_x", "env"]]


def test_registration_finds_the_comb(placed):
    rows, info = placed
    pdf = rows.toPandas().sort_values(["survey_id", "sample_idx"])
    for sid, d in pdf.groupby("survey_id"):
        assert (np.diff(d["chainage_m"]) >= 0).all()
        if sid.endswith("R2"):
            assert info[sid].gps_locked_fraction == 0.0
            continue
        assert abs(info[sid].pitch_estimate_m - PITCH) < 0.15
        assert info[sid].n_welds_detected >= 20
        err = np.median(np.abs(d["chainage_m"] - d["chainage_true_m"]))
        assert err < 3.0
        assert d["dist_to_weld_m"].notna().all()


def test_short_survey_keeps_dead_reckoning(spark, series):
    short = indexed(series.df.filter("sample_idx < 60 and run_id = 0"), ["survey_id"], "sample_idx", 60)
    rows, info = reg.register(short, CFG)
    assert info.first().n_welds_detected == 0 and "shorter" in info.first().note
    assert rows.filter("dist_to_weld_m is not null").isEmpty()


def test_feature_frame_contract(spark, placed):
    rows, _ = placed
    cfg = ft.FeatureConfig()
    frame = ft.feature_frame(indexed(rows.filter("run_id < 2"), ["survey_id"], "sample_idx", 4200), cfg).persist()
    assert frame.columns[-45:] == ft.pinned_columns(cfg) and len(ft.pinned_columns(cfg)) == 45
    assert {t for _, t in frame.dtypes[-45:]} == {"float"}
    c = dq.feature_contract(frame, ["survey_id", "sample_idx"], ["r_lo_nt", "r_mid_nt", "r_hi_nt"]).collect()
    assert all(r.n_holes == 0 and r.n_flags == 0 and r.n_repeats == 0 for r in c)
    pdf = frame.filter("run_id = 0").toPandas().sort_values("sample_idx")
    step = (pdf["chainage_m"].iloc[-1] - pdf["chainage_m"].iloc[0]) / (len(pdf) - 1)
    win = round(40 / step)
    half = (win + (win % 2 == 0)) // 2
    flags = pdf["dq_flag"].to_numpy()
    assert (flags[:half] == "edge").all() and (flags[-half:] == "edge").all() and (flags[half:-half] == "clean").all()
    r = pd.Series(pdf["r_mid_nt"].astype(float).to_numpy())
    w = round(5 / step)
    w += w % 2 == 0
    roll = r.rolling(w, center=True, min_periods=w)
    np.testing.assert_allclose(pdf["w5m_std_nt"].to_numpy(dtype=float), roll.std().to_numpy(), rtol=1e-3, atol=1e-2)
    np.testing.assert_allclose(pdf["w5m_max_nt"].to_numpy(dtype=float), roll.max().to_numpy(), rtol=1e-5)
    # the first source is a strong peak whose shape reaches the rows around it
    near = pdf[(pdf["chainage_m"] - 130).abs() < 4]
    assert near["peak_prominence_nt"].max() > 150 and near["fwhm_m"].notna().any()
    frame.unpersist()


CORRUPTIONS = {
    "schema": lambda d: d.assign(b_lo_nt=d["b_lo_nt"].where(d["sample_idx"] != 7, 200000.0)),
    "range": lambda d: d.assign(b_lo_nt=d["b_lo_nt"].where(d["sample_idx"] != 7, 999999.0)),
    "saturation": lambda d: d.assign(b_mid_nt=d["b_mid_nt"].where(~d["sample_idx"].between(10, 16), 48800.0)),
    "duplicate_sample_idx": lambda d: pd.concat([d, d.iloc[[50]]]),
    "sample_idx_monotonic": lambda d: d.iloc[[*range(100), *range(200, 300), *range(100, 200), *range(300, len(d))]],
    "sample_idx_gap": lambda d: d[~d["sample_idx"].between(300, 400)],
    "gps_jump": lambda d: d.assign(lat=d["lat"].where(d["sample_idx"] != 500, CFG.lat0 + 0.5)),
}


@pytest.fixture(scope="module")
def corrupted(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    for i, (name, change) in enumerate(CORRUPTIONS.items()):
        write(root, change(walk(20 + i, 0, name, n=800)))
    write(root, walk(50, 0, "clean", n=800, dropout=0.0))
    write(root, walk(60, 0, "copied", n=800))
    write(root, walk(60, 1, "copied", n=800))
    rows = io.read_surveys(spark, root)
    return jobs.ingest(rows)


def test_each_corruption_fires_its_check(corrupted):
    got = {(r.survey_id, r.check_name): r for r in corrupted.dq.collect()}
    assert {c for _, c in got} == set(dq.GATES)
    for name in CORRUPTIONS:
        row = got[(f"{name}_R0", name)]
        assert row.status == dq.GATES[name] and row.n_affected >= 1, name
    assert got[("schema_R0", "schema")].n_affected == 1
    assert got[("saturation_R0", "saturation")].n_affected == 7
    assert got[("duplicate_sample_idx_R0", "duplicate_sample_idx")].n_affected == 1
    assert got[("copied_R0", "duplicate_content")].status == "fail"
    assert got[("copied_R1", "survey_overlap")].status == "fail"
    clean = {c: r.status for (s, c), r in got.items() if s == "clean_R0"}
    assert not [c for c, st in clean.items() if st == "fail"]


def test_gate_and_status(corrupted):
    status = {r.survey_id: r.status for r in corrupted.registry.collect()}
    assert status["clean_R0"] == "accepted" and status["gps_jump_R0"] == "accepted"
    assert {s for s, v in status.items() if v == "quarantined"} == {
        "schema_R0", "range_R0", "saturation_R0", "duplicate_sample_idx_R0", "sample_idx_monotonic_R0", "copied_R0", "copied_R1"
    }


def test_content_hash_invariants(spark):


    d = walk(70, n=200).assign(survey_id="a").drop(columns=["severity_smys"])
    cols = [c for c in d.columns if c not in ("survey_id", "line_id", "run_id")]

    def h(x):
        return content_hashes(spark.createDataFrame(x), "survey_id", cols).first().content_sha256

    base = h(d)
    assert h(d.sample(frac=1, random_state=1)) == base
    assert h(d[d.columns[::-1]]) == base
    assert h(d.assign(b_mid_nt=d["b_mid_nt"].round(5))) != h(d.assign(b_mid_nt=d["b_mid_nt"].round(5) + 0.01))
    assert h(d.assign(b_mid_nt=d["b_mid_nt"].round(5))) == h(d.assign(b_mid_nt=d["b_mid_nt"].round(5) + 1e-9))


def test_halves_are_rounded_as_other_engines_do(spark):
    x = [128.0787825, 4.1937085, 216.9121995, -128.0787825, 1e305, float("inf"), None]
    got = canonical(spark.createDataFrame([(v,) for v in x], "x double"), ["x"])
    want = duckdb.connect().execute("SELECT round(x, 6) + 0.0 FROM (SELECT unnest($1::DOUBLE[]) AS x)", [x]).fetchall()
    assert [tuple(r) for r in got.collect()] == want and want[0][0] == 128.078782


def test_stream_resumes_and_repeats_nothing(spark, tmp_path):
    root, store, ck = (str(tmp_path / n) for n in ("raw", "store", "ck"))
    cfg = ft.FeatureConfig(windows_m=(2.0, 5.0), detrend_window_m=10.0)
    write(root, walk(80, 0, "007", n=900))
    arrivals.run(spark, root, store, ck, CFG, cfg)
    first = spark.read.parquet(f"{store}/features").count()
    assert first == 900
    write(root, walk(81, 1, "007", n=900))
    arrivals.run(spark, root, store, ck, CFG, cfg)
    arrivals.run(spark, root, store, ck, CFG, cfg)
    feats = spark.read.parquet(f"{store}/features")
    assert feats.count() == 1800 and feats.select("line_id", "run_id", "sample_idx").distinct().count() == 1800
    assert spark.read.parquet(f"{store}/registry").count() == 2
    assert spark.read.parquet(f"{store}/feature_meta").count() == 2
    # the batch job over the same folder finds nothing new
    again = jobs.full_run(spark, root, store, CFG, cfg)
    assert {r.outcome for r in again.collect()} == {"noop"}
    reg_rows = spark.read.parquet(f"{store}/registry")
    corpus = io.read_features(spark, store, 3, reg_rows.select("survey_id", "surveyed_at"), reg_rows.agg(F.max("surveyed_at")).first()[0], ["007"])
    assert corpus.count() == 1800
