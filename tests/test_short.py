"""Short series are worked on whole, with the results of the steps by chunks, and without writing them."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from test_surveys import CFG, walk
from tracewright.operators import baseline, ordered, series, short
from tracewright.operators import features as ft
from tracewright.operators import registration as reg
from tracewright.operators.ordered import indexed
from tracewright.plans import catalogue_series

KEYS = ["survey_id", "sample_idx"]


def lineitems(spark, path, n=1500, suppliers=5, seed=4):
    """A lineitem table whose last supplier has a few rows, with nulls in most columns."""
    rng = np.random.default_rng(seed)
    supplier = rng.integers(0, suppliers - 1, n)
    supplier[:5] = suppliers - 1
    df = pd.DataFrame({
        "l_orderkey": np.arange(n), "l_partkey": rng.integers(0, 50, n), "l_suppkey": supplier, "l_linenumber": rng.integers(1, 5, n),
        "l_quantity": rng.integers(1, 50, n).astype(float), "l_extendedprice": rng.uniform(1e3, 1e5, n).round(2), "l_discount": rng.integers(0, 11, n) / 100,
        "l_tax": 0.01, "l_returnflag": rng.choice(["R", "A", "N"], n), "l_linestatus": "O",
        "l_shipdate": pd.Timestamp("1995-01-01") + pd.to_timedelta(rng.integers(0, 2000, n), unit="D"),
    })
    rows = spark.createDataFrame(df).withColumn("l_linenumber", F.col("l_linenumber").cast("int"))
    for i, c in enumerate(("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")):
        rows = rows.withColumn(c, F.when(F.col("l_orderkey") % 53 != i, F.col(c)))
    rows.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def written(monkeypatch, *modules):
    """Columns of what is checkpointed from now on."""
    out = []
    for m in modules:
        monkeypatch.setattr(m, "cut", lambda df, cut=m.cut: out.append(df.columns) or cut(df))
    return out


@pytest.fixture(scope="module")
def surveys(spark):
    kinds = [walk(11, 0, n=1500), walk(12, 1, n=900, dropout=1.0), walk(13, 2, n=100)[:60], walk(14, 3, n=700), walk(15, 4, n=1200), walk(16, 5, n=800), walk(17, 6, n=100)[:10]]
    kinds[3]["b_mid_nt"] = np.nan
    kinds[4].loc[100:300, "b_mid_nt"] = np.nan
    kinds[5].loc[1:, ["lat", "lon"]] = np.nan
    kinds[5].loc[0, ["lat", "lon"]] = CFG.lat0, CFG.lon0
    df = pd.concat(kinds)
    df["survey_id"] = df["line_id"] + "_R" + df["run_id"].astype(str)
    sdf = spark.createDataFrame(df[[*KEYS, "t_s", "lat", "lon", "b_mid_nt", "run_id"]])
    for c in ("lat", "lon", "b_mid_nt"):
        sdf = sdf.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return sdf.persist()


def same(a, b, keys=KEYS):
    a, b = (x.sort_values(keys, ignore_index=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c], b[c], rtol=1e-6, atol=1e-6, err_msg=c)
        else:
            assert a[c].tolist() == b[c].tolist(), c


def test_whole_surveys_are_registered_as_those_by_chunks(surveys):
    whole = reg.registered(indexed(surveys, ["survey_id"], "sample_idx", 1500), CFG)
    by_chunks = reg.registered(indexed(surveys, ["survey_id"], "sample_idx", 1500, chunk_rows=400), CFG)
    assert [(f.name, f.dataType) for f in whole.schema] == [(f.name, f.dataType) for f in by_chunks.select(*whole.columns).schema]
    got = whole.toPandas()
    assert {"ok", "no reliable comb found", "survey shorter than the comb search"} == set(got["note"])
    same(got, by_chunks.select(*whole.columns).toPandas())


def test_short_surveys_are_dealt_out_once_and_not_written(spark, tmp_path, monkeypatch):
    seen = written(monkeypatch, reg, catalogue_series, ordered)
    got = catalogue_series.survey_registration(spark, lineitems(spark, tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert got.filter("dist_to_weld_m is not null").count() > 300 and seen == []


def test_the_features_of_short_surveys_are_not_written(spark, tmp_path, monkeypatch):
    seen = written(monkeypatch, reg, catalogue_series, ordered, baseline, series, ft)
    got = catalogue_series.feature_frame(spark, lineitems(spark, tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    pdf = got.toPandas()
    assert seen == [] and pdf["survey_id"].nunique() == 5 and pdf["r_mid_nt"].isna().any() and pdf["w25m_std_nt"].notna().any()


@pytest.mark.parametrize("window,policy", [(40.0, "flag"), (0.0, "drop")])
def test_features_of_whole_surveys_are_those_by_chunks(spark, window, policy):
    kinds = [walk(31, 0, n=1500), walk(32, 1, n=1200), walk(33, 2, n=300), walk(34, 3, n=100)[:2], walk(35, 4, n=300), walk(36, 5, n=800)]
    kinds[1].loc[200:260, "b_mid_nt"] = np.nan
    kinds[1].loc[900, ["b_lo_nt", "b_hi_nt"]] = np.nan
    kinds[2]["b_hi_nt"] = np.nan
    kinds[4][["b_lo_nt", "b_mid_nt", "b_hi_nt"]] = np.nan
    kinds[5].loc[300:420, "b_mid_nt"] = 49500.0  # flat tops
    df = pd.concat(kinds).rename(columns={"chainage_true_m": "chainage_m"})
    df["survey_id"], df["dist_to_weld_m"] = df["line_id"] + "_R" + df["run_id"].astype(str), 1.0
    rows = spark.createDataFrame(df[[*KEYS, "line_id", "run_id", "chainage_m", "dist_to_weld_m", "lat", "lon", "b_lo_nt", "b_mid_nt", "b_hi_nt"]])
    for c in ("lat", "lon", "b_lo_nt", "b_mid_nt", "b_hi_nt"):
        rows = rows.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    rows = rows.withColumn("sample_idx", F.col("sample_idx") * 3 + F.col("sample_idx") % 2).persist()
    cfg = ft.FeatureConfig(detrend_window_m=window, edge_policy=policy, windows_m=(1.0, 2.0, 5.0))
    whole, by_chunks = (ft.feature_frame(indexed(rows, ["survey_id"], "sample_idx", 1500, chunk_rows=n), cfg) for n in (1 << 16, 700))
    assert whole.dtypes == by_chunks.dtypes
    got = whole.toPandas()
    assert got["fwhm_m"].notna().any() and got["decay_exponent"].notna().any() and not (got["run_id"] == 4).any()
    want = by_chunks.toPandas()
    for x in (got, want):
        for w in ft.window_prefixes(cfg):
            # the kurtosis of a flat stretch is rounding
            x.loc[x[f"{w}_std_nt"] < 1, f"{w}_kurt"] = np.nan
    pd.testing.assert_frame_equal(*(x.sort_values(KEYS, ignore_index=True) for x in (got, want)), rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("query", ["survey_registration", "feature_frame", "dead_reckoning"])
def test_one_long_survey_leaves_the_short_ones_whole(spark, tmp_path, monkeypatch, query):
    path, made = lineitems(spark, tmp_path, n=1200, suppliers=4), catalogue_series._walks
    run = getattr(catalogue_series, query)
    want = run(spark, path).toPandas()
    largest = int(want["survey_id"].value_counts().max())
    assert (want["survey_id"].value_counts() == largest).sum() == 1
    monkeypatch.setattr(catalogue_series, "_walks", lambda *a: replace(made(*a), chunk_rows=largest - 1))
    seen = []
    for m in (reg, series, ft):
        monkeypatch.setattr(m, "cut", lambda df, cut=m.cut: (seen.append({r[0] for r in df.select("survey_id").distinct().collect()}) if "survey_id" in df.columns else None) or cut(df))
    got = run(spark, path).toPandas()
    assert all(len(s) <= 1 for s in seen)
    same(got, want)


def test_a_long_grid_is_made_in_blocks():
    d = walk(21, n=1500, dropout=0.0)
    x = np.maximum.accumulate(d["chainage_true_m"].to_numpy())
    fix = np.ones(len(d), dtype=bool)
    one, many = (short.registered(x, d["b_mid_nt"].to_numpy(), fix, CFG, 0.1, 600, (60, 180), most) for most in (1 << 20, 250))
    assert one["n_welds_detected"] > 5 and one["n_welds_detected"] == many["n_welds_detected"]
    np.testing.assert_allclose(one["chainage_m"], many["chainage_m"], atol=1e-9)


@pytest.mark.parametrize("rows", [1, 50, 1 << 15])
def test_no_key_falls_into_two_calls(spark, monkeypatch, rows):
    monkeypatch.setattr(ordered, "CALL_ROWS", rows)
    n = 3000
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(n) // 97, "i": np.arange(n), "v": 1.0})).withColumn("k", F.when(F.col("k") > 0, F.col("k")))

    def call(c, starts):
        ends = [*starts[1:], len(c["v"])]
        keep = np.arange(len(c["v"])) % 2 == 0 if rows == 50 else np.ones(len(c["v"]), dtype=bool)
        return {"total": np.concatenate([np.cumsum(c["v"][a:b]) for a, b in zip(starts, ends)]), "keep": keep}

    made = ordered.T.StructType.fromDDL("total double").fields
    got = ordered.map_short(indexed(df.repartition(7), ["k"], "i", 97), ["v"], call, made).toPandas()
    assert got["k"].notna().all() and (got["total"] == got["i"] % 97 + 1).all()
    assert rows == 50 or len(got) == n - 97


def test_windows_of_short_keys_are_dealt_out_once(spark, tmp_path):
    path = lineitems(spark, tmp_path)
    dense, gapped = (f(spark, path) for f in (catalogue_series.rolling_stats, catalogue_series.rolling_stats_gapped))
    for df in (dense, gapped):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    a, b = dense.toPandas(), gapped.toPandas()
    assert len(a) > 1400 and a["kurt"].notna().any() and a["mean"].isna().any()
    same(a.assign(sample_idx=a["sample_idx"] * 3 + a["sample_idx"] % 2), b, ["l_suppkey", "sample_idx"])


@pytest.mark.parametrize("chunk,most", [(1 << 16, 1 << 16), (16, 1 << 16), (16, 100), (3, 100)])
@pytest.mark.parametrize("own", [False, True])
def test_crossings_at_the_borders_of_chunks(spark, monkeypatch, chunk, most, own):
    """Keys that may lie in one task, and keys that may not."""
    monkeypatch.setattr(ordered, "CHUNK_ROWS", most)
    rng = np.random.default_rng(5)
    n = 400
    df = pd.DataFrame({"k": np.repeat(["a", "b"], n), "i": np.tile(np.cumsum(rng.integers(1, 9, n)), 2), "y": rng.normal(size=2 * n), "w": np.repeat([5, 21], n)})
    df["none"] = rng.random(2 * n) < 0.1
    rows = spark.createDataFrame(df).withColumn("y", F.when(F.col("i") % 17 == 0, float("nan")).when(~F.col("none"), F.col("y")))
    reach = F.expr("w div 2") if own else 10
    got = series.rolling_stats(indexed(rows, ["k"], "i", chunk_rows=chunk), "y", {"w": "w"}, reach).df.orderBy("k", "i").toPandas()
    sign = np.where(df["i"] % 17 == 0, 0.0, np.where(df["none"], np.nan, df["y"] < 0))
    flip = np.append(0.0, (sign[1:] != sign[:-1]) & ~np.isnan(sign[1:]) & ~np.isnan(sign[:-1]))
    flip[n] = 0.0
    value = df["y"].where(~df["none"] & (df["i"] % 17 != 0))
    for k, (a, b, w) in enumerate(((0, n, 5), (n, 2 * n, 21))):
        part = got[a:b]
        np.testing.assert_allclose(part["w_zcr"].to_numpy(float), pd.Series(flip[a:b]).rolling(w, center=True, min_periods=w).mean(), atol=1e-12)
        np.testing.assert_allclose(part["w_max"].to_numpy(float), value[a:b].rolling(w, center=True, min_periods=w).max())
