import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import ordered
from tracewright.operators import series as s
from tracewright.operators.ordered import indexed
from tracewright.operators.quantiles import median_mad


def frame(spark, cols, key="a", chunk=1 << 16, longest=None):
    n = len(next(iter(cols.values())))
    pdf = pd.DataFrame({"k": key, "i": np.arange(n), **cols})
    return indexed(spark.createDataFrame(pdf), ["k"], "i", longest, chunk)


def col(series, name):
    return series.df.orderBy("i").toPandas()[name].to_numpy(dtype=float)


@pytest.mark.parametrize("chunk", [1 << 16, 6])
def test_gradient_on_irregular_axis(spark, chunk):
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.uniform(0.2, 2, 30))
    y = rng.normal(size=30)
    got = s.gradient(frame(spark, {"x": x, "y": y}, chunk=chunk), "y", "x", "d")
    np.testing.assert_allclose(col(got, "d"), np.gradient(y, x), rtol=1e-9)


@pytest.mark.parametrize("chunk", [1 << 16, 4])
def test_interpolation_is_flat_beyond_the_ends(spark, chunk):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.uniform(0.1, 1, 40))
    known = rng.random(40) < 0.3
    known[:2], known[-3:] = False, False
    y = np.where(known, rng.normal(size=40), np.nan)
    got = s.interpolate(frame(spark, {"x": x, "y": y}, chunk=chunk), "x", {"z": F.when(~F.isnan("y"), F.col("y"))})
    np.testing.assert_allclose(col(got, "z"), np.interp(x, x[known], y[known]), rtol=1e-12)


def test_resample_matches_interp(spark):
    rng = np.random.default_rng(2)
    x = np.sort(rng.uniform(3, 9, 25))
    y = rng.normal(size=25)
    got = s.resample(frame(spark, {"x": x, "y": y}), "x", "y", 0.1).orderBy("grid_i").toPandas()
    grid = np.arange(x[0], x[-1], 0.1)
    np.testing.assert_allclose(got["grid_x"], grid, atol=1e-9)
    np.testing.assert_allclose(got["y"], np.interp(grid, x, y), atol=1e-9)


@pytest.mark.parametrize("chunk", [1 << 16, 11])
def test_rolling_statistics(spark, chunk):
    rng = np.random.default_rng(3)
    y = rng.normal(size=80)
    base = frame(spark, {"y": y, "w5": np.full(80, 5), "w9": np.full(80, 9)}, chunk=chunk)
    got = s.rolling_stats(base, "y", {"a": "w5", "b": "w9"}, 9).df.orderBy("i").toPandas()
    v = pd.Series(y)
    zc = pd.Series(np.r_[0.0, (np.signbit(y[1:]) != np.signbit(y[:-1])).astype(float)])
    for p, w in (("a", 5), ("b", 9)):
        r = v.rolling(w, center=True, min_periods=w)
        want = {"mean": r.mean(), "std": r.std(), "max": r.max(), "ptp": r.max() - r.min(), "kurt": r.kurt(),
                "zcr": zc.rolling(w, center=True, min_periods=w).mean(), "energy": (v * v).rolling(w, center=True, min_periods=w).sum()}
        for name, x in want.items():
            np.testing.assert_allclose(got[f"{p}_{name}"].to_numpy(dtype=float), x, atol=1e-8, err_msg=name)


@pytest.mark.parametrize("chunk", [1 << 16, 13])
@pytest.mark.parametrize("repeat", [False, True])
def test_rolling_median(spark, chunk, repeat):
    y = np.random.default_rng(4).normal(size=60)
    got = s.rolling_median(frame(spark, {"y": y, "w": np.full(60, 7)}, chunk=chunk), "y", "w", 7, "m", repeat)
    pad = np.r_[np.repeat(y[0], 3), y, np.repeat(y[-1], 3)]
    want = [np.median(pad[i : i + 7]) for i in range(60)] if repeat else pd.Series(y).rolling(7, center=True, min_periods=1).median()
    np.testing.assert_allclose(col(got, "m"), want)


@pytest.mark.parametrize("chunk", [1 << 16, 20])
def test_polynomial_smoothing_keeps_polynomials(spark, chunk):
    x = np.arange(70.0)
    y = 3 - 0.2 * x + 0.01 * x**2
    got = s.smooth_polynomial(frame(spark, {"y": y}, chunk=chunk), "y", 9, 2, "m")
    np.testing.assert_allclose(col(got, "m"), y, atol=1e-6)


def test_metre_frames_cross_blocks(spark):
    rng = np.random.default_rng(5)
    x = np.sort(rng.uniform(-40, 40, 200)).round(3)
    y = rng.normal(size=200)
    base = frame(spark, {"x": x, "y": y})
    got = s.metre_frames(base.df, ["k"], "x", 2.0, {"m": lambda w: F.avg("y").over(w)}, block_m=5.0).orderBy("i").toPandas()
    want = [y[np.abs(x - c) <= 2.0 + 1e-9].mean() for c in x]
    np.testing.assert_allclose(got["m"], want)


def naive_peaks(y):
    out, i = [], 1
    while i < len(y) - 1:
        if y[i - 1] < y[i]:
            j = i
            while j < len(y) - 1 and y[j + 1] == y[i]:
                j += 1
            if j < len(y) - 1 and y[j + 1] < y[i]:
                out.append((i + j) // 2)
            i = j
        i += 1
    return out


def naive_shape(y, p):
    l, lo = p, y[p]
    while l >= 0 and y[l] <= y[p]:
        lo, l = min(lo, y[l]), l - 1
    r, ro = p, y[p]
    while r < len(y) and y[r] <= y[p]:
        ro, r = min(ro, y[r]), r + 1
    prom = y[p] - max(lo, ro)
    h = y[p] - prom / 2
    i = p
    while y[i] > h:
        i -= 1
    left = i + ((h - y[i]) / (y[i + 1] - y[i]) if y[i] < h else 0)
    j = p
    while y[j] > h:
        j += 1
    right = j - ((h - y[j]) / (y[j - 1] - y[j]) if y[j] < h else 0)
    return prom, left, right


@pytest.mark.parametrize("chunk, known", [(1 << 16, 400), (25, None), (3, None)])
def test_peaks_prominence_and_width(spark, chunk, known, monkeypatch):
    monkeypatch.setattr(s, "LEVEL_FANOUT", 5)
    rng = np.random.default_rng(6)
    y = np.abs(np.convolve(rng.normal(size=240), np.ones(4), "same")).round(1)
    base = frame(spark, {"y": y}, chunk=chunk, longest=known)
    tops = s.local_maxima(base, "y")
    assert sorted(r.i for r in tops.collect()) == naive_peaks(y)
    prom = s.prominences(base, "y", tops)
    got = {r.i: (r.prominence, r.left_x, r.right_x) for r in s.half_widths(base, "y", prom).collect()}
    assert sorted(got) == naive_peaks(y)
    for p, g in got.items():
        np.testing.assert_allclose(g, naive_shape(y, p), atol=1e-9, err_msg=str(p))


@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_peak_table_and_flanks(spark, chunk):
    rng = np.random.default_rng(8)
    x = np.arange(400)
    y = rng.uniform(0, 0.3, 400)
    for c, h, w in ((60, 30, 6), (180, 50, 9), (230, 20, 5), (350, 40, 12)):
        y = y + h / (1 + ((x - c) / w) ** 2) ** 1.5
    base = frame(spark, {"y": y, "st": np.full(400, 0.1)}, chunk=chunk)
    st = median_mad(base.df, ["k"], "y").first()
    sigma = 1.4826 * st.mad
    want = {p: naive_shape(y, p) for p in naive_peaks(y)}
    want = {p: v for p, v in want.items() if v[0] >= 4 * sigma}
    peaks = s.peak_shapes(base, "y", 4.0)
    got = {r.i: r for r in s.decay_exponents(base, "y", peaks, (0.5, 3.0), "st").collect()}
    assert sorted(got) == sorted(want)
    order = sorted(want)
    for n, p in enumerate(order):
        prom, left, right = want[p]
        w = max(1.0, right - left)
        assert got[p].prominence == pytest.approx(prom)
        assert got[p].width == pytest.approx(w)
        assert got[p].asymmetry == pytest.approx(((right - p) - (p - left)) / w)
        lo_b = 0 if n == 0 else (order[n - 1] + p) // 2
        hi_b = 399 if n == len(order) - 1 else (p + order[n + 1]) // 2
        lo = max(1, int(0.5 * w))
        off = np.arange(lo, max(lo + 2, int(3 * w)) + 1)
        js = np.r_[p - off, p + off]
        ds = np.r_[off, off] * 0.1
        ok = (js >= lo_b) & (js <= hi_b)
        fit = np.polyfit(np.log(ds[ok]), np.log(y[js[ok]]), 1)[0]
        assert got[p].decay_exponent == pytest.approx(fit, rel=1e-6)
    spread = s.assign_to_peaks(base, peaks, ["prominence"], 2.0, "d").df.orderBy("i").toPandas()
    for i in range(400):
        near = min(order, key=lambda p: (abs(p - i), p))
        w = max(1.0, want[near][2] - want[near][1])
        if abs(near - i) <= 2 * w:
            assert spread["d"][i] == abs(near - i) and spread["prominence"][i] == pytest.approx(want[near][0])
        else:
            assert np.isnan(spread["d"][i])


def test_windows_of_many_short_groups_in_one_call(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sizes, wins = [1, 2, 3, 40, 7, 300, 12, 5], [3, 3, 5, 7, 7, 9, 13, 3]
    parts = []
    for k, (n, w) in enumerate(zip(sizes, wins)):
        v = rng.normal(50 * k, 3, n)
        v[rng.random(n) < 0.05] = np.nan
        parts.append(pd.DataFrame({"k": k, "i": np.arange(n), "v": v, "w": w}))
    rows = pd.concat(parts, ignore_index=True)
    for at_once in (1, 50, 1 << 15):
        monkeypatch.setattr(ordered, "CALL_ROWS", at_once)
        made = ordered.indexed(spark.createDataFrame(rows).withColumn("v", F.when(~F.isnan("v"), F.col("v"))), ["k"], "i", longest=300)
        got = s.rolling_stats(made, "v", {"w": "w"}, 13).df.toPandas().sort_values(["k", "i"], ignore_index=True)
        for part in parts:
            r = part.v.rolling(int(part.w[0]), center=True, min_periods=int(part.w[0]))
            mine = got[got.k == part.k[0]].reset_index(drop=True)
            want = {"w_mean": r.mean(), "w_std": r.std(), "w_max": r.max(), "w_ptp": r.max() - r.min(), "w_energy": (part.v**2).rolling(int(part.w[0]), center=True, min_periods=int(part.w[0])).sum()}
            want |= {"w_kurt": r.kurt()} if part.w[0] >= 4 else {}
            for c, x in want.items():
                np.testing.assert_array_equal(mine[c].to_numpy(), x.to_numpy(), c)


def test_groups_are_never_cut_between_calls(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CALL_ROWS", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = spark.range(400).select(F.when(F.col("id") >= 10, F.col("id") % 17).alias("k"), F.col("id").alias("i"))
        call = lambda pdf, at: pd.DataFrame({"k": pdf.k.to_numpy()[at], "n": np.diff([*at, len(pdf)]), "calls": len(at)})
        got = ordered.map_groups(rows, ["k"], "i", call, "k long, n long, calls long").toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = rows.groupBy("k").count().toPandas()
    assert sorted(zip(got.k.fillna(-1), got.n)) == sorted(zip(want.k.fillna(-1), want["count"]))


@pytest.mark.parametrize("chunk", [1 << 16, 5])
@pytest.mark.parametrize("at_once", [1, 50, 1 << 15])
def test_medians_and_peaks_of_many_short_groups_in_one_call(spark, monkeypatch, chunk, at_once):
    monkeypatch.setattr(ordered, "CALL_ROWS", at_once)
    rng = np.random.default_rng(8)
    parts = [
        pd.DataFrame({"k": k, "i": np.arange(n), "v": rng.integers(0, 30, n) + 0.5, "w": w})
        for k, (n, w) in enumerate(zip([1, 2, 3, 40, 7, 90, 12, 5], [1, 3, 5, 7, 7, 9, 13, 3]))
    ]
    made = indexed(spark.createDataFrame(pd.concat(parts)), ["k"], "i", 90 if chunk > 90 else None, chunk)
    for ends in (False, True):
        plan = s.rolling_median(made, "v", "w", 13, "m", repeat_ends=ends)
        assert "FlatMapGroupsInPandas" not in plan.df._jdf.queryExecution().executedPlan().toString()
        got = plan.df.toPandas().sort_values(["k", "i"], ignore_index=True)
        for part in parts:
            w, v = int(part.w[0]), part.v
            if ends:
                v = pd.Series(np.r_[np.repeat(v.iloc[0], w // 2), v, np.repeat(v.iloc[-1], w // 2)])
            want = v.rolling(w, center=True, min_periods=1).median().to_numpy()
            want = want[w // 2 : len(v) - w // 2] if ends else want
            np.testing.assert_array_equal(got[got.k == part.k[0]].m.to_numpy(), want)
    tops = s.local_maxima(made, "v")
    found = s.prominences(made, "v", tops)
    if chunk > 90:
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["k"], r["i"]): r["prominence"] for r in found.collect()}
    want = {}
    for r in tops.collect():
        v = parts[r["k"]].v.to_numpy()
        left = [j for j in range(r["i"]) if v[j] > r["value"]]
        right = [j for j in range(r["i"] + 1, len(v)) if v[j] > r["value"]]
        a, b = max(left, default=-1), min(right, default=len(v))
        want[r["k"], r["i"]] = r["value"] - max(v[a + 1 : r["i"] + 1].min(), v[r["i"] : b].min())
    assert got == want


def test_small_fits_of_many_groups_in_one_call(spark, monkeypatch):
    from tracewright.operators import baseline

    by, grouped = [], baseline.map_groups
    monkeypatch.setattr(baseline, "map_groups", lambda df, keys, *rest: by.append(keys) or grouped(df, keys, *rest))
    x, k = np.tile(np.arange(30.0), 6), np.repeat(np.arange(6), 30)
    rows = spark.createDataFrame(pd.DataFrame({"k": k, "x": x, "y": k + 2 * x}))
    fits = baseline.robust_polynomial(rows, ["k"], "x", "y", degree=1, longest=30).collect()
    for r in fits:
        np.testing.assert_allclose(r["coef"], [r["k"] + 29.0, 29.0], atol=1e-6)
    assert len(fits) == 6 and by == [["k"]]


@pytest.mark.parametrize("chunk", [1 << 16, 7])
@pytest.mark.parametrize("block", [1 << 16, 16])
def test_resampling_orders_rows_and_no_points(spark, chunk, block):
    rng = np.random.default_rng(10)
    x = np.r_[np.sort(rng.integers(0, 40, 25)) * 0.3, 90.0, 90.0, 91.0]
    y = rng.normal(size=len(x))
    y[[0, 5, 6, 26]] = np.nan
    made = frame(spark, {"x": x, "y": y}, chunk=chunk)
    made = made.with_df(made.df.withColumn("y", F.when(~F.isnan("y"), F.col("y"))))
    made = made.with_df(made.df.unionByName(made.df.withColumns({"k": F.lit("none"), "y": F.lit(None).cast("double")})))
    got = s.resample(made, "x", "y", 0.1, block)
    assert "Sort [k#" not in got._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]
    got = got.toPandas().sort_values(["k", "grid_i"])
    grid = x[0] + np.arange(int(np.ceil((x[-1] - x[0]) / 0.1))) * 0.1
    known = ~np.isnan(y)
    kx, ky = x[known], y[known]
    want = []
    for g in grid:
        at = int(np.searchsorted(kx, g, side="right"))
        if at in (0, len(kx)):
            want.append(ky[min(at, len(kx) - 1)])
        else:
            want.append(ky[at - 1] + (ky[at] - ky[at - 1]) / (kx[at] - kx[at - 1]) * (g - kx[at - 1]))
    mine = got[got.k == "a"]
    assert mine.grid_i.tolist() == list(range(len(grid))) and mine.grid_x.tolist() == grid.tolist()
    np.testing.assert_allclose(mine.y, want, rtol=1e-12)
    empty = got[got.k == "none"]
    assert len(empty) == len(grid) and empty.y.isna().all()
