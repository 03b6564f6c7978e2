import hashlib
import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import baseline, drift, growth, metrics, profile
from tracewright.operators.islands import block_heatmap, cluster_indications, select_budget, truth_registry
from tracewright.operators.guards import GuardError, assert_no_forbidden, assert_point_in_time, join_one_to_one
from tracewright.operators import quantiles
from tracewright.operators.ordered import indexed
from tracewright.operators.quantiles import quantile_edges


def scored(spark, edits, edge=(), n=200):
    pdf = pd.DataFrame({"survey_id": "S", "sample_idx": np.arange(n), "chainage_m": np.arange(n) * 1.0, "score": 0.0, "dq": "clean"})
    for rows, v in edits:
        pdf.loc[rows, "score"] = v
    pdf.loc[list(edge), "dq"] = "edge"
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("chunk", [1 << 16, 16])
def test_indication_cases(spark, chunk):
    def run(*edits, edge=()):
        s = indexed(scored(spark, edits, edge), ["survey_id"], "sample_idx", None, chunk)
        return sorted(cluster_indications(s, "score", 1.0, "v1", edge=F.col("dq") == "edge").collect(), key=lambda r: r.peak_sample_idx)

    one = run((slice(95, 105), 5.0), (100, 9.0))
    assert [(r.peak_sample_idx, r.chainage_start_m, r.chainage_end_m, r.anomaly_score, r.dq_flag, r.p_defect_cal) for r in one] == [(100, 95.0, 105.0, 9.0, "clean", 1.0)]
    two = run((slice(20, 25), 5.0), (slice(150, 155), 6.0))
    assert [(r.peak_sample_idx, r.chainage_start_m, r.chainage_end_m) for r in two] == [(20, 20.0, 25.0), (150, 150.0, 155.0)]
    assert [round(r.p_defect_cal, 3) for r in two] == [0.97, 1.0]
    assert run((slice(0, 10), 1.0)) == []
    assert run((slice(95, 105), 5.0), edge=[97])[0].dq_flag == "edge"
    assert run((slice(95, 105), 5.0))[0].indication_id == run((slice(95, 105), 5.0))[0].indication_id


def test_missing_index_does_not_split_a_run(spark):
    df = scored(spark, [(slice(10, 20), 5.0)]).filter("sample_idx <> 15")
    s = indexed(df, ["survey_id"], "sample_idx", None, 4)
    assert cluster_indications(s, "score", 1.0, "v1").count() == 1


def test_budget_is_at_least_one_and_rounds_to_even(spark):
    ind = spark.createDataFrame([("a", i, float(i)) for i in range(10)] + [("b", 0, 1.0)], "survey_id string, peak_sample_idx long, anomaly_score double")
    ext = spark.createDataFrame([("a", 500.0), ("b", 1.0)], "survey_id string, length_m double")
    got = select_budget(ind, ext, 5.0).orderBy("survey_id", "rank").collect()
    assert [(r.survey_id, r.anomaly_score) for r in got] == [("a", 9.0), ("a", 8.0), ("b", 1.0)]


def test_label_rows_to_registry(spark):
    pdf = pd.DataFrame({"line_id": "LINE000", "i": np.arange(400), "c": np.arange(400) * 1.0, "t": "none"})
    for a, b, t in ((50, 55, "scc"), (200, 206, "corrosion"), (300, 310, "interference")):
        pdf.loc[a:b, "t"] = t
    s = indexed(spark.createDataFrame(pdf), ["line_id"], "i", None, 32)
    kinds = {"defect": F.col("t").isin("scc", "corrosion"), "interference": F.col("t") == "interference"}
    got = {r.source_id: (r.defect_type, r.chainage_start_m, r.chainage_end_m) for r in truth_registry(s, "line_id", "c", kinds, F.col("t")).collect()}
    assert got == {"LINE000_defect_00": ("scc", 50.0, 55.0), "LINE000_defect_01": ("corrosion", 200.0, 206.0), "LINE000_interference_00": ("interference", 300.0, 310.0)}


def test_block_heatmap(spark):
    df = spark.createDataFrame([("L1", 10.0, 0.2), ("L1", 90.0, 0.9), ("L1", 250.0, 0.4), ("L2", 10.0, 0.6)], "l string, c double, r double")
    got = {(r.l, r.block_start_m): (r.max_metric, r.n) for r in block_heatmap(df, "l", "c", 100.0, F.col("r")).collect()}
    assert got == {("L1", 0.0): (0.9, 2), ("L1", 200.0): (0.4, 1), ("L2", 0.0): (0.6, 1)}


def test_rates(spark):
    matched = spark.createDataFrame([("r0", "defect"), ("r0", "interference"), ("r0", None)], "run string, kind string")
    runs = spark.createDataFrame([("r0",), ("r1",)], "run string")
    got = {r.run: (r.false_dig_rate, r.interference_fraction) for r in metrics.dig_rates(matched, runs, "run", "kind").collect()}
    assert got == {"r0": (pytest.approx(2 / 3), pytest.approx(1 / 3)), "r1": (0.0, 0.0)}
    m = spark.createDataFrame([("r0", "d0"), ("r1", "d0"), ("r1", "d1")], "run string, s string")
    reg = spark.createDataFrame([("L", "d0", "defect"), ("L", "d1", "defect")], "line string, s string, kind string")
    three = spark.createDataFrame([("L", r) for r in ("r0", "r1", "r2")], "line string, run string")
    hits = {r.s: r.hit_rate for r in metrics.hit_rates(m, reg, three, "line", "run", "s").collect()}
    assert hits == {"d0": pytest.approx(2 / 3), "d1": pytest.approx(1 / 3)}


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(10, 2, 60)
    units = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "u long, x double")
    r = metrics.bootstrap(units, [], "u", ["x"], 400, 0.95, 1).first()
    half = 1.96 * v.std(ddof=1) / math.sqrt(60)
    assert r.x_point == pytest.approx(v.mean()) and r.x_lo < r.x_point < r.x_hi
    assert (r.x_hi - r.x_lo) / 2 == pytest.approx(half, rel=0.3)
    again = metrics.bootstrap(units.repartition(3), [], "u", ["x"], 400, 0.95, 1).first()
    assert again.x_lo == pytest.approx(r.x_lo) and again.x_hi == pytest.approx(r.x_hi)
    pairs = units.withColumn("y", F.col("x") - 1)
    d = metrics.paired_bootstrap(pairs, [], "u", "x", "y", 200, 0.95, 1).first()
    assert d.delta_lo == pytest.approx(1.0) and d.delta_hi == pytest.approx(1.0)


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0], [1.0, 1.0, 1.0, 2.0, 3.0], [5.0, 5.0]])
def test_quantile_bins_equal_qcut(spark, values):
    got = metrics.bin_by_quantiles(spark.createDataFrame([(v,) for v in values], "x double"), [], "x", 10).orderBy("x").toPandas()
    d = len(set(values))
    want = [0] * len(values) if d < 2 else pd.qcut(pd.Series(sorted(values)), min(10, d), duplicates="drop", labels=False).tolist()
    # bins are numbered by edge, so empty ones may leave holes in neither
    assert pd.factorize(got["bin"])[0].tolist() == pd.factorize(pd.Series(want))[0].tolist()


def test_drift_cases(spark):
    rng = np.random.default_rng(2)
    base, same, moved = rng.normal(size=5000), rng.normal(size=4000), rng.normal(3, 1, 4000)

    def frame(v):
        return spark.createDataFrame(pd.DataFrame({"feature": "f", "x": v}))

    ref = frame(base)
    summary = drift.feature_summary(ref)
    edges = np.quantile(base, np.linspace(0, 1, 11))
    for cur, check in ((same, lambda p: p < 0.05), (moved, lambda p: p > 0.3)):
        r = drift.feature_drift(ref, frame(cur), summary).first()
        rc, cc = np.histogram(base, edges)[0] / 5000, np.histogram(np.clip(cur, edges[0], edges[-1]), edges)[0] / len(cur)
        rc, cc = np.clip(rc, 1e-6, None), np.clip(cc, 1e-6, None)
        assert r.psi == pytest.approx(float(np.sum((cc - rc) * np.log(cc / rc)))) and check(r.psi)
        both = np.sort(np.r_[base, cur])
        gap = np.abs(np.searchsorted(np.sort(base), both, "right") / 5000 - np.searchsorted(np.sort(cur), both, "right") / len(cur)).max()
        assert r.ks_stat == pytest.approx(gap)
        assert (r.ks_pvalue < 0.01) == (gap > 0.1)


def test_coverage_case(spark):
    df = spark.createDataFrame([(1.0, 0.0, 5.0), (2.0, 0.0, 5.0), (3.0, 0.0, 5.0), (4.0, 10.0, 20.0)], "y double, lo double, hi double")
    r = metrics.coverage_vs_nominal(df, "y", "lo", "hi", 0.9).first()
    assert (r.empirical, r.n, r.below_nominal) == (0.75, 4, True)


def test_growth_cases(spark):
    obs = spark.createDataFrame([("D0", 0, 30.0), ("D0", 1, 34.5), ("D0", 2, 39.675), ("D1", 0, 50.0)], "d string, run long, y double")
    got = {r.d: r for r in growth.fit_rates(obs, "d", "run", "y", 2).collect()}
    assert got["D1"].n_obs == 1 and got["D1"].shrinkage_weight == 0 and got["D1"].own_rate is None
    assert got["D0"].shrinkage_weight > 0 and got["D0"].shrunk_rate == pytest.approx(math.log(1.15))
    assert got["D1"].shrunk_rate == pytest.approx(math.log(1.15))
    rng = np.random.default_rng(4)
    rows = [(f"D{i}", r, float(b * 1.15**r + rng.normal(0, 0.5))) for i, b in enumerate(rng.uniform(20, 60, 20)) for r in range(3)]
    obs = spark.createDataFrame(rows, "d string, run long, y double")
    assert growth.pooled_rate(growth.log_slopes(obs, "d", "run", "y")).first().pooled_rate == pytest.approx(math.log(1.15), abs=0.05)
    errs = growth.gate_errors(obs, "d", "run", "y", [0, 1], 2, 2)
    r = metrics.paired_bootstrap(errs, [], "d", "no_growth_error", "model_error", 300, 0.95, 1).first()
    assert errs.count() == 20 and r.delta_lo > 0
    assert growth.pooled_rate(growth.log_slopes(obs.filter("run = 0"), "d", "run", "y")).first()[:2] == (0.0, float("inf"))


def test_remaining_life(spark):
    df = spark.createDataFrame([(30.0, 40.0, 50.0, 0.1), (90.0, 95.0, 120.0, 0.1), (1.0, 2.0, 3.0, -0.1)], "lo double, med double, hi double, r double")
    a, b, c = [r[-3:] for r in growth.remaining_life(df, "lo", "med", "hi", "r", 100.0).collect()]
    assert a == pytest.approx((math.log(2) * 10, math.log(2.5) * 10, math.log(100 / 30) * 10))
    assert b[0] == 0.0 and b[2] == pytest.approx(math.log(100 / 90) * 10)
    assert c == (float("inf"),) * 3


@pytest.mark.parametrize("longest", [None, 1000])
def test_robust_polynomial(spark, longest):
    s = 0.5 * np.arange(600)
    clean = 45000 + 0.02 * s - 3e-6 * s**2 + 1e-8 * s**3
    spiky = clean + np.where((np.arange(600) >= 290) & (np.arange(600) < 310), 400, 0) + np.random.default_rng(1).normal(0, 1, 600)
    pdf = pd.concat([pd.DataFrame({"k": "clean", "s": s, "y": clean}), pd.DataFrame({"k": "spiky", "s": s, "y": spiky})])
    df = spark.createDataFrame(pdf)
    coefs = baseline.robust_polynomial(df, ["k"], "s", "y", longest=longest)
    got = baseline.remove_polynomial(df, ["k"], "s", "y", coefs, "r").toPandas()
    assert (got[got.k == "clean"]["r"].abs() / 45000).max() < 1e-6
    rob = got[got.k == "spiky"].sort_values("s")
    fitted = rob["y"].to_numpy() - rob["r"].to_numpy()
    ols = np.polyval(np.polyfit(s, spiky, 3), s)
    assert np.abs(fitted - clean).max() < 1.0 < np.abs(ols - clean).max()


def test_fold_key(spark):
    import hashlib

    from tracewright.functions.scalars import group_key, hash_fold

    df = spark.createDataFrame([("LINE000", c, r) for c in (0.0, 99.9, 100.0, 350.0) for r in (0, 1)], "line string, c double, run int")
    out = metrics.with_fold(df, group_key(F.col("line"), F.col("c"), 100.0), 5).collect()
    for r in out:
        assert r.fold == int(hashlib.sha256(r.group_key.encode()).hexdigest(), 16) % 5
    assert {r.fold for r in out if r.group_key == "LINE000::3"} == {3}
    assert hash_fold(F.lit("x"), 3) is not None


def test_guards(spark):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-03-01")], "s string, d string").withColumn("t", F.to_timestamp("d"))
    with pytest.raises(GuardError, match="b"):
        assert_point_in_time(df, pd.Timestamp("2024-02-01"), "t", "s")
    assert assert_point_in_time(df, pd.Timestamp("2024-03-01"), "t", "s") is df
    with pytest.raises(GuardError):
        join_one_to_one(df, df.union(df), ["s"])
    with pytest.raises(GuardError):
        assert_no_forbidden(["a", "defect"], ["defect"])


def test_skew_matches_pandas(spark):
    v = np.random.default_rng(5).gamma(2, 1, 80)
    r = spark.createDataFrame(pd.DataFrame({"x": v})).agg(profile.sample_skew("x").alias("s"), profile.sample_kurtosis("x").alias("k")).first()
    assert r.s == pytest.approx(pd.Series(v).skew()) and r.k == pytest.approx(pd.Series(v).kurt())


def test_bootstrap_draws_large_counts_and_one_digest_a_draw(spark):
    counts = spark.createDataFrame([(0.3,), (0.5,), (1 - 1e-6,), (1 - 1e-9,)], "u double").select(metrics.poisson_one(F.col("u")).alias("n"))
    assert [r.n for r in counts.collect()] == [0.0, 1.0, 9.0, 11.0]
    # the weighted mean of one replicate follows from a digest for each unit
    units = spark.createDataFrame([(i, float(i)) for i in range(40)], "u long, x double")
    r = metrics.bootstrap(units, [], "u", ["x"], 1, 0.95, 7).first()
    draws = [int(hashlib.sha256(f"7|{i}|1".encode()).hexdigest()[:13], 16) / 2**52 for i in range(40)]
    weights = [sum(u >= t for t in metrics.POISSON_STEPS) for u in draws]
    assert r.x_lo == pytest.approx(sum(i * w for i, w in enumerate(weights)) / sum(weights))


def test_rows_of_a_few_keys_stay_where_they_are(spark):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(2000).select((F.col("id") % 3).cast("string").alias("feature"), F.col("id").cast("double").alias("x"))
        edges = quantile_edges(rows, ["feature"], "x", 4).withColumnRenamed("edges", "bin_edges")
        plans = [quantiles._cells(rows.withColumnRenamed("x", "__v"), ["feature"], [0.5], 1000), drift.reference_sample(rows, ["feature"], F.col("x").cast("string"), 20, 1),
                 drift.psi(rows, rows, edges)]
        for plan in plans:
            text = plan._jdf.queryExecution().executedPlan().toString()
            # what the sides tell comes by broadcast; small tables of bins may still meet by key
            assert text.count("BroadcastHashJoin") >= 1
        assert "SortMergeJoin" not in plans[0]._jdf.queryExecution().executedPlan().toString()
        assert {r.feature: r.psi for r in plans[2].collect()} == {"0": 0.0, "1": 0.0, "2": 0.0}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_rows_of_a_unit_share_its_draws(spark, monkeypatch):
    draws = [hashlib.sha256(f"42|{k}".encode()).hexdigest() for k in range(500)] + ["0" * 64, "f" * 64]
    for step in metrics.POISSON_STEPS[:10]:
        at = math.ceil(Fraction(step) * (1 << 52))
        draws += [f"{n:013x}" + end * 51 for n in (at - 1, at) for end in "0f"]
    got = spark.createDataFrame([(d,) for d in draws], "d string").select("d", metrics.poisson_of_digest(F.col("d")).alias("n")).collect()
    assert all(r.n == sum(int(r.d[:13], 16) / 2**52 >= p for p in metrics.POISSON_STEPS) for r in got)
    units = spark.range(300).select((F.col("id") % 50).alias("u"), (F.col("id") % 3).alias("k"), (F.col("id") * 7 % 11).cast("double").alias("x"))
    want = metrics.bootstrap(units, ["k"], "u", ["x"], 60, 0.9, 42).orderBy("k").collect()
    monkeypatch.setattr(metrics, "UNIT_ROWS", 2)
    split = metrics.bootstrap(units, ["k"], "u", ["x"], 60, 0.9, 42).orderBy("k").collect()
    for a, b in zip(want, split):
        one = metrics.bootstrap(units.filter(F.col("k") == a.k), [], "u", ["x"], 60, 0.9, 42).first()
        for c in ("x_point", "x_lo", "x_hi"):
            assert a[c] == pytest.approx(b[c]) and a[c] == pytest.approx(one[c])
