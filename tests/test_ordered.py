import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.operators import ordered as o
from tracewright.operators.quantiles import median_mad, quantiles


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 900
    # one key holds two thirds of the rows
    key = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n))
    return pd.DataFrame({"k": key, "t": rng.permutation(n), "v": rng.normal(size=n).round(3), "gap": rng.random(n) < 0.6})


@pytest.mark.parametrize("limit", [10_000, 50])
def test_order_rows_numbers_every_key(spark, rows, limit):
    s = o.order_rows(spark.createDataFrame(rows), ["k"], ["t"], single_task_rows=limit)
    got = s.df.toPandas().sort_values(["k", "t"])
    want = rows.sort_values(["k", "t"]).groupby("k").cumcount()
    assert got["sample_idx"].tolist() == want.tolist()


@pytest.mark.parametrize("chunk", [1 << 16, 7, 1])
@pytest.mark.parametrize("known", [True, False])
def test_running_values_do_not_depend_on_the_chunk(spark, rows, chunk, known):
    base = rows.sort_values(["k", "t"]).copy()
    base["i"] = base.groupby("k").cumcount() * 3  # holes in the numbering
    base["w"] = base["v"].where(~base["gap"])
    sdf = spark.createDataFrame(base).withColumn("w", F.when(~F.isnan("w"), F.col("w")))
    s = o.indexed(sdf, ["k"], "i", longest=2000 if known else None, chunk_rows=chunk)
    got = s.running(
        pos=o.position(), tot=o.total(F.col("v")), top=o.highest(F.col("v")), last=o.latest(F.col("w")), prev=o.earlier(F.col("w")),
        nxt=o.following(F.col("w")), nxt2=o.later(F.col("w")), lag=o.before(F.col("w")), lead=o.after(F.col("w")),
    ).df.toPandas().sort_values(["k", "t"])
    g = base.groupby("k")
    assert got["pos"].tolist() == g.cumcount().tolist()
    np.testing.assert_allclose(got["tot"], g["v"].cumsum(), atol=1e-9)
    np.testing.assert_allclose(got["top"], g["v"].cummax())
    ff, bf = g["w"].ffill(), g["w"].bfill()
    for col, want in {
        "last": ff, "prev": ff.groupby(base["k"]).shift(1), "nxt": bf, "nxt2": bf.groupby(base["k"]).shift(-1),
        "lag": g["w"].shift(1), "lead": g["w"].shift(-1),
    }.items():
        np.testing.assert_array_equal(got[col].to_numpy(dtype=float), want.to_numpy(dtype=float), err_msg=col)


@pytest.mark.parametrize("chunk", [1 << 16, 9])
def test_centred_frames_cross_chunk_borders(spark, rows, chunk):
    base = rows.sort_values(["k", "t"]).copy()
    base["i"] = base.groupby("k").cumcount()
    s = o.indexed(spark.createDataFrame(base), ["k"], "i", chunk_rows=chunk)
    got = s.framed(4, m=lambda w: F.avg("v").over(w), c=lambda w: F.count("v").over(w)).df.toPandas().sort_values(["k", "t"])
    want = base.groupby("k")["v"].rolling(9, center=True, min_periods=1)
    np.testing.assert_allclose(got["m"], want.mean().to_numpy(), atol=1e-9)
    assert got["c"].tolist() == want.count().tolist()


def test_cumulate_adds_ties_up_first(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("b", 5.0)], "k string, x double")
    got = {(r.k, r.x): r.cum_n for r in o.cumulate(df, ["k"], "x", {"n": F.lit(1)}).df.collect()}
    assert got == {("a", 1.0): 2, ("a", 2.0): 3, ("b", 5.0): 1}


@pytest.mark.parametrize("longest", [None, 1000])
@pytest.mark.parametrize("accuracy", [100_000, 20])
def test_quantiles_are_exact(spark, rows, longest, accuracy):
    probs = {"lo": 0.0, "q1": 0.1, "med": 0.5, "q9": 0.9, "hi": 1.0}
    sdf = spark.createDataFrame(rows.assign(v=rows["v"].round(1)))
    got = quantiles(sdf, ["k"], "v", probs, longest, accuracy).toPandas().set_index("k")
    for k, g in rows.assign(v=rows["v"].round(1)).groupby("k"):
        want = np.quantile(g["v"], list(probs.values()))
        np.testing.assert_allclose(got.loc[k, list(probs)].to_numpy(dtype=float), want, atol=1e-12)
        assert got.loc[k, "n"] == len(g)


def test_quantiles_of_tiny_groups_and_whole_tables(spark):
    for n in range(1, 14):
        vals = [float(i * i) for i in range(n)]
        sdf = spark.createDataFrame([(v,) for v in vals] + [(float("nan"),)], "v double").repartition(2)
        got = quantiles(sdf, [], "v", {"a": 0.9, "b": 0.25}).first()
        np.testing.assert_allclose([got.a, got.b], np.quantile(vals, [0.9, 0.25]))


def test_median_mad(spark, rows):
    got = median_mad(spark.createDataFrame(rows), ["k"], "v").toPandas().set_index("k")
    for k, g in rows.groupby("k"):
        med = np.median(g["v"])
        assert got.loc[k, "med"] == pytest.approx(med)
        assert got.loc[k, "mad"] == pytest.approx(np.median(np.abs(g["v"] - med)))
