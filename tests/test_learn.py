import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewright.functions.scalars import hash_fold
from tracewright.operators import learn
from tracewright.operators.guards import GuardError
from tracewright.plans import jobs


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.normal(size=(n, 3))
    x[:12] += 9
    y = 10 + 3 * x[:, 0] + rng.normal(0, 1, n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "unit": np.arange(n) // 3, "fold": (np.arange(n) // 3) % 3})
    pdf["klass"] = np.where(pdf["a"] + rng.normal(0, 0.3, n) > 0, "hi", "lo")
    return spark.createDataFrame(pdf).persist()


def test_forest_ranks_outliers_first_and_flags_the_share(blobs):
    forest = learn.IsolationForest(("a", "b", "c"), trees=60, sample=128, contamination=0.02, seed=3)
    got = forest.fit(blobs, "id").score(blobs).select("id", "score_if").toPandas().sort_values("score_if", ascending=False)
    assert set(got["id"].head(12)) == set(range(12))
    assert (got["score_if"] > 0).mean() == pytest.approx(0.02, abs=0.005)
    again = forest.fit(blobs.repartition(5), "id").score(blobs).select("id", "score_if").toPandas().set_index("id")
    np.testing.assert_allclose(again.loc[got["id"], "score_if"], got["score_if"])


def test_each_row_is_scored_once_out_of_fold(blobs):
    got = learn.out_of_fold_forest(blobs, "fold", 3, "id", learn.IsolationForest(("a", "b"), trees=10, sample=64))
    assert got.count() == 600 and got.select("id").distinct().count() == 600
    mad = learn.out_of_fold_mad(blobs, "fold", 3, "a").toPandas()
    for k, g in mad.groupby("fold"):
        rest = mad[mad["fold"] != k]["a"]
        m = np.median(rest)
        np.testing.assert_allclose(g["score_mad"], (g["a"] - m) / (1.4826 * np.median(np.abs(rest - m))))


def test_a_fold_beyond_the_number_is_scored_too(blobs):
    late = blobs.withColumn("fold", F.when(F.col("id") >= 570, 3).otherwise(F.col("fold")))
    got = learn.out_of_fold_forest(late, "fold", 3, "id", learn.IsolationForest(("a", "b"), trees=10, sample=64))
    assert got.filter("score_if is not null").select("id").distinct().count() == got.count() == 600
    mad = learn.out_of_fold_mad(late, "fold", 3, "a").toPandas()
    rest = mad[mad["fold"] != 3]["a"]
    m = np.median(rest)
    assert len(mad) == 600
    np.testing.assert_allclose(mad[mad["fold"] == 3]["score_mad"], (mad[mad["fold"] == 3]["a"] - m) / (1.4826 * np.median(np.abs(rest - m))))
    alone = learn.out_of_fold_mad(late.filter("fold = 3"), "fold", 3, "a")
    assert alone.count() == alone.filter("score_mad is null").count() == 30
    none = late.withColumn("fold", F.when(F.col("id") > 0, F.col("fold")))
    for run in (lambda: learn.out_of_fold_mad(none, "fold", 3, "a"), lambda: learn.out_of_fold_forest(none, "fold", 3, "id", learn.IsolationForest(("a",)))):
        with pytest.raises(GuardError):
            run()


def test_all_folds_share_their_passes(spark, blobs):
    forest = learn.IsolationForest(("a", "b"), trees=10, sample=64)

    def jobs_of(folds):
        rows, group = blobs.withColumn("fold", F.col("id") % folds), f"folds-{folds}"
        spark.sparkContext.setJobGroup(group, group)
        got = learn.out_of_fold_forest(rows, "fold", folds, "id", forest)
        spark.sparkContext.setJobGroup("", "")
        return rows, got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    rows, got, few = jobs_of(2)
    assert jobs_of(6)[2] <= few + 2
    by_id = got.toPandas().set_index("id")["score_if"]
    for k in range(2):
        one = forest.fit(rows.filter(F.col("fold") != k), "id").score(rows.filter(F.col("fold") == k)).toPandas().set_index("id")["score_if"]
        assert (by_id.loc[one.index] == one).all()


def test_fold_of_a_hash_is_compiled(spark):
    keys = spark.range(200).select(F.concat(F.lit("k::"), F.col("id").cast("string")).alias("k"))
    for folds in (1, 3, 7, 1_000_003):
        got = keys.select("k", hash_fold(F.col("k"), folds).alias("f"))
        assert all(r.f == int(hashlib.sha256(r.k.encode()).hexdigest(), 16) % folds for r in got.collect())
        assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [1, 5, 30])
def test_conformal_margin(spark, n):
    v = np.random.default_rng(n).normal(size=n)
    got = learn.conformal_margin(spark.createDataFrame([(float(x),) for x in v], "e double"), "e", 0.1).first()
    assert got.margin == pytest.approx(np.quantile(v, min(1.0, np.ceil((n + 1) * 0.9) / n)))


def test_severity_intervals_cover(blobs):
    got = learn.cross_validated_severity(blobs, "fold", 3, "unit", "y", "id", learn.SeverityModel(["a", "b", "c"], trees=20)).toPandas()
    assert len(got) == 600
    assert ((got["y"] >= got["sev_lo"]) & (got["y"] <= got["sev_hi"])).mean() > 0.85
    assert (got["sev_lo"] <= got["sev_pred"]).all() and (got["sev_pred"] <= got["sev_hi"]).all()
    assert np.corrcoef(got["y"], got["sev_pred"])[0, 1] > 0.8


def test_classes_and_fallbacks(blobs):
    model = learn.ClassModel(["a", "b", "c"], ["hi", "lo", "unseen"], trees=20)
    got = learn.cross_validated_classes(blobs, "fold", 3, "unit", "klass", model).toPandas()
    assert len(got) == 600 and (got["klass"] == got["pred_type"]).mean() > 0.8
    p = np.array(got["probabilities"].tolist())
    np.testing.assert_allclose(p.sum(axis=1), 1.0)
    assert (p[:, 2] == 0).all()
    one = learn.ClassModel(["a"], ["hi", "lo"]).fit(blobs.filter("klass = 'lo'"), blobs, "klass").predict(blobs)
    assert one.select("pred_type", "pred_type_conf").distinct().collect() == [("lo", 1.0)]
    raw = learn.ClassModel(["a"], ["hi", "lo"], trees=5).fit(blobs, blobs.filter("klass = 'lo'"), "klass")
    assert raw._isotonic == {}


def test_isotonic_is_monotone_and_flat_outside(blobs):
    hit = blobs.select("a", (F.col("klass") == "hi").cast("double").alias("h"))
    model = learn.fit_isotonic(hit, "a", "h")
    probe = blobs.sparkSession.createDataFrame([(float(x),) for x in np.linspace(-30, 30, 61)], "a double")
    p = [r.p for r in probe.select("a", learn.isotonic_value(model, F.col("a")).alias("p")).orderBy("a").collect()]
    assert (np.diff(p) >= -1e-12).all() and p[0] == p[5] and p[-1] == p[-5] and 0 <= min(p) and max(p) <= 1


def test_scaler_is_fitted_once(blobs):
    s = learn.RobustScaler(["a"])
    with pytest.raises(GuardError):
        s.transform(blobs)
    out = s.fit(blobs).transform(blobs).agg(F.percentile("a", F.lit(0.5)).alias("m")).first()
    assert out.m == pytest.approx(0.0)
    with pytest.raises(GuardError):
        s.fit(blobs)


def test_permutation_importance_finds_the_used_column(blobs):
    def loss(df):
        return df.agg(F.avg(F.abs(F.col("y") - 10 - 3 * F.col("a"))).alias("loss"))

    got = {r.feature: r.importance for r in learn.permutation_importance(blobs.select("id", "a", "b", "y"), "id", ["a", "b"], loss, 1).collect()}
    assert got["a"] > 1 and got["b"] == pytest.approx(0.0)


def test_predictions_carry_severity_class_and_risk(spark, blobs):
    rows = blobs.select(F.lit("S").alias("survey_id"), F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("chainage_m"), F.lit("clean").alias("dq_flag"), "a", "b", "c", "y", "klass")
    pos = rows.select("survey_id", "sample_idx", F.lit(46.0).alias("lat"), F.lit(8.0).alias("lon"))
    forest = learn.IsolationForest(("a", "b", "c"), trees=30, sample=128).fit(rows, "sample_idx")
    typed = rows.withColumn("kind", F.when(F.col("klass") == "hi", "scc").otherwise("weld"))
    sev = learn.SeverityModel(["a", "b"], trees=10).fit(typed.filter("sample_idx < 400"), typed.filter("sample_idx >= 400"), "y")
    cls = learn.ClassModel(["a", "b"], ["scc", "weld"], trees=10).fit(typed.filter("sample_idx < 400"), typed.filter("sample_idx >= 400"), "kind")
    feats = rows.drop("y", "klass")
    out = jobs.predict(feats, pos, forest, "v1", ["a", "b"], sev, cls).toPandas()
    assert len(out) > 0 and out["indication_id"].is_unique
    w = out["pred_type"].map(jobs.CONSEQUENCE)
    np.testing.assert_allclose(out["risk_score"], out["p_defect_cal"] * out["sev_pred"] * w)
    bare = jobs.predict(feats, pos, forest, "v1", ["a", "b"]).toPandas()
    assert bare["sev_pred"].isna().all() and len(bare) == len(out)
