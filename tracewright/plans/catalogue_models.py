"""Queries of scorers, models and end-to-end jobs. Fitted models have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import consequence, hash_fold
from ..operators import isotonic, learn, metrics
from ..operators.islands import cluster_indications
from ..operators.ordered import indexed
from ..session import cut
from . import evaluation as ev
from . import views as v
from .catalogue import query
from .jobs import forecast, match_surveys
from .jobs import predict as run_predict
from .sql_views import DOC, IND, R, REV, q, r6
from .views import r6 as rnd

TEXT_FEATURES = ["n_chars", "n_words", "digit_share", "upper_share", "line_count"]


def document_features(spark, sf):
    """Shape of every labelled document, read from its whole text."""
    t = F.col("text")
    n = F.greatest(F.lit(1), F.length(t))
    docs = v.table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split(t, r"\s+")).cast("double").alias("n_words"),
        (F.length(F.regexp_replace(t, "[^0-9]", "")) / n).alias("digit_share"), (F.length(F.regexp_replace(t, "[^A-Z]", "")) / n).alias("upper_share"),
        F.size(F.split(t, "\n")).cast("double").alias("line_count"),
    )
    return v.table(spark, sf, "labels").join(docs, "doc_id").withColumn("fold", hash_fold(F.col("doc_id").cast("string"), 3))


@query(q(R, f"""
, x AS (SELECT *, run_id AS fold FROM r),
s AS (SELECT k.fold, median(x.value) AS med, mad(x.value) AS mad FROM (VALUES (0), (1), (2)) AS k(fold) JOIN x ON x.fold <> k.fold GROUP BY 1)
SELECT survey_id, sample_idx, {r6('(value - med) / greatest(1e-9, 1.4826 * mad)')} AS score_mad FROM x JOIN s USING (fold)"""))
def oof_mad_scores(spark, sf):
    got = learn.out_of_fold_mad(v.readings(spark, sf).df, "run_id", 3, "value")
    return got.select("survey_id", "sample_idx", rnd("score_mad").alias("score_mad"))


@query()
def isolation_scores(spark, sf):
    e = v.table(spark, sf, "embeddings")
    forest = learn.IsolationForest(tuple(f"e{i}" for i in range(64)), trees=100, emphasised=("e0",), array="embedding")
    return forest.fit(e, "vec_id").score(e).select("vec_id", "label", "score_if")


@query()
def oof_forest_scores(spark, sf):
    rows = v.heads(v.readings(spark, sf).df).withColumn("fold", F.col("run_id"))
    forest = learn.IsolationForest(("b_lo", "b_mid", "b_hi"), trees=50)
    return learn.out_of_fold_forest(cut(rows), "fold", 3, "event_id", forest).select("event_id", "fold", "score_if")


@query(q(DOC, f"""
, t AS (SELECT score AS x, count(*) AS w, sum(quality) AS s, row_number() OVER (ORDER BY score) AS i FROM d GROUP BY score),
c AS (SELECT *, sum(w) OVER (ORDER BY i) AS cw, sum(s) OVER (ORDER BY i) AS cs FROM t),
a AS (SELECT j.i AS j, k.i AS k, CAST(k.cs - j.cs + j.s AS DOUBLE) / CAST(k.cw - j.cw + j.w AS DOUBLE) AS m FROM c AS j JOIN c AS k ON j.i <= k.i),
l AS (SELECT j, k, min(m) OVER (PARTITION BY j ORDER BY k DESC) AS m FROM a),
f AS (SELECT k AS i, max(m) AS p FROM l GROUP BY k)
SELECT d.doc_id, d.score, {r6('f.p')} AS p FROM d JOIN t ON t.x = d.score JOIN f USING (i)"""))
def isotonic_calibration(spark, sf):
    d = cut(v.scored_documents(spark, sf))
    got = isotonic.fit(d, "score", "quality").apply(d, "score", "p")
    return got.select("doc_id", "score", rnd("p").alias("p"))


@query()
def severity_intervals(spark, sf):
    d = cut(document_features(spark, sf).withColumn("y", F.col("n_words") / F.greatest(F.lit(1.0), F.col("line_count"))))
    model = learn.SeverityModel(["n_chars", "digit_share", "upper_share", "line_count"], trees=20)
    got = learn.cross_validated_severity(d, "fold", 3, "source", "y", "doc_id", model)
    return got.select("doc_id", "y", "sev_lo", "sev_pred", "sev_hi")


@query()
def class_probabilities(spark, sf):
    d = cut(document_features(spark, sf).withColumn("klass", F.when(F.col("quality") == 1, "good").otherwise("poor")).withColumn("unit", F.col("doc_id")))
    got = learn.cross_validated_classes(d, "fold", 3, "unit", "klass", learn.ClassModel(TEXT_FEATURES, ["good", "poor", "unseen"], trees=20))
    return got.select("doc_id", "klass", "pred_type", "pred_type_conf", "probabilities")


@query()
def feature_importance(spark, sf):
    d = cut(document_features(spark, sf).withColumn("klass", F.when(F.col("quality") == 1, "good").otherwise("poor")))
    model = learn.ClassModel(TEXT_FEATURES, ["good", "poor"], trees=20).fit(d.filter("fold > 0"), d.filter("fold = 0"), "klass")
    importance = model.importance(spark)
    gate = metrics.top_features_allowed(importance, "feature", "importance", ["chainage_m"]).select(F.col("passed").alias("gate_passed"))
    return importance.crossJoin(F.broadcast(gate))


@query("""
WITH m AS (SELECT avg(o_totalprice) AS prediction FROM orders WHERE o_orderstatus <> 'O'), c AS (SELECT abs(o_totalprice - prediction) AS e FROM orders, m WHERE o_orderstatus = 'O'),
n AS (SELECT count(*) AS n FROM c), s AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS i, (n - 1) * least(1.0, ceil((n + 1) * 0.9) / n) AS h FROM c, n)
SELECT round(max(prediction), 3) + 0.0 AS prediction, round(max(CASE WHEN i = floor(h) THEN e END) + (max(CASE WHEN i = ceil(h) THEN e END) - max(CASE WHEN i = floor(h) THEN e END)) * (max(h) - floor(max(h))), 3) + 0.0 AS margin FROM s, m""")
def mean_baseline(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderstatus", "o_totalprice")
    got = learn.mean_baseline(o.filter("o_orderstatus <> 'O'"), o.filter("o_orderstatus = 'O'"), "o_totalprice", 0.1)
    return got.select(rnd("prediction", 3).alias("prediction"), rnd("margin", 3).alias("margin"))


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT max_by(event_type, {'n': n, 'e': event_type}) AS major, max(n) / sum(n) AS p FROM c)
SELECT major, round(p, 6) + 0.0 AS p_major, round((1 - p) / 4, 6) + 0.0 AS p_other FROM t""")
def majority_baseline(spark, sf):
    classes = ["view", "click", "purchase", "error", "signup"]
    got = learn.majority_baseline(v.table(spark, sf, "events"), "event_type", classes)
    return got.select("major", rnd(F.array_max("probabilities")).alias("p_major"), rnd(F.array_min("probabilities")).alias("p_other"))


@query(q(R, f"""
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE {r6("value / 500.0 * chainage_m * CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.8 WHEN 'purchase' THEN 0.0 END")} END AS risk_score FROM r"""))
def risk_scores(spark, sf):
    weights = {"view": 1.0, "click": 0.8, "purchase": 0.0}
    r = v.reading_rows(spark, sf).withColumn("p_defect_cal", F.col("value") / 500.0).withColumn("sev_pred", F.when(F.col("event_type") != "error", F.col("chainage_m")))
    return learn.risk(r, consequence(F.col("event_type"), weights)).select("event_id", rnd("risk_score").alias("risk_score"))


@query("""
WITH g AS (SELECT DISTINCT quality, doc_id FROM documents JOIN labels USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256(concat('42|', doc_id)), doc_id) - 1 AS i, count(*) OVER (PARTITION BY quality) AS n FROM g)
SELECT quality, doc_id, i < CASE WHEN n > 1 THEN greatest(1, CAST(round_even(n * 0.3, 0) AS BIGINT)) ELSE 0 END AS calibration FROM o""")
def calibration_groups(spark, sf):
    d = v.scored_documents(spark, sf)
    return metrics.calibration_split(d, "doc_id", 0.3, 42, by=["quality"])


@query("""
WITH l AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))
SELECT l.user_id, CASE WHEN l.i < floor(l.n / 2) THEN 'train' ELSE 'test' END AS half, count(*) AS n_rows FROM l JOIN events USING (user_id) GROUP BY 1, 2""")
def line_halves(spark, sf):
    got = metrics.line_halves(v.table(spark, sf, "events").select("user_id"), "user_id")
    return got.groupBy("user_id", "half").agg(F.count(F.lit(1)).alias("n_rows"))


@query(q(REV, """SELECT CASE WHEN run_id < 5 THEN 'train' ELSE 'test' END AS side, count(*) AS n, round(sum(y_true), 1) + 0.0 AS total FROM g GROUP BY 1"""))
def temporal_holdout(spark, sf):
    train, test = metrics.temporal_holdout(v.yearly_revenue(spark, sf), "run_id", [0, 1, 2, 3, 4], [5, 6])
    both = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return both.groupBy("side").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("y_true"), 1).alias("total"))


_RELEASED = IND.replace(R, R + """,
md AS (SELECT median(value) AS med, mad(value) AS mad FROM r WHERE run_id = 0),
rs AS (SELECT r.*, (value - med) / greatest(1e-9, 1.4826 * mad) AS score FROM r, md),
th AS (SELECT quantile_cont(score, 0.9) AS thr FROM rs WHERE run_id = 0),
rt AS (SELECT * FROM rs, th WHERE run_id > 0)""").replace("value > 60", "score > thr").replace("max(value) AS score", "max(score) AS score").replace(
    "isl.value = pk.score", "isl.score = pk.score").replace("AS grp FROM r)", "AS grp FROM rt)")


@query(q(_RELEASED, f"""
, sh AS (SELECT survey_id, score, cume_dist() OVER (PARTITION BY survey_id ORDER BY score) AS share FROM rt)
SELECT i.survey_id, i.indication_id, {r6('i.anomaly_score')} AS anomaly_score, {r6('max(share)')} AS p_defect_cal, {r6('max(r.value)')} AS value, {r6('chainage_end_m - chainage_start_m')} AS extent_m, dq_flag
FROM ind i JOIN r ON r.survey_id = i.survey_id AND r.sample_idx = i.peak_sample_idx JOIN sh ON sh.survey_id = i.survey_id AND sh.score = i.anomaly_score GROUP BY ALL"""))
def predict_surveys(spark, sf):
    """Every later survey by a scorer released on the first ones."""
    rows = cut(v.readings(spark, sf).df)
    model = learn.MadModel("value", 0.1).fit(rows.filter("run_id = 0"))
    later = rows.filter("run_id > 0").withColumn("dq_flag", F.when(F.col("event_type") == "error", "edge").otherwise("clean"))
    places = later.select("survey_id", "sample_idx", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"))
    got = run_predict(later, places, model, v.VERSION, ["value"], threshold=model.threshold)
    return got.select("survey_id", "indication_id", "dq_flag", *[rnd(c).alias(c) for c in ("anomaly_score", "p_defect_cal", "value", "extent_m")])


@query()
def survey_predictions(spark, sf):
    """Readings scored by a forest, clustered, matched to the sources and ranked by risk."""
    series = v.readings(spark, sf)
    rows = cut(v.heads(series.df))
    forest = learn.IsolationForest(("b_lo", "b_mid", "b_hi"), trees=50, contamination=0.05)
    scored = cut(forest.fit(rows, "event_id").score(rows, "score"))
    found = cluster_indications(indexed(scored, ["survey_id"], "sample_idx", series.longest), "score", 0.0, v.VERSION, carry=("line_id", "run_id"))
    got = match_surveys(cut(found), cut(v.sources(spark, sf)), rows.select("line_id", "survey_id").distinct())
    return got.select("indication_id", "survey_id", "anomaly_score", "p_defect_cal", "matched_source_id", "distance_m")


@query()
def growth_forecast(spark, sf):
    series = v.readings(spark, sf)
    rows = cut(series.df.withColumn("severity_smys", F.col("value")))
    found = cut(v.found(spark, sf))
    matched = match_surveys(found, cut(v.sources(spark, sf)), rows.select("line_id", "survey_id").distinct())
    shown = matched.filter("matched_kind = 'defect'").withColumn("sev_pred", F.col("anomaly_score")).withColumn("sev_lo", F.col("anomaly_score") * 0.9).withColumn("sev_hi", F.col("anomaly_score") * 1.1)
    got = forecast(cut(matched.drop("run_id")), rows, rows.select("survey_id", "run_id"), shown, 500.0)
    return got.select("matched_source_id", "n_obs", "shrunk_rate", "life_lo", "life_med", "life_hi")


def _evaluated(spark, sf):
    series = v.readings(spark, sf)
    rows = cut(v.heads(series.df).withColumn("score_value", F.col("value") - v.THRESHOLD).withColumn("score_spread", F.abs(F.col("b_hi") - F.col("b_lo")) - 40.0))
    return rows, cut(v.sources(spark, sf))


VALUE, SPREAD = ev.Scoring("value", "score_value", 0.0), ev.Scoring("spread", "score_spread", 0.0)


@query()
def detection_report(spark, sf):
    rows, registry = _evaluated(spark, sf)
    return ev.detection_report(rows, [VALUE, SPREAD], registry, 20.0, v.TOLERANCE)


@query()
def recall_gap(spark, sf):
    rows, registry = _evaluated(spark, sf)
    return ev.recall_gap(rows, VALUE, SPREAD, registry, 20.0, v.TOLERANCE)


@query()
def whole_line_cv(spark, sf):
    rows, registry = _evaluated(spark, sf)
    forest = learn.IsolationForest(("b_lo", "b_mid", "b_hi"), trees=40, contamination=0.1)
    scored = cut(ev.held_out_scores(ev.line_folds(rows, 3), 3, "event_id", forest))
    return ev.detection_report(scored, [ev.Scoring("forest", "score", 0.0)], registry, 20.0, v.TOLERANCE)


@query()
def ablation_recall(spark, sf):
    rows, registry = _evaluated(spark, sf)
    arms = {"one": ["b_lo"], "three": ["b_lo", "b_mid", "b_hi"]}
    make = lambda columns: learn.IsolationForest(tuple(columns), trees=30, contamination=0.1)
    return ev.ablation(ev.block_folds(rows, 24.0, 3), arms, 3, "event_id", make, registry, 20.0, v.TOLERANCE)


@query()
def transfer_matrix(spark, sf):
    d = document_features(spark, sf).withColumn("y", F.col("n_words") / F.greatest(F.lit(1.0), F.col("line_count")))
    d = cut(d.withColumn("half", F.when(F.col("fold") < 2, "train").otherwise("test")))
    model = learn.SeverityModel(["n_chars", "digit_share", "upper_share", "line_count"], trees=20)
    languages = sorted(r["lang"] for r in d.select("lang").distinct().collect())
    return ev.transfer(d, "lang", "half", "source", "y", "doc_id", model, languages)


def _evaluation_plan(spark, sf):
    rows, registry = _evaluated(spark, sf)
    rows = rows.withColumn("severity_smys", F.col("value"))
    return rows, ev.EvaluationPlan(
        registry, ("b_lo", "b_mid", "b_hi"), "value", ("error", "signup", "none"), "error", 20.0, v.TOLERANCE, row_id="event_id", trees=20, min_classes=2
    )


@query()
def evaluation_gates(spark, sf):
    """Detectors, severities and classes from block folds, with the gates a release depends on."""
    rows, plan = _evaluation_plan(spark, sf)
    return ev.evaluate(cut(ev.block_folds(rows, 24.0, 3)), 3, F.col("event_type") == "error", plan).report


@query()
def holdout_report(spark, sf):
    """The same for the last third of each month, learnt from the first two."""
    rows, plan = _evaluation_plan(spark, sf)
    return ev.holdout(rows, "run_id", [0, 1], [2], F.col("event_type") == "error", plan).report
