"""Queries over indications, sources, matching, identity and feedback."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import feedback, identity, islands, matching, metrics
from ..operators.guards import flag_edges, join_many_to_one, join_one_to_one
from ..operators.quantiles import quantiles
from ..session import cut
from ..sources import surveys as io
from . import views as v
from .catalogue import query
from .jobs import match_surveys
from .sql_views import FIX, GREEDY, HEADS, IND, IND_SRC, R, SRC, q, r6
from .views import r6 as rnd


@query(q(IND, f"""
SELECT indication_id, survey_id, peak_sample_idx, {r6('chainage_peak_m')} AS chainage_peak_m, {r6('chainage_start_m')} AS chainage_start_m,
       {r6('chainage_end_m')} AS chainage_end_m, n_rows, anomaly_score, dq_flag FROM ind"""))
def indication_clusters(spark, sf):
    return v.found(spark, sf).select(
        "indication_id", "survey_id", "peak_sample_idx", rnd("chainage_peak_m").alias("chainage_peak_m"),
        rnd("chainage_start_m").alias("chainage_start_m"), rnd("chainage_end_m").alias("chainage_end_m"), "n_rows", "anomaly_score", "dq_flag",
    )


@query(q(IND, f"""
SELECT i.survey_id, i.peak_sample_idx, {r6('avg(CASE WHEN r.value <= i.anomaly_score THEN 1.0 ELSE 0.0 END)')} AS p_defect_cal
FROM ind i JOIN r ON r.survey_id = i.survey_id GROUP BY 1, 2"""))
def peak_percentile_rank(spark, sf):
    return v.found(spark, sf, rank=True).select("survey_id", "peak_sample_idx", rnd("p_defect_cal").alias("p_defect_cal"))


@query(q(IND, """
, e AS (SELECT survey_id, max(chainage_m) - min(chainage_m) AS len FROM r GROUP BY 1),
b AS (SELECT survey_id, greatest(1, round_even(20.0 * len / 1000.0, 0)) AS budget FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY survey_id ORDER BY anomaly_score DESC, peak_sample_idx) AS rank FROM ind)
SELECT k.survey_id, k.rank, k.peak_sample_idx, k.anomaly_score FROM k JOIN b USING (survey_id) WHERE k.rank <= b.budget"""))
def indication_topk(spark, sf):
    best = islands.select_budget(v.found(spark, sf), v.survey_extents(spark, sf), 20.0)
    return best.select("survey_id", F.col("rank").cast("long").alias("rank"), "peak_sample_idx", "anomaly_score")


@query(q(IND, """
SELECT indication_id, anomaly_score FROM (
  SELECT indication_id, CASE WHEN dq_flag = 'clean' THEN anomaly_score END AS risk_score, anomaly_score FROM ind)
ORDER BY risk_score DESC NULLS LAST, indication_id LIMIT 50"""))
def ranked_list(spark, sf):
    rows = v.found(spark, sf).withColumn("risk_score", F.when(F.col("dq_flag") == "clean", F.col("anomaly_score")))
    return islands.ranked_list(rows, 50).select("indication_id", "anomaly_score")


@query(q(SRC, f"""
SELECT source_id, line_id, kind, defect_type, {r6('chainage_m')} AS chainage_m, {r6('chainage_start_m')} AS chainage_start_m,
       {r6('chainage_end_m')} AS chainage_end_m FROM src"""))
def truth_registry_runs(spark, sf):
    return v.sources(spark, sf).select(
        "source_id", "line_id", "kind", "defect_type", rnd("chainage_m").alias("chainage_m"),
        rnd("chainage_start_m").alias("chainage_start_m"), rnd("chainage_end_m").alias("chainage_end_m"),
    )


@query(q(R, f"""
, g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY survey_id ORDER BY sample_idx) AS grp FROM r)
SELECT survey_id, {r6('(min(chainage_m) + max(chainage_m)) / 2')} AS midpoint, min(sample_idx) AS start_idx, max(sample_idx) AS end_idx, count(*) AS n_rows
FROM g WHERE event_type = 'purchase' GROUP BY survey_id, grp"""))
def label_run_midpoints(spark, sf):
    runs = islands.run_bounds(v.readings(spark, sf), F.col("event_type") == "purchase", "chainage_m")
    return runs.select("survey_id", rnd("midpoint").alias("midpoint"), "start_idx", "end_idx", "n_rows")


@query(q(FIX, f"""
, g AS (SELECT *, sum(CASE WHEN lat IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY survey_id ORDER BY sample_idx) AS grp FROM f)
SELECT survey_id, min(sample_idx) AS start_idx, max(sample_idx) + 1 AS end_idx, {r6('max(chainage_m) - min(chainage_m)')} AS bridged
FROM g WHERE lat IS NULL GROUP BY survey_id, grp"""))
def dropout_runs(spark, sf):
    gaps = islands.bridged_gaps(v.fixes(v.readings(spark, sf)), F.col("lat").isNotNull(), "chainage_m")
    return gaps.select("survey_id", "start_idx", "end_idx", rnd("bridged").alias("bridged"))


@query(q(IND, """
SELECT line_id, floor(chainage_peak_m / 24.0) * 24.0 AS block_start_m, max(anomaly_score) AS max_metric, count(*) AS n FROM ind GROUP BY 1, 2"""))
def block_heatmap(spark, sf):
    return islands.block_heatmap(v.found(spark, sf), "line_id", "chainage_peak_m", 24.0, F.col("anomaly_score"))


@query(q(IND, """
, c AS (SELECT indication_id, CASE WHEN dq_flag = 'edge' THEN NULL ELSE anomaly_score / 2 END AS risk_score, anomaly_score FROM ind),
h AS (SELECT max(CASE WHEN risk_score IS NOT NULL THEN 1 ELSE 0 END) AS has FROM c)
SELECT indication_id, CASE WHEN has = 1 THEN 'risk_score' ELSE 'anomaly_score' END AS metric_name,
       CASE WHEN has = 1 THEN risk_score ELSE anomaly_score END AS metric FROM c, h"""))
def metric_fallback(spark, sf):
    rows = v.found(spark, sf).withColumn("risk_score", F.when(F.col("dq_flag") != "edge", F.col("anomaly_score") / 2))
    return islands.metric_or_fallback(rows, "risk_score", "anomaly_score").select("indication_id", "metric_name", "metric")


@query(q(R, """
, n AS (SELECT survey_id, greatest(1, count(*) // 8) AS stride FROM r GROUP BY 1)
SELECT r.survey_id, r.sample_idx, r.value FROM r JOIN n USING (survey_id) WHERE r.sample_idx % n.stride = 0"""))
def thinned_rows(spark, sf):
    return islands.thin(v.readings(spark, sf), 8).select("survey_id", "sample_idx", "value")


@query(q(FIX, f"""
SELECT survey_id, sample_idx, {r6('lat', 9)} AS lat, greatest(value - 20, 0.0) AS weight FROM f WHERE lat IS NOT NULL AND lon IS NOT NULL"""))
def heat_points(spark, sf):
    rows = v.fixes(v.readings(spark, sf)).df.withColumn("weight", F.col("value") - 20)
    return islands.heat_points(rows, "lat", "lon", "weight").select("survey_id", "sample_idx", rnd("lat", 9).alias("lat"), "weight")


@query(q(HEADS, f"""
SELECT survey_id, sample_idx, 'b_lo' AS head, {r6('b_lo')} AS nt FROM h UNION ALL
SELECT survey_id, sample_idx, 'b_mid', {r6('b_mid')} FROM h UNION ALL SELECT survey_id, sample_idx, 'b_hi', {r6('b_hi')} FROM h"""))
def heads_long(spark, sf):
    rows = v.heads(v.readings(spark, sf).df)
    return rows.unpivot(["survey_id", "sample_idx"], ["b_lo", "b_mid", "b_hi"], "head", "nt").withColumn("nt", rnd("nt"))


@query(q(R, f"""
, m AS (SELECT survey_id, median(value) AS med FROM r GROUP BY 1)
SELECT r.survey_id, r.sample_idx, {r6('greatest(abs(r.value - m.med), 1e-3)')} AS deviation FROM r JOIN m USING (survey_id)"""))
def deviation_view(spark, sf):
    series = v.readings(spark, sf)
    med = quantiles(series.df, ["survey_id"], "value", {"med": 0.5}, series.longest).drop("n")
    dev = F.greatest(F.abs(F.col("value") - F.col("med")), F.lit(1e-3))
    return series.df.join(med, "survey_id").select("survey_id", "sample_idx", rnd(dev).alias("deviation"))


@query(q(R, """
, n AS (SELECT survey_id, count(*) AS n FROM r GROUP BY 1)
SELECT r.survey_id, r.sample_idx, CASE WHEN r.sample_idx < 5 OR r.sample_idx >= n.n - 5 THEN 'edge' ELSE 'clean' END AS dq_flag FROM r JOIN n USING (survey_id)"""))
def edge_flags(spark, sf):
    return flag_edges(v.readings(spark, sf), 5).select("survey_id", "sample_idx", "dq_flag")


@query(q(HEADS, f"""
SELECT survey_id, sample_idx, {r6('(b_hi - b_lo) / (2.0 * 0.5)')} AS g1, {r6('(b_hi + b_lo - 2.0 * b_mid) / (0.5 * 0.5)')} AS g2,
  {r6('''greatest(0.2, least(20.0, CASE WHEN abs((b_hi + b_lo - 2.0 * b_mid) / (0.5 * 0.5)) > 0 AND sqrt(12.0 * abs(b_mid) / abs((b_hi + b_lo - 2.0 * b_mid) / (0.5 * 0.5))) > 0
  THEN sqrt(12.0 * abs(b_mid) / abs((b_hi + b_lo - 2.0 * b_mid) / (0.5 * 0.5))) ELSE 2.0 END))''')} AS standoff,
  {r6('sqrt(b_lo * b_lo + b_mid * b_mid + b_hi * b_hi)')} AS magnitude,
  {r6('degrees(asin(least(1.0, greatest(-1.0, b_hi / sqrt(b_lo * b_lo + b_mid * b_mid + b_hi * b_hi)))))')} AS inclination,
  {r6('degrees(atan2(b_mid, b_lo))')} AS declination FROM h"""))
def head_differences(spark, sf):
    lo, mid, hi = F.col("b_lo"), F.col("b_mid"), F.col("b_hi")
    g2 = s.second_difference(lo, mid, hi, 0.5)
    return v.heads(v.readings(spark, sf).df).select(
        "survey_id", "sample_idx", rnd(s.first_difference(lo, hi, 0.5)).alias("g1"), rnd(g2).alias("g2"),
        rnd(s.standoff_m(mid, g2, 2.0)).alias("standoff"), rnd(s.vector_magnitude(lo, mid, hi)).alias("magnitude"),
        rnd(s.vector_inclination_deg(lo, mid, hi)).alias("inclination"), rnd(s.vector_declination_deg(lo, mid)).alias("declination"),
    )


@query(q(IND_SRC, f"""
, c AS (SELECT i.indication_id, i.chainage_peak_m, s.source_id, s.kind, abs(i.chainage_peak_m - s.chainage_m) AS d,
       row_number() OVER (PARTITION BY i.indication_id ORDER BY abs(i.chainage_peak_m - s.chainage_m), s.chainage_m, s.source_id) AS k
       FROM ind i JOIN src s ON s.line_id = i.line_id)
SELECT i.indication_id, c.source_id, c.kind, CASE WHEN c.d IS NULL THEN -1.0 ELSE {r6('c.d')} END AS distance_m
FROM ind i LEFT JOIN c ON c.indication_id = i.indication_id AND c.k = 1"""))
def nearest_source(spark, sf):
    got = matching.nearest(
        v.found(spark, sf).select("indication_id", "line_id", "chainage_peak_m"), v.sources(spark, sf), ["line_id"], "chainage_peak_m", "chainage_m", "source_id", ["kind"]
    )
    return got.select("indication_id", "source_id", "kind", F.when(F.col("source_id").isNull(), -1.0).otherwise(rnd("distance_m")).alias("distance_m"))


@query(q(IND_SRC, f"""
SELECT i.indication_id, s.source_id, {r6('abs(i.chainage_peak_m - s.chainage_m)')} AS distance_m
FROM ind i JOIN src s ON s.line_id = i.line_id WHERE abs(i.chainage_peak_m - s.chainage_m) <= 15"""))
def band_match(spark, sf):
    src = v.sources(spark, sf).select("line_id", "source_id", F.col("chainage_m").alias("source_m"))
    got = matching.band_pairs(v.found(spark, sf), src, ["line_id"], "chainage_peak_m", "source_m", v.TOLERANCE, crowded_rows=20)
    return got.select("indication_id", "source_id", rnd(F.abs(F.col("chainage_peak_m") - F.col("source_m"))).alias("distance_m"))


@query(q(SRC, """
SELECT s.source_id, r.survey_id, r.sample_idx FROM src s JOIN r ON r.line_id = s.line_id
WHERE r.chainage_m BETWEEN s.chainage_start_m - 2 AND s.chainage_end_m + 2"""))
def interval_rows(spark, sf):
    src = v.sources(spark, sf).select("line_id", "source_id", (F.col("chainage_start_m") - 2).alias("lo"), (F.col("chainage_end_m") + 2).alias("hi"))
    rows = v.readings(spark, sf).df.select("line_id", "survey_id", "sample_idx", F.col("chainage_m").alias("at_m"))
    return matching.interval_rows(rows, src, ["line_id"], "at_m", "lo", "hi", 24.0).select("source_id", "survey_id", "sample_idx")


def matched(spark, sf):
    ind = cut(v.found(spark, sf))
    return cut(match_surveys(ind, cut(v.sources(spark, sf)), ind.select("line_id", "survey_id").distinct(), v.TOLERANCE))


@query(q(GREEDY, f"""
SELECT indication_id, matched_source_id, matched_kind, CASE WHEN distance_m IS NULL THEN -1.0 ELSE {r6('distance_m')} END AS distance_m FROM m"""))
def greedy_match(spark, sf):
    return matched(spark, sf).select(
        "indication_id", "matched_source_id", "matched_kind", F.when(F.col("matched_source_id").isNull(), -1.0).otherwise(rnd("distance_m")).alias("distance_m")
    )


@query(q(GREEDY, f"""
, nr AS (SELECT line_id, count(DISTINCT survey_id) AS n_runs FROM r GROUP BY 1),
hit AS (SELECT matched_source_id AS source_id, count(DISTINCT survey_id) AS n_hit FROM m WHERE matched_source_id IS NOT NULL GROUP BY 1)
SELECT s.source_id, nr.n_runs, coalesce(hit.n_hit, 0) AS n_hit, {r6('coalesce(hit.n_hit, 0) / nr.n_runs')} AS hit_rate
FROM src s JOIN nr USING (line_id) LEFT JOIN hit USING (source_id) WHERE s.kind = 'defect'"""))
def hit_rates(spark, sf):
    m = matched(spark, sf).select("survey_id", F.col("matched_source_id").alias("source_id"))
    runs = v.reading_rows(spark, sf).select("line_id", "survey_id").distinct()
    got = metrics.hit_rates(m, v.sources(spark, sf), runs, "line_id", "survey_id", "source_id")
    return got.select("source_id", "n_runs", "n_hit", rnd("hit_rate").alias("hit_rate"))


@query(q(GREEDY, f"""
, s AS (SELECT DISTINCT survey_id FROM r),
a AS (SELECT survey_id, avg(CASE WHEN matched_kind = 'defect' THEN 0.0 ELSE 1.0 END) AS f, avg(CASE WHEN matched_kind = 'interference' THEN 1.0 ELSE 0.0 END) AS i FROM m GROUP BY 1)
SELECT s.survey_id, {r6('coalesce(a.f, 0)')} AS false_dig_rate, {r6('coalesce(a.i, 0)')} AS interference_fraction FROM s LEFT JOIN a USING (survey_id)"""))
def dig_rates(spark, sf):
    got = metrics.dig_rates(matched(spark, sf), v.reading_rows(spark, sf), "survey_id", "matched_kind")
    return got.select("survey_id", rnd("false_dig_rate").alias("false_dig_rate"), rnd("interference_fraction").alias("interference_fraction"))


@query(q(GREEDY, f"""SELECT indication_id, {r6('distance_m * 100.0', 4)} AS error_cm FROM m WHERE matched_kind = 'defect'"""))
def localisation_error(spark, sf):
    return metrics.localisation_errors(matched(spark, sf)).select("indication_id", rnd("error_cm", 4).alias("error_cm"))


@query(q(IND, """
SELECT i.indication_id, r.value AS peak_value, r.event_type AS peak_type, round(i.chainage_end_m - i.chainage_start_m, 6) + 0.0 AS extent_m
FROM ind i LEFT JOIN r ON r.survey_id = i.survey_id AND r.sample_idx = i.peak_sample_idx"""))
def peak_row_features(spark, sf):
    rows = v.readings(spark, sf).df.select("survey_id", "sample_idx", F.col("value").alias("peak_value"), F.col("event_type").alias("peak_type"))
    got = matching.attach_peak_rows(v.found(spark, sf), rows, ["peak_value", "peak_type"])
    return got.select("indication_id", "peak_value", "peak_type", rnd("extent_m").alias("extent_m"))


@query(q(IND, """
, j AS (SELECT i.indication_id, CASE WHEN r.event_type <> 'view' THEN r.event_type END AS truth FROM ind i LEFT JOIN r ON r.survey_id = i.survey_id AND r.sample_idx = i.peak_sample_idx)
SELECT truth, count(indication_id) AS n, (SELECT count(*) FROM j WHERE truth IS NULL) AS n_dropped FROM j WHERE truth IS NOT NULL GROUP BY 1"""))
def truth_at_peaks(spark, sf):
    rows = v.readings(spark, sf).df.select("survey_id", "sample_idx", F.when(F.col("event_type") != "view", F.col("event_type")).alias("truth"))
    known, dropped = matching.attach_truth(v.found(spark, sf), rows, "truth")
    return known.groupBy("truth").agg(F.count("indication_id").alias("n")).crossJoin(F.broadcast(dropped))


@query(q(HEADS, f"""SELECT survey_id, sample_idx, value, {r6('b_mid')} AS b_mid FROM h"""))
def one_to_one_join(spark, sf):
    series = v.readings(spark, sf)
    right = v.heads(series.df).select("survey_id", "sample_idx", rnd("b_mid").alias("b_mid"))
    return join_one_to_one(series.df.select("survey_id", "sample_idx", "value"), right, ["survey_id", "sample_idx"])


@query("SELECT event_id, c_custkey IS NOT NULL AS known, c_mktsegment FROM events LEFT JOIN customer ON c_custkey = user_id")
def many_to_one_join(spark, sf):
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment", F.lit(True).alias("known"))
    got = join_many_to_one(v.table(spark, sf, "events").select("event_id", "user_id"), c, ["user_id"])
    return got.select("event_id", F.coalesce("known", F.lit(False)).alias("known"), "c_mktsegment")


@query(q(IND, """
, dig AS (SELECT line_id, arg_max(chainage_peak_m, anomaly_score) AS at_m, arg_max(ts, anomaly_score) + INTERVAL 1 DAY AS verified_at FROM ind WHERE run_id = 2 GROUP BY 1)
SELECT d.line_id, round((epoch_us(d.verified_at) - min(epoch_us(i.ts))) / 86400e6, 6) + 0.0 AS days
FROM dig d JOIN ind i ON i.line_id = d.line_id AND i.ts <= d.verified_at AND abs(i.chainage_peak_m - d.at_m) <= 15 GROUP BY d.line_id, d.verified_at"""))
def days_to_verification(spark, sf):
    ind, truth = _digs(spark, sf)
    got = feedback.days_to_verification(truth, ind.withColumnRenamed("ts", "created_at"))
    return got.select("line_id", rnd("days").alias("days"))


def _digs(spark, sf):
    ind = cut(v.found(spark, sf))
    # of equal scores the earliest peak, whatever order the rows come in
    rank = F.struct(F.col("anomaly_score"), -F.col("peak_sample_idx"))
    best = ind.filter("run_id = 2").groupBy("line_id").agg(F.max_by(F.struct("indication_id", "chainage_peak_m", "ts"), rank).alias("b"))
    truth = best.select(
        F.col("b.indication_id").alias("defect_id"), "line_id", F.lit(0).alias("revision"), F.col("b.chainage_peak_m").alias("chainage_m"),
        F.lit("excavation").alias("source"), (F.col("b.ts") + F.expr("interval 1 day")).alias("verified_at"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    return ind, truth


@query(q(IND, """
, dig AS (SELECT line_id, arg_max(chainage_peak_m, anomaly_score) AS at_m, arg_max(ts, anomaly_score) + INTERVAL 1 DAY AS verified_at FROM ind WHERE run_id = 2 GROUP BY 1),
days AS (SELECT d.line_id, (epoch_us(d.verified_at) - min(epoch_us(i.ts))) / 86400e6 AS days
FROM dig d JOIN ind i ON i.line_id = d.line_id AND i.ts <= d.verified_at AND abs(i.chainage_peak_m - d.at_m) <= 15 GROUP BY d.line_id, d.verified_at)
SELECT round(median(days), 6) + 0.0 AS median_days, count(*) AS n FROM days"""))
def median_days_to_verification(spark, sf):
    ind, truth = _digs(spark, sf)
    return feedback.median_days(truth, ind.withColumnRenamed("ts", "created_at")).select(rnd("median_days").alias("median_days"), "n")


@query(q(IND_SRC, """
, dig AS (SELECT line_id, max_by(indication_id, anomaly_score) AS vid, max_by(chainage_peak_m, anomaly_score) AS at_m FROM ind WHERE run_id = 2 GROUP BY 1),
cur AS (SELECT source_id AS defect_id, line_id, chainage_m FROM src WHERE kind = 'defect'),
near AS (
  SELECT d.line_id, d.vid, d.at_m, c.defect_id, row_number() OVER (PARTITION BY d.line_id ORDER BY abs(c.chainage_m - d.at_m), c.chainage_m, c.defect_id) AS k
  FROM dig d LEFT JOIN cur c ON c.line_id = d.line_id AND abs(c.chainage_m - d.at_m) <= 15),
hit AS (SELECT * FROM near WHERE k = 1)
SELECT c.defect_id, c.line_id, 0 AS revision, round(c.chainage_m, 6) + 0.0 AS chainage_m, 'survey' AS source, h.defect_id IS NULL AS present
FROM cur c LEFT JOIN hit h ON h.defect_id = c.defect_id
UNION ALL
SELECT coalesce(defect_id, concat('excavation_', substr(sha256(concat_ws('|', line_id, vid)), 1, 12))), line_id, CASE WHEN defect_id IS NULL THEN 0 ELSE 1 END,
  round(at_m, 6) + 0.0, 'excavation', true FROM hit"""))
def scd2_upsert(spark, sf):
    _, dug = _digs(spark, sf)
    checks = dug.select(F.col("defect_id").alias("verification_id"), "line_id", "chainage_m", F.lit("scc").alias("defect_type"), "verified_at")
    truth = v.sources(spark, sf).filter("kind = 'defect'").select(
        F.col("source_id").alias("defect_id"), "line_id", F.lit(0).alias("revision"), "chainage_m", "defect_type", F.lit("survey").alias("source"),
        F.lit(None).cast("timestamp").alias("verified_at"), F.lit("2024-01-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"),
    )
    table, _ = feedback.record_excavations(checks, truth, v.TOLERANCE)
    return table.select("defect_id", "line_id", "revision", rnd("chainage_m").alias("chainage_m"), "source", F.col("valid_to").isNull().alias("present"))


@query(q(IND, f"""
, dig AS (SELECT line_id, max_by(survey_id, anomaly_score) AS survey_id, max_by(chainage_peak_m, anomaly_score) AS at_m, max(anomaly_score) * 0.8 AS y FROM ind WHERE run_id = 2 GROUP BY 1),
near AS (
  SELECT d.y, i.anomaly_score * 0.5 AS lo, i.anomaly_score * 0.9 AS hi,
         row_number() OVER (PARTITION BY d.line_id ORDER BY abs(i.chainage_peak_m - d.at_m), i.chainage_peak_m, i.indication_id) AS k
  FROM dig d JOIN ind i ON i.survey_id = d.survey_id AND abs(i.chainage_peak_m - d.at_m) <= 15)
SELECT {r6('avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)')} AS empirical, 0.9 AS nominal, count(*) AS n,
       avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) < 0.9 AS below_nominal FROM near WHERE k = 1""".replace("0.9 AS nominal", "CAST(0.9 AS DOUBLE) AS nominal")))
def verified_coverage(spark, sf):
    ind, truth = _digs(spark, sf)
    shown = ind.withColumn("sev_lo", F.col("anomaly_score") * 0.5).withColumn("sev_hi", F.col("anomaly_score") * 0.9)
    obs = truth.select("defect_id").join(ind.select(F.col("indication_id").alias("defect_id"), "survey_id", (F.col("anomaly_score") * 0.8).alias("severity_smys")), "defect_id")
    got = feedback.verified_coverage(obs, truth, shown, v.VERSION, 0.9)
    return got.select(rnd("empirical").alias("empirical"), "nominal", "n", "below_nominal")


@query(q(R, """
SELECT survey_id, sample_idx, concat(line_id, '::', CAST(floor(chainage_m / 24.0) AS BIGINT)) AS group_key,
  CAST(list_reduce(list_prepend(0, list_transform(string_split(sha256(concat(line_id, '::', CAST(floor(chainage_m / 24.0) AS BIGINT))), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, b: (a * 16 + b) % 5) AS BIGINT) AS fold
FROM r"""))
def fold_by_hash(spark, sf):
    got = metrics.with_fold(v.readings(spark, sf).df, s.group_key(F.col("line_id"), F.col("chainage_m"), 24.0), 5)
    return got.select("survey_id", "sample_idx", "group_key", "fold")


@query("""
SELECT DISTINCT user_id AS line_id,
  CAST(list_reduce(list_prepend(0, list_transform(string_split(sha256(CAST(user_id AS VARCHAR)), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, b: (a * 16 + b) % 5) AS BIGINT) AS fold
FROM events""")
def fold_by_line(spark, sf):
    lines = v.table(spark, sf, "events").select(F.col("user_id").alias("line_id")).distinct()
    return metrics.with_fold(lines, F.col("line_id").cast("string"), 5).select("line_id", "fold")


@query("""
SELECT lang, sha256(concat_ws('|', CAST(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST(concat('0x', substr(h, 31, 15)) AS BIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(h, 46, 15)) AS BIGINT)) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS data_sha256
FROM (SELECT lang, sha256(text) AS h FROM documents) GROUP BY 1""")
def corpus_hash(spark, sf):
    docs = v.table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("h"))
    return identity.corpus_hash(docs, "h", ["lang"])


@query("SELECT event_id, substr(sha256(concat_ws('|', user_id, 'v1', event_id, printf('%.3f', value))), 1, 24) AS id FROM events")
def deterministic_id(spark, sf):
    e = v.table(spark, sf, "events")
    return e.select("event_id", s.deterministic_id(F.col("user_id").cast("string"), F.lit("v1"), F.col("event_id"), F.col("value")).alias("id"))


@query(q(R, """
, f AS (SELECT survey_id, CAST(round(chainage_m, 6) AS DECIMAL(38, 6))::VARCHAR AS c, event_type AS e, sample_idx::VARCHAR AS i, CAST(round(value, 6) AS DECIMAL(38, 6))::VARCHAR AS v FROM r),
t AS (SELECT survey_id, sha256(concat_ws('|', coalesce(concat(length(c), ':', c), 'n'), coalesce(concat(length(e), ':', e), 'n'), coalesce(concat(length(i), ':', i), 'n'), coalesce(concat(length(v), ':', v), 'n'))) AS h FROM f)
SELECT survey_id, sha256(concat_ws('|', CAST(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT)) AS VARCHAR),
  CAST(sum(CAST(concat('0x', substr(h, 31, 15)) AS BIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(h, 46, 15)) AS BIGINT)) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS content_sha256 FROM t GROUP BY 1"""))
def content_hashes(spark, sf):
    rows = v.readings(spark, sf).df.select("survey_id", "sample_idx", "chainage_m", "value", "event_type")
    return identity.content_hashes(rows, "survey_id", ["sample_idx", "chainage_m", "value", "event_type"])


@query(q(R, """
, b AS (SELECT line_id, run_id, max(survey_id) AS survey_id, count(*) AS n FROM r GROUP BY 1, 2),
known AS (SELECT line_id, 0 AS run_id, sum(CASE WHEN event_type = 'error' THEN 2 ELSE 1 END) AS n FROM r WHERE run_id = 0 GROUP BY 1)
SELECT b.survey_id, CASE WHEN k.n IS NULL THEN 'accepted' WHEN k.n = b.n THEN 'noop' ELSE 'conflict' END AS outcome
FROM b LEFT JOIN known k ON k.line_id = b.line_id AND k.run_id = b.run_id"""))
def register_conflicts(spark, sf):
    r = v.reading_rows(spark, sf)
    batch = r.groupBy("line_id", "run_id").agg(F.max("survey_id").alias("survey_id"), F.count(F.lit(1)).alias("content_sha256"))
    known = r.filter("run_id = 0").groupBy("line_id", "run_id").agg(F.sum(F.when(F.col("event_type") == "error", 2).otherwise(1)).alias("content_sha256"))
    return identity.register(batch, known).select("survey_id", "outcome")


@query(q(R, """
, b AS (SELECT survey_id, run_id, sha256(CAST(count(*) AS VARCHAR)) AS h FROM r GROUP BY 1, 2)
SELECT survey_id FROM b WHERE NOT (run_id = 0 OR (run_id = 1 AND h = sha256('20')))"""))
def incremental_todo(spark, sf):
    r = v.reading_rows(spark, sf)
    batch = r.groupBy("survey_id", "run_id").agg(F.sha2(F.count(F.lit(1)).cast("string"), 256).alias("content_sha256")).withColumn("feature_version", F.lit(3).cast("long"))
    done = batch.filter("run_id < 2").withColumn("content_sha256", F.when(F.col("run_id") == 1, F.sha2(F.lit("20"), 256)).otherwise(F.col("content_sha256")))
    return identity.todo(batch, done).select("survey_id")


@query(q(R, f"""
, s AS (SELECT survey_id, max(ts) AS surveyed_at FROM r GROUP BY 1)
SELECT r.survey_id, count(*) AS n_rows, {r6('max(r.chainage_m)')} AS end_m FROM r JOIN s USING (survey_id) WHERE s.surveyed_at <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1"""))
def asof_corpus(spark, sf):
    r = v.reading_rows(spark, sf)
    surveys = r.groupBy("survey_id").agg(F.max("ts").alias("surveyed_at"))
    known = io.known_rows(r, surveys, dt.datetime(2024, 1, 20, 12))
    return known.groupBy("survey_id").agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.max("chainage_m")).alias("end_m"))


@query(q(R, f"""
SELECT survey_id, count(*) AS n_samples, {r6('min(chainage_m)')} AS start_m, {r6('max(chainage_m)')} AS end_m,
       {r6('(max(chainage_m) - min(chainage_m)) / greatest(1, count(*) - 1)')} AS step_m FROM r GROUP BY 1"""))
def survey_metadata(spark, sf):
    rows = v.reading_rows(spark, sf).withColumn("source_uri", F.lit("events"))
    got = io.survey_metadata(rows, "chainage_m", "ts")
    return got.select("survey_id", "n_samples", rnd("start_m").alias("start_m"), rnd("end_m").alias("end_m"), rnd("step_m").alias("step_m"))


@query("""
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def latest_row(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return io.latest_by(o, ["o_custkey"], "o_orderdate").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT event_type, min_by(event_id, event_id) AS event_id, min_by(value, event_id) AS value FROM events GROUP BY 1""")
def examples_per_class(spark, sf):
    e = v.table(spark, sf, "events").select("event_type", "event_id", "value")
    return metrics.examples_per_class(e, "event_type", "event_id")


@query(q(IND, """SELECT indication_id, survey_id FROM ind WHERE dq_flag = 'clean' AND run_id > 0"""))
def published_slice(spark, sf):
    rows = v.found(spark, sf).withColumn("is_shadow", (F.col("dq_flag") != "clean").cast("int")).withColumn(
        "pipeline_version", F.when(F.col("run_id") > 0, "v1").otherwise("v0"))
    return io.published_slice(rows, "v1").select("indication_id", "survey_id")


@query(q(IND.replace(R, FIX), f"""
SELECT 'Feature' AS kind, 'Point' AS geometry, {r6('f.lon')} AS lon, {r6('f.lat')} AS lat, i.indication_id, i.survey_id, {r6('i.anomaly_score')} AS anomaly_score
FROM ind i JOIN f ON f.survey_id = i.survey_id AND f.sample_idx = i.peak_sample_idx WHERE f.lat IS NOT NULL AND f.lon IS NOT NULL"""))
def geojson_features(spark, sf):
    rows = cut(v.found(spark, sf)).join(v.fixes(v.readings(spark, sf)).df.select("survey_id", F.col("sample_idx").alias("peak_sample_idx"), "lat", "lon"), ["survey_id", "peak_sample_idx"], "left")
    shape = "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<indication_id: string, survey_id: string, anomaly_score: double>"
    g = io.geojson(rows, ["indication_id", "survey_id", "anomaly_score"]).select(F.from_json("value", shape).alias("g"))
    return g.select(
        F.col("g.type").alias("kind"), F.col("g.geometry.type").alias("geometry"), rnd(F.col("g.geometry.coordinates")[0]).alias("lon"), rnd(F.col("g.geometry.coordinates")[1]).alias("lat"),
        "g.properties.indication_id", "g.properties.survey_id", rnd(F.col("g.properties.anomaly_score")).alias("anomaly_score"),
    )
