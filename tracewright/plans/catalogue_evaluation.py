"""Queries of metrics, drift, profiles and growth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import drift, growth, islands, learn, matching, metrics, profile
from ..operators.guards import key_set_differences
from ..operators.quantiles import median_mad
from ..session import cut
from . import evaluation
from . import views as v
from .catalogue import query
from .monitoring import monitor_surveys as run_monitor
from .monitoring import training_reference
from .sql_views import DOC, HEADS, IND, L, R, REV, q, r6
from .views import r6 as rnd

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(q(R, f"""
, t AS (SELECT line_id, value AS s, sum(CAST(event_type = 'error' AS INT)) AS tp, count(*) AS n FROM r GROUP BY 1, 2),
c AS (SELECT *, sum(tp) OVER w AS ct, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY line_id) AS p, sum(n) OVER (PARTITION BY line_id) AS a FROM t WINDOW w AS (PARTITION BY line_id ORDER BY s DESC))
SELECT line_id, CASE WHEN max(p) > 0 AND max(p) < max(a) THEN {r6('sum(tp * ct / cn) / max(p)')} END AS average_precision, max(p)::BIGINT AS n_pos, max(a)::BIGINT AS n_all FROM c GROUP BY 1"""))
def average_precision(spark, sf):
    ap = metrics.average_precision(v.reading_rows(spark, sf), ["line_id"], F.col("event_type") == "error", "value")
    return ap.select("line_id", rnd("average_precision").alias("average_precision"), "n_pos", "n_all")


@query(q(R, f"""
, x AS (SELECT event_type, 'value' AS feature, value AS x FROM r UNION ALL SELECT event_type, 'chainage_m', chainage_m FROM r),
y AS (SELECT feature, 'error_vs_*' AS contrast, event_type = 'error' AS y, x FROM x UNION ALL SELECT feature, 'error_vs_signup', event_type = 'error', x FROM x WHERE event_type IN ('error', 'signup')),
z AS (SELECT feature, contrast, sg, sg * x AS v, sum(CAST(y AS INT)) AS tp, count(*) AS n FROM y CROSS JOIN (VALUES (1), (-1)) AS k(sg) GROUP BY 1, 2, 3, 4),
c AS (SELECT *, sum(tp) OVER w AS ct, sum(n) OVER w AS cn FROM z WINDOW w AS (PARTITION BY feature, contrast, sg ORDER BY v DESC)),
a AS (SELECT feature, contrast, sg, sum(tp * ct / cn) / sum(tp) AS ap, sum(tp) / sum(n) AS br FROM c GROUP BY 1, 2, 3)
SELECT feature, contrast, {r6('max(ap)')} AS average_precision, {r6('max(br)')} AS base_rate FROM a GROUP BY 1, 2"""))
def separability(spark, sf):
    got = profile.separability(v.reading_rows(spark, sf), "event_type", ["value", "chainage_m"], [("error", "*"), ("error", "signup")])
    return got.select("feature", "contrast", rnd("average_precision").alias("average_precision"), rnd("base_rate").alias("base_rate"))


def _resampled(units: str, value: str, keys: str = "") -> str:
    """500 replicates of ``units`` (a table with line_id, v and the keys) and the ends of their interval."""
    by, rows = (f"{keys}, ", f"{keys}, b") if keys else ("", "b")
    weight = " + ".join(f"CAST(u >= {t!r} AS DOUBLE)" for t in metrics.POISSON_STEPS)
    return f""", un AS ({units}),
dr AS (SELECT un.*, b, CAST(concat('0x', substr(sha256(concat_ws('|', '42', line_id, b)), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u FROM un, range(1, 501) AS t(b)),
wt AS (SELECT *, {weight} AS w FROM dr),
pe AS (SELECT {rows}, sum(v * w) / sum(w) AS m FROM wt GROUP BY {rows}),
pt AS (SELECT {by}{r6('avg(v)')} AS {value}_point FROM un{' GROUP BY ' + keys if keys else ''}),
en AS (SELECT {by}{r6('quantile_cont(m, 0.025)')} AS {value}_lo, {r6('quantile_cont(m, 0.975)')} AS {value}_hi FROM pe{' GROUP BY ' + keys if keys else ''})
SELECT * FROM pt {f'JOIN en USING ({keys})' if keys else 'CROSS JOIN en'}"""


@query(q(R, _resampled("SELECT event_type, line_id, avg(value) AS v FROM r GROUP BY 1, 2", "mean_value", "event_type")))
def bootstrap_ci(spark, sf):
    units = v.reading_rows(spark, sf).groupBy("event_type", "line_id").agg(F.avg("value").alias("mean_value"))
    got = metrics.bootstrap(units, ["event_type"], "line_id", ["mean_value"], 500, 0.95, 42)
    return got.select("event_type", *[rnd(f"mean_value_{c}").alias(f"mean_value_{c}") for c in ("point", "lo", "hi")])


@query(q(R, _resampled("SELECT line_id, avg(value) FILTER (WHERE run_id = 0) - avg(value) FILTER (WHERE run_id > 0) AS v FROM r GROUP BY 1 HAVING v IS NOT NULL", "delta")))
def paired_bootstrap(spark, sf):
    units = v.reading_rows(spark, sf).groupBy("line_id").agg(
        F.avg(F.when(F.col("run_id") == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("run_id") > 0, F.col("value"))).alias("b")
    )
    got = metrics.paired_bootstrap(units.dropna(), [], "line_id", "a", "b", 500, 0.95, 42)
    return got.select(*[rnd(f"delta_{c}").alias(f"delta_{c}") for c in ("point", "lo", "hi")])


@query(q(R, f"""
, a AS (SELECT line_id, avg(value) AS a FROM r WHERE run_id = 0 GROUP BY 1), b AS (SELECT line_id, avg(value) AS b FROM r WHERE run_id > 0 GROUP BY 1)
SELECT line_id, {r6('a')} AS a, {r6('b')} AS b FROM a JOIN b USING (line_id)"""))
def paired_values(spark, sf):
    """The first run of each line beside all later ones."""
    r = v.reading_rows(spark, sf)
    mean = lambda rows: rows.groupBy("line_id").agg(F.avg("value").alias("value"))
    got = matching.pair_values(mean(r.filter("run_id = 0")), mean(r.filter("run_id > 0")), "line_id")
    return got.select("line_id", rnd("a").alias("a"), rnd("b").alias("b"))


@query("""
WITH c AS (SELECT o_orderkey, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS p FROM orders),
e AS (SELECT list_distinct(quantile_cont(y, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS es FROM c),
b AS (SELECT len(list_filter(list_sort(es)[2:len(es) - 1], lambda t: t < y)) AS bin, abs(y - p) AS err FROM c, e)
SELECT bin, round(avg(err), 3) + 0.0 AS mae, count(*) AS n FROM b GROUP BY 1""")
def mae_by_decile(spark, sf):
    o = v.table(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("y"))
    mean = o.groupBy("o_custkey").agg(F.avg("y").alias("p"))
    got = metrics.error_by_quantile(o.join(mean, "o_custkey"), "y", "p")
    return got.select("bin", rnd("mae", 3).alias("mae"), "n")


@query(q(DOC, f"""
, e AS (SELECT list_distinct(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS es FROM d),
b AS (SELECT len(list_filter(list_sort(es)[2:len(es) - 1], lambda t: t < score)) AS bin, score, quality FROM d, e)
SELECT bin, {r6('avg(score)')} AS bin_mean_confidence, {r6('avg(quality)')} AS bin_accuracy, count(*) AS n FROM b GROUP BY 1"""))
def reliability(spark, sf):
    got = metrics.reliability(v.scored_documents(spark, sf), "score", "quality")
    return got.select("bin", rnd("bin_mean_confidence").alias("bin_mean_confidence"), rnd("bin_accuracy").alias("bin_accuracy"), "n")


@query(q(DOC, f"""SELECT source, {r6('avg(power(score - quality, 2) + power(1 - score - (1 - quality), 2))')} AS brier, count(*) AS n FROM d GROUP BY 1"""))
def brier(spark, sf):
    d = v.scored_documents(spark, sf).withColumn("k", F.col("quality").cast("string")).withColumn("p", F.array(1 - F.col("score"), F.col("score")))
    return metrics.brier(d, ["source"], "k", "p", ["0", "1"]).select("source", rnd("brier").alias("brier"), "n")


@query(q(DOC, f"""
, f AS (SELECT source, min_by(lang, doc_id) AS true_class FROM d GROUP BY 1)
SELECT source, true_class, {r6("avg(CAST(CASE WHEN score > 0.5 THEN 'en' ELSE lang END = true_class AS INT))")} AS recall FROM d JOIN f USING (source) GROUP BY 1, 2"""))
def class_recall(spark, sf):
    d = v.scored_documents(spark, sf).withColumn("pred", F.when(F.col("score") > 0.5, "en").otherwise(F.col("lang")))
    got = metrics.class_recall_units(d, "source", "doc_id", "lang", "pred")
    return got.select("source", "true_class", rnd("recall").alias("recall"))


@query(q(DOC, f"""SELECT source, {r6("avg(CAST(quality = 1 AS INT))")} AS precision FROM d WHERE score > 0.3 GROUP BY 1"""))
def class_precision(spark, sf):
    d = v.scored_documents(spark, sf).withColumn("pred", (F.col("score") > 0.3).cast("int"))
    got = metrics.class_precision_units(d, "source", "quality", "pred", 1)
    return got.select("source", rnd("precision").alias("precision"))


_CUST = """
WITH c AS (SELECT o_custkey, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS p FROM orders),
i AS (SELECT *, p * 0.6 AS lo, p * 1.4 AS hi FROM c)"""


@query(_CUST + """ SELECT o_custkey, round(avg(CAST(y BETWEEN lo AND hi AS INT)), 6) + 0.0 AS coverage, round(avg(abs(y - p)), 3) + 0.0 AS mae, round(avg(hi - lo), 3) + 0.0 AS interval_width FROM i GROUP BY 1""")
def group_coverage(spark, sf):
    got = metrics.group_interval_metrics(_customer_intervals(spark, sf), "o_custkey", "y", "p", "lo", "hi")
    return got.select("o_custkey", rnd("coverage").alias("coverage"), rnd("mae", 3).alias("mae"), rnd("interval_width", 3).alias("interval_width"))


@query(_CUST + """ SELECT round(avg(CAST(y BETWEEN lo AND hi AS INT)), 6) + 0.0 AS empirical, CAST(0.9 AS DOUBLE) AS nominal, count(*) AS n, avg(CAST(y BETWEEN lo AND hi AS INT)) < 0.9 AS below_nominal FROM i""")
def coverage_nominal(spark, sf):
    got = metrics.coverage_vs_nominal(_customer_intervals(spark, sf), "y", "lo", "hi", 0.9)
    return got.select(rnd("empirical").alias("empirical"), "nominal", "n", "below_nominal")


@query(_CUST + """ SELECT o_custkey, round(avg(CAST(y BETWEEN lo AND hi AS INT)), 6) + 0.0 AS empirical, avg(CAST(y BETWEEN lo AND hi AS INT)) BETWEEN 0.87 AND 0.93 AS passed FROM i GROUP BY 1""")
def coverage_gate(spark, sf):
    got = evaluation.severity_gate(metrics.coverage_vs_nominal(_customer_intervals(spark, sf), "y", "lo", "hi", 0.9, ["o_custkey"]))
    return got.select("o_custkey", rnd("empirical").alias("empirical"), "passed")


def _customer_intervals(spark, sf):
    o = v.table(spark, sf, "orders").select("o_custkey", F.col("o_totalprice").alias("y"))
    mean = o.groupBy("o_custkey").agg(F.avg("y").alias("p"))
    return o.join(mean, "o_custkey").withColumn("lo", F.col("p") * 0.6).withColumn("hi", F.col("p") * 1.4)


@query("""
WITH c AS (SELECT o_orderpriority, o_totalprice AS y, avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS p FROM orders)
SELECT o_orderpriority, round(quantile_cont(abs(y - p), 0.5), 3) + 0.0 AS median_abs_error_m, round(quantile_cont(abs(y - p), 0.9), 3) + 0.0 AS p90_abs_error_m,
       round(max(abs(y - p)), 3) + 0.0 AS max_abs_error_m, round(quantile_cont(abs(y - p), 0.5) * 100, 1) + 0.0 AS median_abs_error_cm FROM c GROUP BY 1""")
def registration_error(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").alias("y"))
    mean = o.groupBy("o_orderpriority").agg(F.avg("y").alias("p"))
    got = metrics.absolute_error_summary(o.join(mean, "o_orderpriority"), ["o_orderpriority"], "y", "p")
    return got.select(
        "o_orderpriority", *[rnd(c, 3).alias(c) for c in ("median_abs_error_m", "p90_abs_error_m", "max_abs_error_m")], rnd("median_abs_error_cm", 1).alias("median_abs_error_cm")
    )


_LONG = """
u AS (SELECT year(l_shipdate) AS yr, unnest([{'f': 'l_quantity', 'x': l_quantity}, {'f': 'l_extendedprice', 'x': l_extendedprice}, {'f': 'l_discount', 'x': l_discount}, {'f': 'l_tax', 'x': l_tax}]) AS i FROM lineitem),
ref AS (SELECT i.f AS feature, i.x AS x FROM u WHERE yr <= 1997), cur AS (SELECT i.f AS feature, i.x AS x FROM u WHERE yr >= 1998),
ed AS (SELECT feature, quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS es FROM ref GROUP BY 1)"""

_PSI = _LONG + """,
bn AS (SELECT feature, side, least(len(list_filter(es, lambda e: e <= least(greatest(x, es[1]), es[11]))) - 1, 9) AS bin FROM (SELECT *, 'r' AS side FROM ref UNION ALL SELECT *, 'c' FROM cur) JOIN ed USING (feature)),
ct AS (SELECT feature, bin, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'c') AS c FROM bn GROUP BY 1, 2),
al AS (SELECT ed.feature, b.bin, coalesce(r, 0) AS r, coalesce(c, 0) AS c FROM ed CROSS JOIN range(10) AS b(bin) LEFT JOIN ct ON ct.feature = ed.feature AND ct.bin = b.bin),
pc AS (SELECT feature, greatest(r / sum(r) OVER (PARTITION BY feature), 1e-6) AS pr, greatest(c / sum(c) OVER (PARTITION BY feature), 1e-6) AS pc FROM al),
ps AS (SELECT feature, sum((pc - pr) * ln(pc / pr)) AS psi FROM pc GROUP BY 1)"""

_KS = """,
st AS (SELECT feature, x, sum(r) AS r, sum(c) AS c FROM (SELECT feature, x, 1 AS r, 0 AS c FROM ref UNION ALL SELECT feature, x, 0, 1 FROM cur) GROUP BY 1, 2),
cu AS (SELECT feature, sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS fr, sum(c) OVER w / sum(c) OVER (PARTITION BY feature) AS fc FROM st WINDOW w AS (PARTITION BY feature ORDER BY x)),
ks AS (SELECT feature, max(abs(fr - fc)) AS ks_stat FROM cu GROUP BY 1)"""


def _eras(spark, sf):
    l = v.table(spark, sf, "lineitem")
    year = F.year("l_shipdate")
    return drift.unpivot(l.filter(year <= 1997), FEATURES), drift.unpivot(l.filter(year >= 1998), FEATURES)


@query(q(_LONG, """
SELECT feature, round(avg(x), 4) + 0.0 AS mean, round(stddev_pop(x), 4) + 0.0 AS std, min(x) AS min, max(x) AS max, count(x) AS n, round(max(es[4]), 4) + 0.0 AS edge_3, round(max(es[10]), 4) + 0.0 AS edge_9
FROM ref JOIN ed USING (feature) GROUP BY 1"""))
def feature_summary(spark, sf):
    ref, _ = _eras(spark, sf)
    got = drift.feature_summary(ref)
    return got.select("feature", rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"), "min", "max", "n", rnd(F.col("bin_edges")[3], 4).alias("edge_3"), rnd(F.col("bin_edges")[9], 4).alias("edge_9"))


@query("SELECT feature, x FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY substr(sha256(concat_ws('|', '42', l_orderkey, l_linenumber, l_partkey)), 1, 13), x) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, l_orderkey, l_linenumber, l_partkey FROM lineitem" for c in FEATURES) + ") AS long_rows) AS ranked WHERE n <= 2000")
def reference_sample(spark, sf):
    l = v.table(spark, sf, "lineitem")
    long = drift.unpivot(l, FEATURES, ["l_orderkey", "l_linenumber", "l_partkey"])
    return drift.reference_sample(long, ["feature"], F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey"), 2000, 42).select("feature", "x")


@query(q(_PSI, f"SELECT feature, {r6('psi')} AS psi FROM ps"))
def psi_by_year(spark, sf):
    ref, cur = _eras(spark, sf)
    return drift.psi(ref, cur, drift.feature_summary(ref)).select("feature", rnd("psi").alias("psi"))


@query(q(_LONG + _KS, f"SELECT feature, {r6('ks_stat')} AS ks_stat FROM ks"))
def ks_by_year(spark, sf):
    ref, cur = _eras(spark, sf)
    return drift.ks(ref, cur).select("feature", rnd("ks_stat").alias("ks_stat"))


@query(q(_PSI + _KS, f"""
SELECT feature, {r6('psi')} AS psi, {r6('ks_stat')} AS ks_stat, CASE WHEN psi >= 0.3 THEN 'block' WHEN psi >= 0.2 THEN 'warn' ELSE 'ok' END AS status FROM ps JOIN ks USING (feature)"""))
def drift_report(spark, sf):
    ref, cur = _eras(spark, sf)
    got = drift.feature_drift(ref, cur, drift.feature_summary(ref))
    return got.select("feature", rnd("psi").alias("psi"), rnd("ks_stat").alias("ks_stat"), "status")


@query(q(IND, f"""
, e AS (SELECT line_id, run_id, max(chainage_m) - min(chainage_m) AS len FROM r GROUP BY 1, 2),
n AS (SELECT line_id, run_id, count(*) AS n FROM ind GROUP BY 1, 2),
k AS (SELECT e.line_id, e.run_id, coalesce(n, 0) * 1000.0 / len AS rate FROM e LEFT JOIN n USING (line_id, run_id)),
st AS (SELECT e.line_id, e.run_id, anomaly_score AS x, sum(CAST(ind.run_id = 0 AS INT)) AS r, sum(CAST(ind.run_id > 0 AS INT)) AS c FROM e JOIN ind ON ind.line_id = e.line_id AND ind.run_id IN (0, e.run_id) WHERE e.run_id > 0 GROUP BY 1, 2, 3),
cu AS (SELECT line_id, run_id, sum(r) OVER w / nullif(sum(r) OVER (PARTITION BY line_id, run_id), 0) AS fr, sum(c) OVER w / nullif(sum(c) OVER (PARTITION BY line_id, run_id), 0) AS fc FROM st WINDOW w AS (PARTITION BY line_id, run_id ORDER BY x)),
ks AS (SELECT line_id, run_id, max(abs(fr - fc)) AS ks_stat FROM cu GROUP BY 1, 2),
j AS (SELECT c.line_id, c.run_id, c.rate AS rc, p.rate AS rr, CASE WHEN p.rate > 0 THEN c.rate / p.rate END AS ratio FROM k c JOIN k p ON c.line_id = p.line_id AND c.run_id > 0 AND p.run_id = 0)
SELECT j.line_id, j.run_id, {r6('rc')} AS rate_current, {r6('rr')} AS rate_reference, {r6('ratio')} AS ratio, {r6('ks_stat')} AS ks_stat,
       coalesce(NOT (ratio BETWEEN 1.0 / 3 AND 3), false) AS flagged FROM j LEFT JOIN ks USING (line_id, run_id)"""))
def prediction_drift(spark, sf):
    ind = v.found(spark, sf).select("survey_id", "line_id", "run_id", F.col("anomaly_score").alias("x"))
    ext = v.survey_extents(spark, sf)
    walked = v.reading_rows(spark, sf).select("survey_id", "line_id", "run_id").distinct()
    rates = drift.indications_per_km(ind, ext, "survey_id").join(walked, "survey_id").select("line_id", "run_id", "rate")
    # every later run of a line beside its first
    later = walked.filter("run_id > 0").select("line_id", "run_id")
    first = lambda rows: rows.filter("run_id = 0").drop("run_id", "survey_id").join(later, "line_id")
    got = drift.prediction_drift(first(ind), ind.filter("run_id > 0"), first(rates), rates.filter("run_id > 0"), 3.0, ["line_id", "run_id"])
    return got.select("line_id", "run_id", *[rnd(c).alias(c) for c in ("rate_current", "rate_reference", "ratio", "ks_stat")], "flagged")


@query(q(IND, f"""
, e AS (SELECT survey_id, max(chainage_m) - min(chainage_m) AS len FROM r GROUP BY 1), n AS (SELECT survey_id, count(*) AS n FROM ind GROUP BY 1)
SELECT survey_id, {r6('coalesce(n, 0) * 1000.0 / len')} AS rate FROM e LEFT JOIN n USING (survey_id)"""))
def indications_per_km(spark, sf):
    got = drift.indications_per_km(v.found(spark, sf), v.survey_extents(spark, sf), "survey_id")
    return got.select("survey_id", rnd("rate").alias("rate"))


@query(q(R, """
, e AS (SELECT line_id, run_id, max(chainage_m) - min(chainage_m) AS len FROM r GROUP BY 1, 2) SELECT line_id, round(sum(len) / 1000.0, 9) + 0.0 AS km FROM e GROUP BY 1"""))
def surveyed_km(spark, sf):
    ext = islands.extents(v.reading_rows(spark, sf), ["line_id", "survey_id"], "chainage_m")
    return drift.surveyed_km(ext, ["line_id"]).select("line_id", rnd("km", 9).alias("km"))


@query(q(R, """
, a AS (SELECT survey_id, 'feature_drift' AS c, CASE WHEN avg(value) > 65 THEN 'block' WHEN avg(value) > 55 THEN 'warn' ELSE 'ok' END AS s FROM r GROUP BY 1),
b AS (SELECT survey_id, 'coverage' AS c, CASE WHEN max(chainage_m) < 230 THEN 'block' ELSE 'ok' END AS s FROM r GROUP BY 1), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
k AS (SELECT survey_id, max(CASE WHEN s = 'block' AND c = 'feature_drift' THEN 2 WHEN s IN ('block', 'warn') THEN 1 ELSE 0 END) AS w, count(*) FILTER (WHERE s <> 'ok') AS n_raised FROM u GROUP BY 1)
SELECT survey_id, ['ok', 'warn', 'block'][w + 1] AS status, n_raised FROM k"""))
def monitor_rollup(spark, sf):
    r = v.reading_rows(spark, sf)
    avg = F.avg("value")
    a = r.groupBy("survey_id").agg(F.when(avg > 65, "block").when(avg > 55, "warn").otherwise("ok").alias("status")).withColumn("check_name", F.lit("feature_drift"))
    b = r.groupBy("survey_id").agg(F.when(F.max("chainage_m") < 230, "block").otherwise("ok").alias("status")).withColumn("check_name", F.lit("coverage"))
    return drift.monitor([a, b], "survey_id")


@query(q(R, f"""
, m AS (SELECT survey_id, median(value) AS med, mad(value) AS mad FROM r GROUP BY 1)
SELECT survey_id, sample_idx, {r6('(value - med) / greatest(1e-9, 1.4826 * mad)')} AS score_mad FROM r JOIN m USING (survey_id)"""))
def robust_zscore(spark, sf):
    series = v.readings(spark, sf)
    got = learn.mad_scores(series.df, ["survey_id"], "value", longest=series.longest)
    return got.select("survey_id", "sample_idx", rnd("score_mad").alias("score_mad"))


@query("""
SELECT median(o_totalprice) AS med, round(mad(o_totalprice), 4) + 0.0 AS mad, count(*) AS n FROM orders""")
def median_mad_whole(spark, sf):
    got = median_mad(v.table(spark, sf, "orders"), [], "o_totalprice")
    return got.select("med", rnd("mad", 4).alias("mad"), "n")


@query(q(_LONG, """
SELECT feature, round(median(x), 4) + 0.0 AS median, round(CASE WHEN quantile_cont(x, 0.75) = quantile_cont(x, 0.25) THEN 1 ELSE quantile_cont(x, 0.75) - quantile_cont(x, 0.25) END, 4) + 0.0 AS iqr
FROM (SELECT i.f AS feature, i.x AS x FROM u) GROUP BY 1"""))
def robust_scaler(spark, sf):
    got = profile.robust_scale(v.table(spark, sf, "lineitem"), FEATURES)
    return got.select("feature", rnd("median", 4).alias("median"), rnd("iqr", 4).alias("iqr"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.98), 4) + 0.0 AS threshold, count(*) AS n FROM lineitem GROUP BY 1")
def quantile_threshold(spark, sf):
    got = learn.contamination_threshold(v.table(spark, sf, "lineitem"), "l_extendedprice", 0.02, ["l_returnflag"])
    return got.select("l_returnflag", rnd("threshold", 4).alias("threshold"), "n")


@query("SELECT CASE WHEN event_type = 'error' THEN 'defect' WHEN event_type = 'signup' THEN 'interference' ELSE 'background' END AS klass, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS share FROM events GROUP BY 1")
def class_balance(spark, sf):
    e = v.table(spark, sf, "events").withColumn("klass", s.class_label(F.col("event_type") == "error", F.col("event_type") == "signup"))
    return profile.class_balance(e, "klass").select("klass", "n", rnd("share").alias("share"))


@query("""
WITH u AS (SELECT l_returnflag, unnest([{'f': 'l_quantity', 'x': l_quantity}, {'f': 'l_extendedprice', 'x': l_extendedprice}]) AS i FROM lineitem)
SELECT l_returnflag, i.f AS feature, count(*) AS n, round(avg(i.x), 4) + 0.0 AS mean, round(stddev_samp(i.x), 4) + 0.0 AS std, round(skewness(i.x), 6) + 0.0 AS skew, round(median(i.x), 4) + 0.0 AS median FROM u GROUP BY 1, 2""")
def summary_stats(spark, sf):
    got = profile.summary_stats(v.table(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"])
    return got.select("l_returnflag", "feature", "n", rnd("mean", 4).alias("mean"), rnd("std", 4).alias("std"), rnd("skew").alias("skew"), rnd("median", 4).alias("median"))


@query("""
WITH j AS (SELECT lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, 'quality' AS feature, round(avg(CAST(quality IS NULL AS INT)) * 100, 6) + 0.0 AS missing_pct FROM j GROUP BY 1 UNION ALL
SELECT lang, 'toxic', round(avg(CAST(toxic IS NULL AS INT)) * 100, 6) + 0.0 FROM j GROUP BY 1""")
def missingness(spark, sf):
    j = v.table(spark, sf, "documents").select("doc_id", "lang").join(v.table(spark, sf, "labels"), "doc_id", "left")
    got = profile.missingness(j, "lang", ["quality", "toxic"])
    return got.select("lang", "feature", rnd("missing_pct").alias("missing_pct"))


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]))
def corr_pairs(spark, sf):
    got = profile.correlation_pairs(v.table(spark, sf, "lineitem"), FEATURES)
    return got.select("feature_a", "feature_b", rnd("r").alias("r"))


@query("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) + 0.0 AS r FROM lineitem" for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]) + ") AS pairs WHERE abs(r) >= 0.001")
def redundant_columns(spark, sf):
    got = profile.redundant_pairs(profile.correlation_pairs(v.table(spark, sf, "lineitem"), FEATURES), 0.001)
    return got.select("feature_a", "feature_b", rnd("r").alias("r"))


@query(q(R, f"""
SELECT survey_id, {r6("median(abs(value - 50)) FILTER (WHERE event_type = 'error')")} AS median_in, {r6("median(abs(value - 50)) FILTER (WHERE event_type <> 'error')")} AS median_out, {r6('max(abs(value - 50))')} AS max_abs,
  {r6("median(abs(value - 50)) FILTER (WHERE event_type = 'error') / nullif(median(abs(value - 50)) FILTER (WHERE event_type <> 'error'), 0)")} AS contrast FROM r GROUP BY 1"""))
def contrast(spark, sf):
    series = v.readings(spark, sf)
    rows = series.df.withColumn("resid", F.col("value") - 50)
    got = profile.contrast_ratio(rows, ["survey_id"], F.col("event_type") == "error", "resid", series.longest)
    return got.select("survey_id", *[rnd(c).alias(c) for c in ("median_in", "median_out", "max_abs", "contrast")])


@query(q(HEADS, f"""
, z AS (SELECT survey_id, stddev_samp(b_mid) AS a, stddev_samp(b_mid - b_lo) AS b FROM h GROUP BY 1)
SELECT survey_id, {r6('a')} AS std_head, {r6('b')} AS std_diff, CASE WHEN b > 0 THEN {r6('20 * log10(a / b)')} END AS rejection_db FROM z"""))
def common_mode_rejection(spark, sf):
    got = profile.common_mode_rejection(v.heads(v.reading_rows(spark, sf)), ["survey_id"], "b_mid", "b_lo")
    return got.select("survey_id", *[rnd(c).alias(c) for c in ("std_head", "std_diff", "rejection_db")])


@query(q(R, f"""
, k AS (SELECT *, concat('T', CAST(floor(chainage_m / 24.0) AS BIGINT)) AS obj FROM r), m AS (SELECT survey_id, median(value) AS med, mad(value) AS mad FROM r GROUP BY 1),
p AS (SELECT obj, k.survey_id, max(abs(value - med) / greatest(1.4826 * mad, 1e-9)) AS z, max(value) AS sev FROM k JOIN m USING (survey_id) GROUP BY 1, 2)
SELECT obj, {r6('avg(CAST(z > 4 AS INT))')} AS hit_rate, {r6('avg(z)')} AS mean_peak_z, {r6('avg(z / nullif(sev, 0))')} AS peak_per_severity, count(*) AS n_surveys FROM p GROUP BY 1"""))
def detectability(spark, sf):
    series = v.readings(spark, sf)
    hits = series.df.withColumn("obj", F.concat(F.lit("T"), F.floor(F.col("chainage_m") / 24.0).cast("string"))).withColumn("severity", F.col("value"))
    got = profile.detectability(hits, series.df, "survey_id", "obj", "value", "severity", longest=series.longest)
    return got.select("obj", *[rnd(c).alias(c) for c in ("hit_rate", "mean_peak_z", "peak_per_severity")], "n_surveys")


@query(q(DOC, f"""
, k AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS a,
        rank() OVER (PARTITION BY lang ORDER BY quality) + (count(*) OVER (PARTITION BY lang, quality) - 1) / 2.0 AS b FROM d)
SELECT lang, CASE WHEN isfinite(corr(a, b)) THEN {r6('corr(a, b)')} END AS spearman, count(*) AS n FROM k GROUP BY 1"""))
def spearman(spark, sf):
    got = metrics.spearman(v.scored_documents(spark, sf), ["lang"], "n_chars", "quality")
    return got.select("lang", rnd(s.finite(F.col("spearman"))).alias("spearman"), "n")


@query(q(DOC, f"""
, e AS (SELECT quantile_cont(n_chars, [1 / 3.0, 2 / 3.0]) AS es FROM d)
SELECT CAST(n_chars > es[1] AS BIGINT) + CAST(n_chars > es[2] AS BIGINT) AS bin, {r6('avg(quality)')} AS rate, count(*) AS n FROM d, e GROUP BY 1"""))
def rate_by_tercile(spark, sf):
    binned = metrics.bin_by_quantiles(v.scored_documents(spark, sf), [], "n_chars", 3)
    return binned.groupBy("bin").agg(rnd(F.avg("quality")).alias("rate"), F.count(F.lit(1)).alias("n"))


_SLOPE = REV + """,
sl AS (SELECT l_suppkey, count(*) AS n_obs, regr_sxx(ln(y_true), run_id) AS sxx, regr_syy(ln(y_true), run_id) AS syy, regr_sxy(ln(y_true), run_id) AS sxy FROM g {where} GROUP BY 1),
s AS (SELECT l_suppkey, n_obs, CASE WHEN sxx > 0 THEN sxy / sxx END AS slope, CASE WHEN sxx > 0 AND n_obs > 2 THEN greatest(0, syy - sxy * sxy / sxx) / (n_obs - 2) / sxx END AS v FROM sl),
p AS (SELECT sum(CASE WHEN v > 0 THEN 1 / v ELSE 1 END * slope) / sum(CASE WHEN v > 0 THEN 1 / v ELSE 1 END) AS pooled_rate, 1 / sum(CASE WHEN v > 0 THEN 1 / v ELSE 1 END) AS pooled_var, count(*) AS n_slopes
      FROM s WHERE n_obs >= 2 AND slope IS NOT NULL),
k AS (SELECT s.l_suppkey, n_obs, CASE WHEN n_obs >= 2 THEN slope END AS own, CASE WHEN n_obs >= 2 AND slope IS NOT NULL THEN coalesce(v, pooled_var) END AS ov, pooled_rate, pooled_var FROM s, p),
w AS (SELECT *, CASE WHEN own IS NULL THEN 0 ELSE (CASE WHEN ov > 0 THEN 1 / ov ELSE 0 END) / ((CASE WHEN ov > 0 THEN 1 / ov ELSE 0 END) + 1 / pooled_var) END AS wt FROM k),
z AS (SELECT l_suppkey, n_obs, own, ov, wt, CASE WHEN own IS NULL THEN pooled_rate ELSE wt * own + (1 - wt) * pooled_rate END AS rate FROM w)"""


@query(q(_SLOPE.format(where=""), f"SELECT l_suppkey, n_obs, {r6('slope')} AS slope, {r6('v')} AS slope_var FROM s"))
def growth_slopes(spark, sf):
    got = growth.log_slopes(v.yearly_revenue(spark, sf), "l_suppkey", "run_id", "y_true")
    return got.select("l_suppkey", "n_obs", rnd("slope").alias("slope"), rnd("slope_var").alias("slope_var"))


@query(q(_SLOPE.format(where=""), f"SELECT {r6('pooled_rate')} AS pooled_rate, round(pooled_var, 9) + 0.0 AS pooled_var, n_slopes FROM p"))
def growth_pooled(spark, sf):
    got = growth.pooled_rate(growth.log_slopes(v.yearly_revenue(spark, sf), "l_suppkey", "run_id", "y_true"))
    return got.select(rnd("pooled_rate").alias("pooled_rate"), rnd("pooled_var", 9).alias("pooled_var"), "n_slopes")


@query(q(_SLOPE.format(where=""), f"SELECT l_suppkey, n_obs, {r6('own')} AS own_rate, {r6('rate')} AS shrunk_rate, {r6('wt')} AS shrinkage_weight FROM z"))
def growth_shrunk(spark, sf):
    got = growth.fit_rates(v.yearly_revenue(spark, sf), "l_suppkey", "run_id", "y_true", 2)
    return got.select("l_suppkey", "n_obs", *[rnd(c).alias(c) for c in ("own_rate", "shrunk_rate", "shrinkage_weight")])


@query(q(_SLOPE.format(where="WHERE run_id <= 5"), """
, last AS (SELECT l_suppkey, max(run_id) AS r0, max_by(y_true, run_id) AS y0 FROM g WHERE run_id <= 5 GROUP BY 1)
SELECT t.l_suppkey, round(abs(y0 * exp(rate * (t.run_id - r0)) - t.y_true), 2) + 0.0 AS model_error, round(abs(y0 - t.y_true), 2) + 0.0 AS no_growth_error
FROM g t JOIN last USING (l_suppkey) JOIN z USING (l_suppkey) WHERE t.run_id = 6"""))
def growth_gate_errors(spark, sf):
    got = growth.gate_errors(v.yearly_revenue(spark, sf), "l_suppkey", "run_id", "y_true", [0, 1, 2, 3, 4, 5], 6, 2)
    return got.select("l_suppkey", rnd("model_error", 2).alias("model_error"), rnd("no_growth_error", 2).alias("no_growth_error"))


@query(q(_SLOPE.format(where=""), """
, c AS (SELECT l_suppkey, max_by(y_true, run_id) AS y FROM g GROUP BY 1),
e AS (SELECT c.l_suppkey, rate, y * 0.9 AS lo, y AS med, y * 1.1 AS hi FROM c JOIN z USING (l_suppkey))
SELECT l_suppkey, """ + ", ".join(
    f"CASE WHEN {c} >= 1e7 THEN 0.0 WHEN rate <= 0 THEN -1.0 ELSE round((ln(1e7) - ln({c})) / rate, 3) + 0.0 END AS {n}" for c, n in (("hi", "life_lo"), ("med", "life_med"), ("lo", "life_hi"))) + " FROM e"))
def remaining_life(spark, sf):
    g = v.yearly_revenue(spark, sf)
    rates = growth.fit_rates(g, "l_suppkey", "run_id", "y_true", 2)
    now = growth.latest_run(g, "l_suppkey", "run_id").join(rates, "l_suppkey")
    now = now.withColumn("lo", F.col("y_true") * 0.9).withColumn("hi", F.col("y_true") * 1.1)
    got = growth.remaining_life(now, "lo", "y_true", "hi", "shrunk_rate", 1e7)
    # an endless life is shown as -1
    return got.select("l_suppkey", *[F.when(F.col(c) == float("inf"), -1.0).otherwise(rnd(c, 3)).alias(c) for c in ("life_lo", "life_med", "life_hi")])


@query(q(DOC, f"""
, x AS (SELECT source, abs(score - quality) AS e FROM d), n AS (SELECT source, count(*) AS n FROM x GROUP BY 1),
s AS (SELECT x.source, n, e, row_number() OVER (PARTITION BY x.source ORDER BY e) - 1 AS i, (n - 1) * least(1.0, ceil((n + 1) * 0.9) / n) AS h FROM x JOIN n USING (source))
SELECT source, {r6('max(CASE WHEN i = floor(h) THEN e END) + (max(CASE WHEN i = ceil(h) THEN e END) - max(CASE WHEN i = floor(h) THEN e END)) * (max(h) - floor(max(h)))')} AS margin, max(n) AS n FROM s GROUP BY 1"""))
def conformal_margin(spark, sf):
    rows = v.scored_documents(spark, sf).withColumn("e", F.abs(F.col("score") - F.col("quality")))
    got = learn.conformal_margin(rows, "e", 0.1, ["source"])
    return got.select("source", rnd("margin").alias("margin"), "n")


@query(q(DOC, """
SELECT lang, round(avg(CASE WHEN quality = 1 THEN score END), 6) + 0.0 AS good, covered FROM d, (
  SELECT (SELECT count(*) FROM (SELECT DISTINCT source FROM d WHERE quality = 1 EXCEPT SELECT DISTINCT source FROM d WHERE quality = 0)) = 0 AS covered) GROUP BY lang, covered"""))
def class_subset(spark, sf):
    d = v.scored_documents(spark, sf)
    ok = metrics.classes_covered(d.filter("quality = 1"), d.filter("quality = 0"), "source")
    means = d.groupBy("lang").agg(rnd(F.avg(F.when(F.col("quality") == 1, F.col("score")))).alias("good"))
    return means.crossJoin(F.broadcast(ok))


@query(q(R, """
, a AS (SELECT DISTINCT line_id, CAST(floor(chainage_m / 24) AS BIGINT) AS block FROM r WHERE run_id = 0), b AS (SELECT DISTINCT line_id, CAST(floor(chainage_m / 24) AS BIGINT) AS block FROM r WHERE run_id = 1)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""))
def key_set_difference(spark, sf):
    r = v.reading_rows(spark, sf).withColumn("block", F.floor(F.col("chainage_m") / 24).cast("long"))
    return key_set_differences(r.filter("run_id = 0"), r.filter("run_id = 1"), ["line_id", "block"])


_MONITOR = IND + """,
lg AS (SELECT event_id, survey_id, run_id, i.f AS feature, i.x AS x FROM (
  SELECT event_id, survey_id, run_id, unnest([{'f': 'b_lo', 'x': value}, {'f': 'b_mid', 'x': value + chainage_m * 0.05}, {'f': 'b_hi', 'x': value * 0.5 + chainage_m * 0.1}]) AS i FROM r)),
ed AS (SELECT feature, quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS es FROM lg WHERE run_id = 0 GROUP BY 1),
sm AS (SELECT feature, x FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY substr(sha256(concat_ws('|', '42', event_id)), 1, 13), x) AS k FROM lg WHERE run_id = 0) WHERE k <= 2000),
ps AS (SELECT x FROM (SELECT anomaly_score AS x, row_number() OVER (ORDER BY substr(sha256(concat_ws('|', '42', indication_id)), 1, 13), anomaly_score) AS k FROM ind WHERE run_id = 0) WHERE k <= 2000),
sv AS (SELECT DISTINCT survey_id, feature FROM lg WHERE run_id > 0),
bn AS (SELECT '' AS survey_id, feature, x FROM sm UNION ALL SELECT survey_id, feature, x FROM lg WHERE run_id > 0),
bc AS (SELECT survey_id, feature, least(len(list_filter(es, lambda e: e <= least(greatest(x, es[1]), es[11]))) - 1, 9) AS bin, count(*) AS c FROM bn JOIN ed USING (feature) GROUP BY 1, 2, 3),
al AS (SELECT k.survey_id, k.feature, b.bin, coalesce(c, 0) AS c FROM (SELECT * FROM sv UNION ALL SELECT '', feature FROM ed) k CROSS JOIN range(10) AS b(bin) LEFT JOIN bc ON bc.survey_id = k.survey_id AND bc.feature = k.feature AND bc.bin = b.bin),
sh AS (SELECT survey_id, feature, bin, greatest(c / sum(c) OVER (PARTITION BY survey_id, feature), 1e-6) AS p FROM al),
psi AS (SELECT a.survey_id, a.feature, sum((a.p - b.p) * ln(a.p / b.p)) AS psi FROM sh a JOIN sh b ON a.feature = b.feature AND a.bin = b.bin AND a.survey_id <> '' AND b.survey_id = '' GROUP BY 1, 2),
kr AS (SELECT sv.survey_id, feature, x, 1 AS r, 0 AS c FROM sv JOIN sm USING (feature) UNION ALL SELECT survey_id, feature, x, 0, 1 FROM lg WHERE run_id > 0
       UNION ALL SELECT k.survey_id, 'prediction', x, 1, 0 FROM (SELECT DISTINCT survey_id FROM ind WHERE run_id > 0) k, ps UNION ALL SELECT survey_id, 'prediction', anomaly_score, 0, 1 FROM ind WHERE run_id > 0),
kt AS (SELECT survey_id, feature, x, sum(r) AS r, sum(c) AS c FROM kr GROUP BY 1, 2, 3),
kc AS (SELECT survey_id, feature, sum(r) OVER w / sum(r) OVER (PARTITION BY survey_id, feature) AS fr, sum(c) OVER w / sum(c) OVER (PARTITION BY survey_id, feature) AS fc FROM kt WINDOW w AS (PARTITION BY survey_id, feature ORDER BY x)),
ks AS (SELECT survey_id, feature, max(abs(fr - fc)) AS ks FROM kc GROUP BY 1, 2),
ex AS (SELECT survey_id, min(run_id) AS run_id, max(chainage_m) - min(chainage_m) AS len FROM r GROUP BY 1),
n0 AS (SELECT (SELECT count(*) FROM ind WHERE run_id = 0) / ((SELECT sum(len) FROM ex WHERE run_id = 0) / 1000.0) AS rate),
rt AS (SELECT ex.survey_id, CASE WHEN len > 0 THEN coalesce(n, 0) * 1000.0 / len ELSE 0 END AS rate FROM ex LEFT JOIN (SELECT survey_id, count(*) AS n FROM ind GROUP BY 1) USING (survey_id) WHERE run_id > 0),
me AS (SELECT split_part(survey_id, '_R', 1) AS line_id, survey_id, feature, median(x) AS med FROM lg GROUP BY 1, 2, 3),
zz AS (SELECT a.survey_id, a.feature, abs(max(a.med) - avg(b.med)) / nullif(stddev_samp(b.med), 0) AS z, count(b.med) AS n FROM me a LEFT JOIN me b ON a.line_id = b.line_id AND a.feature = b.feature AND a.survey_id <> b.survey_id GROUP BY 1, 2),
rg AS (SELECT survey_id, count(*) FILTER (WHERE n >= 2 AND z > 3) AS n_shifted FROM zz GROUP BY 1),
ft AS (SELECT survey_id, max(psi) AS psi_max, max_by(feature, psi) AS psi_feature, count(*) FILTER (WHERE psi >= 0.3) AS n_blocking, count(*) FILTER (WHERE psi >= 0.2) AS n_drifted FROM psi GROUP BY 1),
kf AS (SELECT survey_id, max(ks) FILTER (WHERE feature <> 'prediction') AS ks_max, max(ks) FILTER (WHERE feature = 'prediction') AS prediction_ks FROM ks GROUP BY 1),
rp AS (SELECT ft.*, ks_max, prediction_ks, rt.rate, rt.rate / n0.rate AS ratio, n_shifted FROM ft JOIN kf USING (survey_id) JOIN rt USING (survey_id) JOIN rg USING (survey_id), n0)"""


@query(q(_MONITOR, f"""
SELECT survey_id, CASE WHEN n_blocking > 0 THEN 'block' WHEN n_drifted > 0 OR NOT ratio BETWEEN 1.0 / 3 AND 3 OR n_shifted > 0 THEN 'warn' ELSE 'ok' END AS status,
       n_drifted + CAST(NOT ratio BETWEEN 1.0 / 3 AND 3 AS INT) + CAST(n_shifted > 0 AS INT) AS n_raised, {r6('psi_max')} AS psi_max, psi_feature, n_blocking, {r6('ks_max')} AS ks_max,
       {r6('rate')} AS rate, {r6('ratio')} AS ratio, {r6('prediction_ks')} AS prediction_ks, n_shifted FROM rp"""))
def monitor_surveys(spark, sf):
    """Every survey after its line's first against what the first surveys showed."""
    rows = cut(v.heads(v.readings(spark, sf).df))
    found = cut(v.found(spark, sf))
    heads = ["b_lo", "b_mid", "b_hi"]
    reference = training_reference(rows.filter("run_id = 0"), "event_id", heads, found.filter("run_id = 0"), "anomaly_score")
    registry = rows.select("survey_id", "line_id").distinct().withColumn("status", F.lit("accepted"))
    got = run_monitor(rows.filter("run_id > 0").select("survey_id"), registry, rows, found, reference, heads).report
    return got.select("survey_id", "status", "n_raised", "psi_feature", "n_blocking", "n_shifted", *[rnd(c).alias(c) for c in ("psi_max", "ks_max", "rate", "ratio", "prediction_ks")])
