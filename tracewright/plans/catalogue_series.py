"""Queries of series operators: derivatives, windows, background, peaks, registration, features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import baseline, features, plugins, registration, series as ts
from ..operators.matching import nearest_distance
from ..operators.ordered import Series, by_length, by_position, highest, indexed, order_rows
from ..session import cut
from . import views as v
from .catalogue import SQL, query
from .sql_views import FIX, L, R, q, r6
from .views import r6 as rnd

_WIN = L + """,
st AS (SELECT l_suppkey, (max(x) - min(x)) / greatest(1, count(*) - 1) AS step FROM l GROUP BY 1),
wn AS (SELECT l_suppkey, CAST(greatest(3, round_even({m} / step, 0)) AS INT) AS n0 FROM st),
w AS (SELECT l_suppkey, CASE WHEN n0 % 2 = 1 THEN n0 ELSE n0 + 1 END AS win FROM wn),
lw AS (SELECT l.*, win, win // 2 AS h, CASE WHEN (y < 40) <> (lag(y) OVER (PARTITION BY l_suppkey ORDER BY sample_idx) < 40) THEN 1.0 ELSE 0.0 END AS zc FROM l JOIN w USING (l_suppkey))"""


def _sized(spark, sf, metres: float) -> tuple[Series, Column]:
    s = v.items(spark, sf)
    win = ts.odd_window(metres, F.col("mean_step")).alias("win")
    # no more columns than are read: Python steps move all they get
    return s.with_df(ts.beside_mean_step(s, "x").select("l_suppkey", "sample_idx", "y", win)), F.col("win")


@query(q(_WIN.format(m=60.0), """
, z AS (SELECT l_suppkey, sample_idx, win, count(*) OVER f AS c, avg(y) OVER f AS mean, stddev_samp(y) OVER f AS std, max(y) OVER f AS mx, max(y) OVER f - min(y) OVER f AS ptp,
  kurtosis(y) OVER f AS kurt, avg(CASE WHEN y < 40 THEN 1.0 ELSE 0.0 END) OVER f AS low FROM lw
  WINDOW f AS (PARTITION BY l_suppkey ORDER BY sample_idx ROWS BETWEEN h PRECEDING AND h FOLLOWING))
SELECT l_suppkey, sample_idx, CASE WHEN c = win THEN round(mean, 5) + 0.0 END AS mean, CASE WHEN c = win THEN round(std, 5) + 0.0 END AS std, CASE WHEN c = win THEN round(mx, 5) + 0.0 END AS max,
  CASE WHEN c = win THEN round(ptp, 5) + 0.0 END AS ptp, CASE WHEN c = win AND win >= 4 THEN round(kurt, 4) + 0.0 END AS kurt FROM z"""))
def rolling_stats(spark, sf):
    s, reach = _sized(spark, sf, 60.0)
    got = ts.rolling_stats(s, "y", {"w": "win"}, reach).df
    return got.select("l_suppkey", "sample_idx", *[rnd(f"w_{c}", 5).alias(c) for c in ("mean", "std", "max", "ptp")], rnd("w_kurt", 4).alias("kurt"))


def _stretched(s: Series, rows: int) -> Series:
    """The same rows under an index with holes, in chunks far smaller than a key."""
    return replace(s, df=s.df.withColumn(s.idx, F.col(s.idx) * 3 + F.col(s.idx) % 2), longest=None, chunk_rows=rows, dense=False)


def _restored(sql: str, columns: str) -> str:
    return f"SELECT {columns.replace('sample_idx', 'sample_idx * 3 + sample_idx % 2 AS sample_idx')} FROM ({sql}) AS dense_rows"


@query(_restored(SQL["rolling_stats"], "l_suppkey, sample_idx, mean, std, max, ptp, kurt"))
def rolling_stats_gapped(spark, sf):
    s, reach = _sized(spark, sf, 60.0)
    got = ts.rolling_stats(_stretched(s, 128), "y", {"w": "win"}, reach).df
    return got.select("l_suppkey", "sample_idx", *[rnd(f"w_{c}", 5).alias(c) for c in ("mean", "std", "max", "ptp")], rnd("w_kurt", 4).alias("kurt"))


@query(q(_WIN.format(m=60.0), """
, z AS (SELECT l_suppkey, sample_idx, win, count(*) OVER f AS c, avg(zc) OVER f AS zcr, sum((y - 40) * (y - 40)) OVER f AS energy FROM lw
  WINDOW f AS (PARTITION BY l_suppkey ORDER BY sample_idx ROWS BETWEEN h PRECEDING AND h FOLLOWING))
SELECT l_suppkey, sample_idx, CASE WHEN c = win THEN round(zcr, 6) + 0.0 END AS zcr, CASE WHEN c = win THEN round(energy, 3) + 0.0 END AS energy FROM z"""))
def rolling_zcr_energy(spark, sf):
    s, reach = _sized(spark, sf, 60.0)
    s = s.with_df(s.df.withColumn("y", F.col("y") - 40))
    got = ts.rolling_stats(s, "y", {"w": "win"}, reach).df
    return got.select("l_suppkey", "sample_idx", rnd("w_zcr").alias("zcr"), rnd("w_energy", 3).alias("energy"))


@query(q(_WIN.format(m=60.0), f"""
SELECT l_suppkey, sample_idx, {r6('median(y) OVER (PARTITION BY l_suppkey ORDER BY sample_idx ROWS BETWEEN h PRECEDING AND h FOLLOWING)')} AS med FROM lw"""))
def rolling_median(spark, sf):
    s, reach = _sized(spark, sf, 60.0)
    return ts.rolling_median(s, "y", "win", reach, "med").df.select("l_suppkey", "sample_idx", rnd("med").alias("med"))


@query(q(R, f"""
, m AS (SELECT *, CAST(round(chainage_m * 1000) AS BIGINT) AS mm FROM r)
SELECT survey_id, sample_idx, {r6('avg(value) OVER f')} AS mean, count(*) OVER f AS n FROM m WINDOW f AS (PARTITION BY survey_id ORDER BY mm RANGE BETWEEN 12000 PRECEDING AND 12000 FOLLOWING)"""))
def metre_frames(spark, sf):
    got = ts.metre_frames(v.readings(spark, sf).df, ["survey_id"], "chainage_m", 12.0, {"mean": lambda w: F.avg("value").over(w), "n": lambda w: F.count("value").over(w)})
    return got.select("survey_id", "sample_idx", rnd("mean").alias("mean"), "n")


@query(q(L + ", l7 AS (SELECT l_suppkey, sample_idx, x, y / 7.0 AS y FROM l)", """
, z AS (SELECT l_suppkey, sample_idx, y, x - lag(x) OVER w AS hs, lead(x) OVER w - x AS hd, lag(y) OVER w AS y0, lead(y) OVER w AS y1 FROM l7 WINDOW w AS (PARTITION BY l_suppkey ORDER BY sample_idx))
SELECT l_suppkey, sample_idx, round(CASE WHEN hs IS NULL THEN (y1 - y) / hd WHEN hd IS NULL THEN (y - y0) / hs ELSE (hs * hs * y1 + (hd * hd - hs * hs) * y - hd * hd * y0) / (hs * hd * (hd + hs)) END, 2) + 0.0 AS slope FROM z"""))
def irregular_gradient(spark, sf):
    s = v.items(spark, sf)
    s = s.with_df(s.df.withColumn("y", F.col("y") / 7.0))
    return ts.gradient(s, "y", "x", "slope").df.select("l_suppkey", "sample_idx", rnd("slope", 2).alias("slope"))


@query(q(L, f"SELECT l_suppkey, sample_idx, {r6('max(y) OVER (PARTITION BY l_suppkey ORDER BY sample_idx)')} AS top FROM l"))
def monotone_clamp(spark, sf):
    return v.items(spark, sf).running(top=highest(F.col("y"))).df.select("l_suppkey", "sample_idx", rnd("top").alias("top"))


@query(q(FIX, """
, k AS (SELECT *, CASE WHEN lat IS NOT NULL THEN {'x': chainage_m, 'y': value} END AS kn FROM f),
z AS (SELECT survey_id, sample_idx, chainage_m AS x, last_value(kn IGNORE NULLS) OVER (PARTITION BY survey_id ORDER BY sample_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo,
      first_value(kn IGNORE NULLS) OVER (PARTITION BY survey_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM k)
SELECT survey_id, sample_idx, round(CASE WHEN lo IS NULL THEN hi.y WHEN hi IS NULL THEN lo.y WHEN hi.x = lo.x THEN lo.y ELSE lo.y + (hi.y - lo.y) / (hi.x - lo.x) * (x - lo.x) END, 6) + 0.0 AS filled FROM z"""))
def interpolate_missing(spark, sf):
    s = v.fixes(v.readings(spark, sf))
    got = ts.interpolate(s, "chainage_m", {"filled": F.when(F.col("lat").isNotNull(), F.col("value"))})
    return got.df.select("survey_id", "sample_idx", rnd("filled").alias("filled"))


@query(q(R, """
, b AS (SELECT survey_id, min(chainage_m) AS lo, max(chainage_m) AS hi FROM r GROUP BY 1),
g AS (SELECT survey_id, lo, unnest(range(CAST(ceil((hi - lo) / 2.0) AS BIGINT))) AS grid_i FROM b),
p AS (SELECT survey_id, grid_i, lo + grid_i * 2.0 AS gx FROM g),
s AS (SELECT survey_id, chainage_m, value, lead(chainage_m) OVER w AS nx, lead(value) OVER w AS nv FROM r WINDOW w AS (PARTITION BY survey_id ORDER BY sample_idx))
SELECT p.survey_id, p.grid_i, round(CASE WHEN s.nx IS NULL THEN s.value ELSE s.value + (s.nv - s.value) / (s.nx - s.chainage_m) * (p.gx - s.chainage_m) END, 5) + 0.0 AS value
FROM p ASOF JOIN s ON s.survey_id = p.survey_id AND s.chainage_m <= p.gx"""))
def grid_resample(spark, sf):
    got = ts.resample(v.readings(spark, sf), "chainage_m", "value", 2.0)
    return got.select("survey_id", "grid_i", rnd("value", 5).alias("value"))


@query(q(L, """
, z AS (SELECT *, lag(l_quantity) OVER w AS p FROM l WINDOW w AS (PARTITION BY l_suppkey ORDER BY sample_idx)),
g AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM l_quantity THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY sample_idx) AS run FROM z),
f AS (SELECT l_suppkey, run, min(sample_idx) AS a, max(sample_idx) AS b, min(l_quantity) AS value FROM g GROUP BY 1, 2),
n AS (SELECT *, lag(value) OVER w AS lo, lead(value) OVER w AS hi FROM f WINDOW w AS (PARTITION BY l_suppkey ORDER BY a))
SELECT l_suppkey, CAST((a + b) // 2 AS BIGINT) AS sample_idx, value FROM n WHERE value > lo AND value > hi"""))
def peak_local_max(spark, sf):
    return ts.local_maxima(v.items(spark, sf), "l_quantity").select("l_suppkey", "sample_idx", "value")


_PEAK = R + """,
z AS (SELECT *, lag(value) OVER w AS p FROM r WINDOW w AS (PARTITION BY survey_id ORDER BY sample_idx)),
g AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM value THEN 1 ELSE 0 END) OVER (PARTITION BY survey_id ORDER BY sample_idx) AS run FROM z),
f AS (SELECT survey_id, run, min(sample_idx) AS a, max(sample_idx) AS b, min(value) AS value FROM g GROUP BY 1, 2),
n AS (SELECT *, lag(value) OVER w AS lo, lead(value) OVER w AS hi FROM f WINDOW w AS (PARTITION BY survey_id ORDER BY a)),
pk AS (SELECT survey_id, CAST((a + b) // 2 AS BIGINT) AS sample_idx, value FROM n WHERE value > lo AND value > hi),
st AS (SELECT pk.*, (SELECT max(r.sample_idx) FROM r WHERE r.survey_id = pk.survey_id AND r.sample_idx < pk.sample_idx AND r.value > pk.value) AS ls,
       (SELECT min(r.sample_idx) FROM r WHERE r.survey_id = pk.survey_id AND r.sample_idx > pk.sample_idx AND r.value > pk.value) AS rs FROM pk),
pr AS (SELECT st.survey_id, st.sample_idx, st.value, st.value - greatest(min(r.value) FILTER (WHERE r.sample_idx <= st.sample_idx AND r.sample_idx > coalesce(ls, -1)),
       min(r.value) FILTER (WHERE r.sample_idx >= st.sample_idx AND r.sample_idx < coalesce(rs, 1000000000))) AS prom FROM st JOIN r USING (survey_id) GROUP BY 1, 2, 3)"""
_PEAK = _PEAK.replace("st JOIN r USING (survey_id) GROUP BY", "st JOIN r ON r.survey_id = st.survey_id GROUP BY")


@query(q(_PEAK, f"SELECT survey_id, sample_idx, value, {r6('prom')} AS prominence FROM pr"))
def peak_prominence(spark, sf):
    s = v.readings(spark, sf)
    s = s.with_df(cut(s.df))
    return ts.prominences(s, "value", ts.local_maxima(s, "value")).select("survey_id", "sample_idx", "value", rnd("prominence").alias("prominence"))


@query(_restored(SQL["peak_prominence"], "survey_id, sample_idx, value, prominence"))
def peak_prominence_gapped(spark, sf):
    placed = by_position(_stretched(v.readings(spark, sf), 64), "label")
    placed = placed.with_df(cut(placed.df))
    found = ts.prominences(placed, "value", ts.local_maxima(placed, "value"))
    labels = placed.df.select("survey_id", "sample_idx", "label")
    return found.join(labels, ["survey_id", "sample_idx"]).select("survey_id", F.col("label").alias("sample_idx"), "value", rnd("prominence").alias("prominence"))


@query()
def peak_shapes(spark, sf):
    s = v.items(spark, sf)
    s = s.with_df(cut(s.df.withColumn("r", F.abs(F.col("y") - 40)).withColumn("mean_step", F.lit(4.0))))
    peaks = ts.peak_shapes(s, "r", 2.0)
    got = ts.decay_exponents(s, "r", peaks, (0.5, 3.0), "mean_step")
    return got.select("l_suppkey", "sample_idx", *[rnd(c).alias(c) for c in ("prominence", "width", "asymmetry", "decay_exponent")])


@query(q(L, """
, c AS (SELECT l_suppkey, regr_slope(y, x) AS m, regr_intercept(y, x) AS b FROM l GROUP BY 1)
SELECT l_suppkey, sample_idx, round(y - (b + m * x), 4) + 0.0 AS resid FROM l JOIN c USING (l_suppkey)"""))
def poly_baseline_ols(spark, sf):
    s = v.items(spark, sf)
    coefs = baseline.robust_polynomial(s.df, ["l_suppkey"], "x", "y", degree=1, rounds=0)
    return baseline.remove_polynomial(s.df, ["l_suppkey"], "x", "y", coefs, "resid").select("l_suppkey", "sample_idx", rnd("resid", 4).alias("resid"))


@query()
def robust_baseline(spark, sf):
    s = v.items(spark, sf)
    s = s.with_df(cut(s.df.select("l_suppkey", "sample_idx", "x", "y")))
    return baseline.detrend(s, "x", {"y": "resid"}, window_m=120.0).df.select("l_suppkey", "sample_idx", rnd("resid", 4).alias("resid"))


@query(q(L, """
, e AS (SELECT l_suppkey, sample_idx, y - avg(y) OVER (PARTITION BY l_suppkey) AS v FROM l),
p AS (SELECT a.l_suppkey, b.sample_idx - a.sample_idx AS lag, sum(a.v * b.v) AS product FROM e a JOIN e b ON a.l_suppkey = b.l_suppkey AND b.sample_idx - a.sample_idx BETWEEN 1 AND 24 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY product DESC, lag) AS k FROM p WHERE lag >= 6)
SELECT l_suppkey, lag FROM t WHERE k = 1 AND product > 0"""))
def autocorr_pitch(spark, sf):
    s = v.items(spark, sf)
    mean = s.df.groupBy("l_suppkey").agg(F.avg("y").alias("m"))
    s = s.with_df(s.df.join(mean, "l_suppkey").withColumn("v", F.col("y") - F.col("m")))
    return registration.best_lag(registration.lag_products(s, "v", 24), ["l_suppkey"], 6, 24)


@query(q(L, """
, kn AS (SELECT l_suppkey, year(l_shipdate) AS yr, min(x) AS kx, min(sample_idx) * 4.0 AS ky FROM l GROUP BY 1, 2),
k2 AS (SELECT *, (lead(ky) OVER w - ky) / (lead(kx) OVER w - kx) AS sa, (ky - lag(ky) OVER w) / (kx - lag(kx) OVER w) AS sb FROM kn WINDOW w AS (PARTITION BY l_suppkey ORDER BY yr))
SELECT l.l_suppkey, l.sample_idx, round(ky + coalesce(sa, sb, 1.0) * (x - kx), 4) + 0.0 AS warped FROM l JOIN k2 ON k2.l_suppkey = l.l_suppkey AND k2.yr = year(l.l_shipdate)"""))
def warp(spark, sf):
    s = v.items(spark, sf)
    knots = s.df.groupBy("l_suppkey", F.year("l_shipdate").alias("yr")).agg(F.min("x").alias("kx"), (F.min("sample_idx") * 4.0).alias("ky"))
    got = registration.warp(s, "x", knots, "kx", "ky", "warped")
    return got.df.select("l_suppkey", "sample_idx", rnd("warped", 4).alias("warped"))


@query(q(R, f"""
, m AS (SELECT survey_id, sample_idx, chainage_m, event_type = 'purchase' AS mark FROM r),
z AS (SELECT *, max(CASE WHEN mark THEN chainage_m END) OVER (PARTITION BY survey_id ORDER BY sample_idx) AS lo,
      min(CASE WHEN mark THEN chainage_m END) OVER (PARTITION BY survey_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM m)
SELECT survey_id, sample_idx, {r6('least(chainage_m - lo, hi - chainage_m)')} AS distance FROM z"""))
def nearest_mark_distance(spark, sf):
    s = v.readings(spark, sf)
    return nearest_distance(s, "chainage_m", F.col("event_type") == "purchase").select("survey_id", "sample_idx", rnd("distance").alias("distance"))


def _walks(spark, sf) -> Series:
    """Items as walks: one second per row along a bearing, a fix unless the item was returned."""
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("survey_id"), *v.ITEM_ORDER, "l_quantity", "l_discount", (F.col("l_returnflag") != "R").alias("fix")
    )
    # by survey from the start, so that the steps on whole surveys needn't deal the rows out again
    s = order_rows(rows, ["survey_id"], v.ITEM_ORDER)
    cfg = registration.RegistrationConfig()
    along = F.col("sample_idx") * F.lit(cfg.speed) + (F.col("l_discount") - 0.05) * 4
    brg = F.radians(F.lit(cfg.bearing_deg))
    y = F.col("l_extendedprice") / 1000.0
    df = s.df.select(
        "survey_id", F.col("survey_id").alias("line_id"), F.lit(0).cast("long").alias("run_id"), "sample_idx",
        F.col("sample_idx").cast("double").alias("t_s"), F.when(F.col("fix"), cfg.lat0 + along * F.cos(brg) / 111320.0).alias("lat"),
        F.when(F.col("fix"), cfg.lon0 + along * F.sin(brg) / (111320.0 * F.cos(F.radians(F.lit(cfg.lat0))))).alias("lon"),
        (y + 45000).alias("b_lo_nt"), (y * 1.1 + 45000 + F.col("l_quantity") * 0.2).alias("b_mid_nt"), (y * 1.2 + 45000).alias("b_hi_nt"),
    )
    return indexed(df, ["survey_id"], "sample_idx", s.longest)


def _of_walks(spark, sf, columns: list[str], made: Callable[[Series], DataFrame]) -> DataFrame:
    """What ``made`` gives for the walks that fit in a chunk and for the longer ones."""
    walks = _walks(spark, sf)
    return reduce(DataFrame.unionByName, [made(part) for part in by_length(walks.with_df(walks.df.select("survey_id", "sample_idx", *columns)))])


@query()
def dead_reckoning(spark, sf):
    placed = lambda walks: registration.dead_reckon(walks).df
    return _of_walks(spark, sf, ["t_s", "lat", "lon"], placed).select("survey_id", "sample_idx", rnd("dr_m", 4).alias("dr_m"))


@query()
def survey_registration(spark, sf):
    rows = _of_walks(spark, sf, ["t_s", "lat", "lon", "b_mid_nt"], registration.registered)
    return rows.select("survey_id", "sample_idx", "chainage_m", "dist_to_weld_m", "n_welds_detected", "note")


@query()
def feature_frame(spark, sf):
    def frame(walks: Series) -> DataFrame:
        placed = registration.dead_reckon(walks).df.withColumnRenamed("dr_m", "chainage_m").withColumn("dist_to_weld_m", F.pmod("chainage_m", F.lit(12.0)))
        series = walks.with_df(placed if walks.one_chunk else cut(placed))
        return features.feature_frame(series, grouped=walks.one_chunk)

    return _of_walks(spark, sf, ["line_id", "run_id", "t_s", "lat", "lon", "b_lo_nt", "b_mid_nt", "b_hi_nt"], frame)


def _local_excess(rows, ctx):
    """A user's transform: the reading above its neighbourhood of three rows at both sides, a km of the survey's extent."""
    around = rows["value"].rolling(7, center=True, min_periods=1).mean()
    out = rows[["sample_idx"]].copy()
    out["excess"] = (rows["value"] - around) / (1.0 + (ctx["end_m"] - ctx["start_m"]) / 1000.0)
    out["from_start_m"] = rows["chainage_m"] - ctx["start_m"]
    return out


@query(q(R, f"""
, e AS (SELECT survey_id, min(chainage_m) AS a, max(chainage_m) AS b FROM r GROUP BY 1),
z AS (SELECT survey_id, sample_idx, value - avg(value) OVER (PARTITION BY survey_id ORDER BY sample_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS d, chainage_m FROM r)
SELECT survey_id, sample_idx, {r6('d / (1.0 + (b - a) / 1000.0)')} AS excess, {r6('chainage_m - a')} AS from_start_m FROM z JOIN e USING (survey_id)"""))
def user_transform(spark, sf):
    s = v.readings(spark, sf)
    sized = replace(s, df=s.df.select("survey_id", "sample_idx", "value", "chainage_m"))
    extent = s.df.groupBy("survey_id").agg(F.min("chainage_m").alias("start_m"), F.max("chainage_m").alias("end_m"))
    got = plugins.user_transform(sized, _local_excess, "sample_idx long, excess double, from_start_m double", extent, reach=(3, 3))
    return got.select("survey_id", "sample_idx", rnd("excess").alias("excess"), rnd("from_start_m").alias("from_start_m"))


def _trend(rows, ctx):
    """A user's transform of whole surveys: one row with the least-squares line of the readings."""
    x, y = rows["chainage_m"].to_numpy(), rows["value"].to_numpy()
    spread = ((x - x.mean()) ** 2).sum()
    slope = ((x - x.mean()) * (y - y.mean())).sum() / spread if spread > 0 else None
    return pd.DataFrame({"n": [len(rows)], "slope": pd.Series([slope], dtype="float64"), "total": [y.sum()]})


@query(q(R, f"""SELECT survey_id, count(*) AS n, {r6('regr_slope(value, chainage_m)')} AS slope, {r6('sum(value)', 4)} AS total FROM r GROUP BY 1"""))
def user_transform_whole(spark, sf):
    s = v.readings(spark, sf)
    got = plugins.user_transform(replace(s, df=s.df.select("survey_id", "sample_idx", "value", "chainage_m")), _trend, "n long, slope double, total double")
    return got.select("survey_id", "n", rnd("slope").alias("slope"), rnd("total", 4).alias("total"))
