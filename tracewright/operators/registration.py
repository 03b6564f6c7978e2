"""Position along the line: dead reckoning between fixes, weld-comb detection, warp onto the lattice."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import along_bearing_m, safe_div
from ..session import cut
from . import short
from .islands import bridged_gaps
from .matching import nearest
from .ordered import Series, after, before, following, highest, indexed, latest, map_short, order_rows, position, total
from .quantiles import median_mad, quantiles
from .series import gradient, interpolate, resample, rolling_median

# fixed values
GPS_SMOOTH_M = 2.0
GRID_M = 0.10


@dataclass(frozen=True)
class RegistrationConfig:
    lat0: float = 46.958
    lon0: float = 8.365
    bearing_deg: float = 35.0
    speed: float = 1.2
    speed_min: float = 0.6
    speed_max: float = 1.8
    pitch_m: float = 12.0


def dead_reckon(series: Series, cfg: RegistrationConfig = RegistrationConfig(), time: str = "t_s") -> Series:
    """Adds ``dr_m``: fixes where locked, the local walking rate in between, never going back.

    Without a fix the nominal pace is integrated; with one it is shifted onto the fix.
    """
    keys, idx, cols = list(series.keys), series.idx, series.df.columns
    gps = along_bearing_m(F.col("lat"), F.col("lon"), cfg.lat0, cfg.lon0, cfg.bearing_deg)
    rows = series.with_df(series.df.withColumn("__gps", gps))
    if series.one_chunk:
        def reckon(c: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
            return {"dr_m": short.dead_reckoned(c[time], c["__gps"], starts, cfg, GPS_SMOOTH_M)}

        return series.with_df(map_short(rows, [time, "__gps"], reckon, [T.StructField("dr_m", T.DoubleType())]).drop("__gps"))
    is_fix = F.col("__gps").isNotNull()

    dt = rows.running(__t0=before(F.col(time)))
    med = quantiles(dt.df, keys, F.col(time) - F.col("__t0"), {"dt": 0.5}, series.longest).drop("n")
    counts = rows.df.groupBy(*keys).agg(F.count("__gps").alias("__fixes"), F.min(time).alias("__tstart"))
    per_key = counts.join(med, keys, "left")
    n = F.greatest(F.lit(1), F.bround(F.lit(GPS_SMOOTH_M) / F.greatest(F.lit(cfg.speed) * F.coalesce("dt", F.lit(1.0)), F.lit(1e-6))).cast("long"))
    n = F.when(n % 2 == 0, n + 1).otherwise(n)
    cap = F.when(F.col("__fixes") % 2 == 1, F.col("__fixes")).otherwise(F.col("__fixes") - 1)
    per_key = cut(per_key.withColumn("__win", F.greatest(F.lit(1), F.least(n, cap)).cast("int")))

    # the fixes alone, numbered densely so that windows count fixes
    fixes = indexed(rows.df.filter(is_fix).select(*keys, idx, time, "__gps"), keys, idx, series.longest, series.chunk_rows)
    fixes = fixes.running(__f=position())
    fixes = indexed(fixes.df.join(per_key.select(*keys, "__win"), keys), keys, "__f", series.longest, series.chunk_rows)
    reach = int(per_key.agg(F.max("__win")).first()[0] or 1)
    smooth = rolling_median(fixes, "__gps", "__win", reach, "__sg", repeat_ends=True)
    speed = gradient(smooth, "__sg", time, "__v")
    v = F.greatest(F.lit(cfg.speed_min), F.least(F.lit(cfg.speed_max), F.col("__v")))
    marks = cut(speed.df.select(*keys, idx, F.col("__sg"), v.alias("__vfix")))

    full = rows.df.join(marks, [*keys, idx], "left").join(per_key.select(*keys, "__fixes", "__tstart"), keys)
    work = interpolate(rows.with_df(full), time, {"__vall": F.col("__vfix")})
    pace = F.when(F.col("__fixes") >= 2, F.col("__vall")).otherwise(F.lit(cfg.speed))
    work = work.with_df(work.df.withColumn("__pace", pace)).running(__t0=before(F.col(time)), __p0=before(F.col("__pace")))
    step = F.coalesce((F.col("__pace") + F.col("__p0")) / 2 * (F.col(time) - F.col("__t0")), F.lit(0.0))
    work = work.with_df(work.df.withColumn("__step", step)).running(__raw=total(F.col("__step")))
    fixed = F.when(F.col("__sg").isNotNull(), F.col("__sg") - F.col("__raw"))
    work = interpolate(work, time, {"__corr": fixed})
    raw = F.col("__raw") + F.coalesce("__corr", F.lit(0.0))
    done = work.with_df(cut(work.df.select(*cols, raw.alias("__dr")))).running(dr_m=highest(F.col("__dr")))
    return done.with_df(done.df.drop("__dr"))


def fix_quality(series: Series, axis: str = "dr_m") -> DataFrame:
    """Locked share and the longest distance bridged without a fix, per key."""
    keys = list(series.keys)
    fix = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    share = series.df.groupBy(*keys).agg(F.avg(fix.cast("double")).alias("gps_locked_fraction"))
    gap = bridged_gaps(series, fix, axis).groupBy(*keys).agg(F.max("bridged").alias("max_interpolated_gap_m"))
    return share.join(gap, keys, "left").fillna(0.0, ["max_interpolated_gap_m"])


def lag_products(series: Series, y: str, max_lag: int) -> DataFrame:
    """Sum of ``y[i]*y[i+lag]`` per key for lags 1..``max_lag``.

    Each chunk sees the rows that follow it and multiplies shifted arrays; only
    one sum per lag and chunk is shuffled.
    """
    keys, idx = list(series.keys), series.idx
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.df.select(*keys).schema.fields)

    def one_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        v, core = pdf[y].to_numpy(dtype=float), pdf["__core"].to_numpy()
        m = min(max_lag, len(v) - 1)
        own = np.where(core, v, 0.0)
        out = pd.DataFrame({"lag": np.arange(1, m + 1, dtype="int64"), "product": [float(own[:-k] @ v[k:]) for k in range(1, m + 1)]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "lag", "product"]]

    tagged = series.with_df(series.df.select(*keys, idx, y)).halo(0, max_lag)
    parts = tagged.groupBy(*series.chunk_keys()).applyInPandas(one_chunk, f"{fields}, lag long, product double")
    return parts.groupBy(*keys, "lag").agg(F.sum("product").alias("product"))


def envelope(grid: Series, y: str, window_rows: int, out: str = "env") -> Series:
    """|y - rolling median| around its mean, in place of ``y``."""
    keys = list(grid.keys)
    n = grid.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    w = F.greatest(F.lit(3), F.least(F.lit(window_rows), F.col("__n") - 1)).cast("int")
    sized = grid.with_df(grid.df.join(n, keys).withColumn("__win", F.when(w % 2 == 0, w + 1).otherwise(w)))
    smooth = rolling_median(sized, y, "__win", window_rows + 1, "__m", repeat_ends=True)
    raw = smooth.df.withColumn(out, F.abs(F.col(y) - F.col("__m"))).drop(y, "__m", "__win", "__n")
    raw = cut(raw)
    mean = raw.groupBy(*keys).agg(F.avg(out).alias("__mean"))
    return grid.with_df(raw.join(mean, keys).withColumn(out, F.col(out) - F.col("__mean")).drop("__mean"))


def best_lag(products: DataFrame, keys: Sequence[str], lo: int, hi: int) -> DataFrame:
    """The lag in [lo, hi] with the largest product (the smallest lag of equals), if it is positive."""
    inside = products.filter(F.col("lag").between(lo, hi))
    got = inside.groupBy(*keys).agg(F.max_by(F.struct("lag", "product"), F.struct("product", -F.col("lag"))).alias("p"))
    return got.filter("p.product > 0").select(*keys, F.col("p.lag").alias("lag"))


def comb_teeth(grid: Series, env: str, lags: DataFrame, margin_rows: float) -> DataFrame:
    """One detected position per period: the phase with the largest sum, then the maximum near each tooth.

    On a uniform grid the rows of one phase are those with equal remainder by the
    lag, so the phase search is a single aggregate.
    """
    keys = list(grid.keys)
    rows = grid.df.join(lags, keys)
    ends = grid.df.groupBy(*keys).agg(F.max("grid_i").alias("__last"), F.stddev_pop(env).alias("__sd"))
    score = rows.groupBy(*keys, "lag", F.pmod("grid_i", "lag").alias("phase")).agg(F.sum(env).alias("s"))
    phase = score.groupBy(*keys).agg(F.max_by("phase", F.struct("s", -F.col("phase"))).alias("phase"))
    near = rows.join(phase, keys).join(ends.filter("__sd >= 1e-9"), keys)
    half = F.col("lag") / 4.0
    k = F.round((F.col("grid_i") - F.col("phase")) / F.col("lag")).cast("long")
    centre = F.col("phase") + F.col("k") * F.col("lag")
    near = near.withColumn("k", k).filter(
        (F.col("k") >= 0) & (F.col("grid_i") >= centre - half) & (F.col("grid_i") < centre + half)
        & (centre - half >= 0) & (centre + half <= F.col("__last"))
        & (centre >= margin_rows) & (F.col("__last") - centre >= margin_rows)
    )
    return near.groupBy(*keys, "k").agg(F.max_by("grid_x", F.struct(F.col(env), -F.col("grid_i"))).alias("detected_m"))


def fit_lattice(teeth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Straight-line fit of detected positions on the tooth number, refitted once without outliers.

    Gives the kept teeth with their lattice position and the pitch; fewer than two teeth give nothing.
    """
    keys = list(keys)

    def fit(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.regr_slope("detected_m", "k").alias("pitch"), F.regr_intercept("detected_m", "k").alias("phase_m"), F.count(F.lit(1)).alias("n_teeth")
        ).filter("n_teeth >= 2")

    first = cut(teeth.join(fit(teeth), keys).withColumn("e", F.col("detected_m") - (F.col("phase_m") + F.col("k") * F.col("pitch"))))
    mad = median_mad(first, keys, "e").select(*keys, (F.col("mad") * 1.4826 + 1e-9).alias("__mad"))
    kept = first.join(mad, keys).filter(F.abs("e") < F.greatest(3.0 * F.col("__mad"), F.lit(0.5)))
    enough = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("__k")).filter("__k >= 2")
    # keys whose outlier cut would leave fewer than two teeth keep all of them
    good = kept.join(enough, keys, "left_semi").select(*teeth.columns).unionByName(
        first.join(enough, keys, "left_anti").select(*teeth.columns)
    )
    good = cut(good)
    return good.join(fit(good), keys).withColumn("lattice_m", F.col("phase_m") + F.col("k") * F.col("pitch"))


def warp(series: Series, x: str, knots: DataFrame, knot_x: str, knot_y: str, out: str) -> Series:
    """Piecewise-linear map through the knots of each key, continued beyond them by the end segments.

    Keys without knots keep their axis.
    """
    keys, idx, cols = list(series.keys), series.idx, series.df.columns
    order = order_rows(knots.select(*keys, F.col(knot_x).cast("double").alias("kx"), F.col(knot_y).cast("double").alias("ky")), keys, ["kx"], idx="__k")
    pt = F.struct("kx", "ky")
    segs = order.running(__p=before(pt), __n=after(pt)).df
    slope = lambda a, b: safe_div(b["ky"] - a["ky"], b["kx"] - a["kx"])
    here = F.struct("kx", "ky")
    segs = segs.select(*keys, "kx", "ky", slope(F.col("__p"), here).alias("before"), slope(here, F.col("__n")).alias("after"))
    both = series.df.withColumn("__x", F.col(x)).unionByName(
        segs.select(*keys, F.col("kx").alias("__x"), F.struct("kx", "ky", F.col("before"), F.col("after")).alias("__kn")), allowMissingColumns=True
    )
    merged = order_rows(both, keys, ["__x", F.col("__kn").isNull(), idx], idx="__m").running(__lo=latest(F.col("__kn")), __hi=following(F.col("__kn"))).df
    lo, hi, at = F.col("__lo"), F.col("__hi"), F.col("__x")
    value = (
        F.when(lo.isNull() & hi.isNull(), at)
        .when(lo.isNull(), hi["ky"] + F.coalesce(hi["after"], F.lit(1.0)) * (at - hi["kx"]))
        .otherwise(lo["ky"] + F.coalesce(lo["after"], lo["before"], F.lit(1.0)) * (at - lo["kx"]))
    )
    return series.with_df(merged.filter("__kn is null").select(*cols, value.alias(out)))


def register(series: Series, cfg: RegistrationConfig = RegistrationConfig(), signal: str = "b_mid_nt") -> tuple[DataFrame, DataFrame]:
    """Rows with ``chainage_m`` and ``dist_to_weld_m``, and one quality row per key.

    Keys without a usable comb keep the dead-reckoned axis and have no weld distance.
    """
    keys, idx, cols = list(series.keys), series.idx, series.df.columns
    dr = dead_reckon(series, cfg)
    dr = dr.with_df(cut(dr.df))
    span = dr.df.groupBy(*keys).agg((F.max("dr_m") - F.min("dr_m")).alias("__span"), F.count(F.lit(1)).alias("__n"))
    usable = span.filter((F.col("__span") >= 1.5 * cfg.pitch_m) & (F.col("__n") >= 20)).select(*keys)

    window, lo, hi = _comb_rows(cfg)
    points = resample(dr.with_df(dr.df.join(usable, keys, "left_semi")), "dr_m", signal, GRID_M)
    # points are several times the rows: made anew where they are read, and written once, with their envelope
    last = points.agg(F.max("grid_i")).first()[0]
    grid = Series(points, tuple(keys), "grid_i", int(last or 0) + 1, dr.chunk_rows, dense=True)
    env = envelope(grid, signal, window)
    lags = best_lag(lag_products(env, "env", hi), keys, lo, hi)
    lags = lags.join(span, keys).filter(F.floor(F.col("__span") / (F.col("lag") * GRID_M)) >= 2).select(*keys, "lag")
    welds = cut(fit_lattice(comb_teeth(env, "env", cut(lags), window / 2.0), keys))

    warped = warp(dr, "dr_m", welds, "detected_m", "lattice_m", "__w").running(chainage_m=highest(F.col("__w")))
    rows = cut(warped.df.select(*cols, "dr_m", "chainage_m"))
    near = nearest(rows, welds.select(*keys, "lattice_m", F.col("k").alias("weld_no")), keys, "chainage_m", "lattice_m", "weld_no")
    out = near.select(*cols, "dr_m", "chainage_m", F.when(F.col("weld_no").isNotNull(), F.col("distance_m")).alias("dist_to_weld_m"))

    found = welds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_welds_detected"), F.first("pitch").alias("pitch_estimate_m"))
    note = F.when(F.col("__span") < 1.5 * cfg.pitch_m, "survey shorter than the comb search").when(
        F.col("n_welds_detected").isNull(), "no reliable comb found").otherwise("ok")
    quality = fix_quality(dr).join(span, keys).join(found, keys, "left").select(
        *keys, F.coalesce("n_welds_detected", F.lit(0)).alias("n_welds_detected"), "pitch_estimate_m", "gps_locked_fraction", "max_interpolated_gap_m", note.alias("note")
    )
    return out, quality


def _comb_rows(cfg: RegistrationConfig) -> tuple[int, int, int]:
    """Grid points of the envelope's window, of the shortest and of the longest period."""
    window = round(max(5.0 * cfg.pitch_m, 10 * GRID_M) / GRID_M)
    return window, int(np.ceil(max(3 * GRID_M, 0.5 * cfg.pitch_m) / GRID_M - 1e-9)), int(np.floor(1.5 * cfg.pitch_m / GRID_M + 1e-9))


QUALITY = ("n_welds_detected long", "pitch_estimate_m double", "gps_locked_fraction double", "max_interpolated_gap_m double", "note string")


def registered(series: Series, cfg: RegistrationConfig = RegistrationConfig(), signal: str = "b_mid_nt") -> DataFrame:
    """What ``register`` gives, as one table: every row with its key's quality.

    Keys that fit in a chunk are dealt out once and worked on whole; neither their
    rows nor their grids are written.
    """
    keys, cols = list(series.keys), series.df.columns
    if not series.one_chunk:
        rows, quality = register(series, cfg, signal)
        return rows.join(quality, keys)
    window, lo, hi = _comb_rows(cfg)
    made = T.StructType.fromDDL(", ".join(("dr_m double", "chainage_m double", "dist_to_weld_m double", *QUALITY))).fields

    def place(c: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        dr = short.dead_reckoned(c["t_s"], c["__gps"], starts, cfg, GPS_SMOOTH_M)
        parts = []
        for a, b in short.bounds(starts, len(dr)):
            got = short.registered(dr[a:b], c[signal][a:b], c["__fix"][a:b] > 0, cfg, GRID_M, window, (lo, hi))
            parts.append({k: v if np.ndim(v) else np.full(b - a, v, dtype=object if k == "note" else None) for k, v in got.items()})
        return {"dr_m": dr, **{k: np.concatenate([p[k] for p in parts]) for k in parts[0]}}

    gps = along_bearing_m(F.col("lat"), F.col("lon"), cfg.lat0, cfg.lon0, cfg.bearing_deg)
    rows = series.df.withColumn("__gps", gps).withColumn("__fix", (F.col("lat").isNotNull() & F.col("lon").isNotNull()).cast("double"))
    out = map_short(series.with_df(rows), ["t_s", "__gps", "__fix", signal], place, made)
    return out.select(*cols, *[f.name for f in made])
