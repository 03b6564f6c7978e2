"""Background removal: robust polynomial over all surveys at once, then a rolling-median high-pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from ..session import cut
from .ordered import Series, map_groups
from .quantiles import median_mad
from .series import mean_step, odd_window, rolling_medians, smooth_polynomial

EPS = float(np.finfo(np.float64).eps)
SINGLE_FIT_ROWS = 1_000_000
MAD_SIGMA = 1.4826


def scaled_axis(df: DataFrame, keys: Sequence[str], axis: str) -> DataFrame:
    """Adds ``__x``, the axis mapped to [-1, 1] per key (0 on a point)."""
    ends = df.groupBy(*keys).agg(F.min(axis).alias("__lo"), (F.max(axis) - F.min(axis)).alias("__span"))
    x = F.coalesce(2.0 * safe_div(F.col(axis) - F.col("__lo"), F.col("__span")) - 1.0, F.lit(0.0))
    return df.join(ends, list(keys)).withColumn("__x", x).drop("__lo", "__span")


def polynomial(coef: Column, x: Column) -> Column:
    """Value of a polynomial whose coefficients come lowest power first."""
    return F.aggregate(F.reverse(coef), F.lit(0.0), lambda acc, c: acc * x + c)


def _moments(rows: DataFrame, keys: Sequence[str], degree: int, w: Column) -> DataFrame:
    x, y = F.col("__x"), F.col("__y")
    power = lambda k: F.pow(x, F.lit(float(k)))
    return rows.withColumn("__w", w).groupBy(*keys).agg(
        F.array(*[F.sum(F.col("__w") * power(k)) for k in range(2 * degree + 1)]).alias("sx"),
        F.array(*[F.sum(F.col("__w") * power(k) * y) for k in range(degree + 1)]).alias("sxy"),
        F.max(F.abs(y)).alias("ymax"),
    )


def _solve(moments: DataFrame, keys: Sequence[str], degree: int) -> DataFrame:
    """Least squares from the power sums, one small system per row."""

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            coefs = []
            for sx, sxy in zip(pdf["sx"], pdf["sxy"]):
                a = np.array([[sx[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
                coefs.append(np.linalg.lstsq(a, np.asarray(sxy, dtype=float), rcond=None)[0].tolist())
            pdf["coef"] = coefs
            yield pdf[[*keys, "coef", "wsum", "ymax"]]

    small = moments.withColumn("wsum", F.col("sx")[0])
    types = {f.name: f.dataType.simpleString() for f in small.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", coef array<double>, wsum double, ymax double"
    return small.mapInPandas(solve, schema)


def robust_polynomial(
    df: DataFrame, keys: Sequence[str], axis: str, y: str, degree: int = 3, rounds: int = 4, tukey: float = 4.685, longest: int | None = None
) -> DataFrame:
    """Coefficients per key of a polynomial fitted with Tukey biweights.

    Rows without a position or value take no part, and a key without any other
    rows has no coefficients. A key keeps its fit once the residuals vanish or too few rows keep weight.
    Keys known to be small (``longest``) are fitted one per task group. Otherwise
    each round is one aggregate of power sums over all keys, so a survey of any
    size is summed map-side, and the few coefficients are cut from the plan.
    """
    keys = list(keys)
    known = df.select(*keys, axis, F.col(y).cast("double").alias("__y"))
    for c in (axis, "__y"):
        known = known.filter(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    if longest is not None and longest <= SINGLE_FIT_ROWS:
        return _fit_small(known, keys, axis, degree, rounds, tukey)
    rows = scaled_axis(known, keys, axis).drop(axis)
    fit = cut(_solve(_moments(rows, keys, degree, F.lit(1.0)), keys, degree))
    for _ in range(rounds):
        resid = rows.join(fit.drop("wsum"), keys).withColumn("__r", F.col("__y") - polynomial(F.col("coef"), F.col("__x")))
        stats = median_mad(resid, keys, "__r", longest).select(*keys, (F.lit(MAD_SIGMA) * F.col("mad")).alias("__scale"))
        live = resid.join(stats, keys).filter(F.col("__scale") > EPS * F.greatest(F.lit(1.0), F.col("ymax")))
        u = F.col("__r") / (tukey * F.col("__scale"))
        w = F.when(F.abs(u) < 1, F.pow(1 - u * u, F.lit(2.0))).otherwise(0.0)
        new = cut(_solve(_moments(live, keys, degree, w).filter(F.col("sx")[0] > degree + 1), keys, degree))
        renamed = new.select(*keys, F.col("coef").alias("__new"))
        fit = cut(fit.join(renamed, keys, "left").select(*keys, F.coalesce("__new", "coef").alias("coef"), "wsum", "ymax"))
        if new.isEmpty():
            break
    return fit.select(*keys, "coef")


def fit_polynomial(pos: np.ndarray, y: np.ndarray, degree: int = 3, rounds: int = 4, tukey: float = 4.685) -> list[float]:
    """The fit of ``robust_polynomial`` to the known rows of one key, over their positions mapped to [-1, 1]."""
    span = pos.max() - pos.min()
    powers = np.vander(2 * (pos - pos.min()) / span - 1 if span > 0 else np.zeros(len(pos)), degree + 1, increasing=True)
    weighted = lambda w: np.linalg.lstsq((powers * w[:, None]).T @ powers, powers.T @ (w * y), rcond=None)[0]
    coef = weighted(np.ones(len(y)))
    for _ in range(rounds):
        left = y - powers @ coef
        sigma = MAD_SIGMA * np.median(np.abs(left - np.median(left)))
        if sigma <= EPS * max(1.0, np.abs(y).max()):
            break
        w = np.clip(1 - (left / (tukey * sigma)) ** 2, 0, None) ** 2
        if w.sum() <= degree + 1:
            break
        coef = weighted(w)
    return coef.tolist()


def _fit_small(rows: DataFrame, keys: list[str], axis: str, degree: int, rounds: int, tukey: float) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", coef array<double>"

    def groups(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        pos, y = pdf[axis].to_numpy(dtype=float), pdf["__y"].to_numpy(dtype=float)
        out = pdf.loc[starts, keys]
        out["coef"] = [fit_polynomial(pos[a:b], y[a:b], degree, rounds, tukey) for a, b in zip(starts, [*starts[1:], len(pdf)])]
        return out

    return cut(map_groups(rows, keys, axis, groups, schema))


def remove_polynomial(df: DataFrame, keys: Sequence[str], axis: str, y: str, coefs: DataFrame, out: str) -> DataFrame:
    rows = scaled_axis(df, keys, axis).join(coefs, list(keys))
    return rows.withColumn(out, F.col(y) - polynomial(F.col("coef"), F.col("__x"))).drop("__x", "coef")


def detrend(
    series: Series, axis: str, columns: dict[str, str], window_m: float = 40.0, degree: int = 3, method: str = "robust_poly", savgol_rows: int | None = None
) -> Series:
    """Residual of each column: polynomial background off, then the rolling median off.

    ``columns`` maps input to output names. ``method='savgol'`` smooths with a
    local polynomial of ``savgol_rows`` rows instead of both steps.
    """
    keys = list(series.keys)
    if method == "savgol":
        out = series
        for src, dst in columns.items():
            out = smooth_polynomial(out, src, savgol_rows, degree, "__s")
            out = out.with_df(out.df.withColumn(dst, F.col(src) - F.col("__s")).drop("__s"))
        return out
    base = series.df.columns
    df = scaled_axis(series.df, keys, axis)
    long = series.df.select(*keys, axis, F.explode(F.array(*[
        F.struct(F.lit(dst).alias("__head"), F.col(src).alias("__v")) for src, dst in columns.items()
    ])).alias("h")).select(*keys, axis, "h.__head", "h.__v")
    coefs = robust_polynomial(long, [*keys, "__head"], axis, "__v", degree, longest=series.longest)
    wide = coefs.groupBy(*keys).agg(*[F.max(F.when(F.col("__head") == dst, F.col("coef"))).alias(f"__c_{dst}") for dst in columns.values()])
    df = df.join(wide, keys).select(
        *base, *[(F.col(src) - polynomial(F.col(f"__c_{dst}"), F.col("__x"))).alias(dst) for src, dst in columns.items()]
    )
    if window_m <= 0:
        return series.with_df(df)
    step = mean_step(series.df, keys, axis).select(*keys, odd_window(window_m, F.col("mean_step")).alias("__win"))
    reach = int(step.agg(F.max("__win")).first()[0] or 1)
    out = series.with_df(cut(df.join(step, keys)))
    middles = {dst: f"__m_{dst}" for dst in columns.values()}
    out = rolling_medians(out, middles, "__win", reach)
    return out.with_df(out.df.select(*[(F.col(c) - F.col(middles[c])).alias(c) if c in middles else c for c in out.df.columns if c != "__win" and c not in middles.values()]))
