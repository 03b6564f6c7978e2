"""The 45-column feature frame of every row of every survey."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as s
from ..session import cut
from . import short
from .baseline import detrend
from .guards import assert_no_forbidden, flag_edges
from .ordered import Series, by_position, map_short
from .quality import HEADS, READING_SCHEMA
from .series import (
    ROLLING, assign_to_peaks, decay_exponents, gradient, mean_step, odd_window, peak_shapes, rolling_stats,
)

# fixed values: the pinned feature columns in their order, their unit and the operator that makes them; in a window's
# columns the name starts with the window's own
PINNED = """
r_lo_nt                     nT      detrend
r_mid_nt                    nT      detrend
r_hi_nt                     nT      detrend
dr_ds_nt_per_m              nT/m    gradient
d2r_ds2_nt_per_m2           nT/m2   gradient
g1_nt_per_m                 nT/m    first_difference
g2_nt_per_m2                nT/m2   second_difference
standoff_est_m              m       standoff_m
<window>_mean_nt            nT      rolling_stats.mean
<window>_std_nt             nT      rolling_stats.std
<window>_max_nt             nT      rolling_stats.max
<window>_ptp_nt             nT      rolling_stats.ptp
<window>_kurt               1       rolling_stats.kurt
<window>_zcr                1       rolling_stats.zcr
<window>_energy_nt2         nT2     rolling_stats.energy
fwhm_m                      m       peak_shapes
peak_asymmetry              1       peak_shapes
decay_exponent              1       decay_exponents
peak_prominence_nt          nT      peak_shapes
peak_distance_m             m       assign_to_peaks
r_mag_norm_nt_m3            nT.m3   cube
peak_prominence_norm_nt_m3  nT.m3   cube
dist_to_weld_m              m       register
gps_locked                  1       locked
"""
WINDOW = "<window>"
# what a survey observes; the other columns of a reading hold the truth and must never be features
OBSERVED_COLUMNS = ("line_id", "run_id", "sample_idx", "t_s", "lat", "lon", *HEADS)
TRUTH_COLUMNS = tuple(c for c in (*READING_SCHEMA.fieldNames(), "chainage_provisional_m") if c not in OBSERVED_COLUMNS)
# statistic of a window -> the rest of its column's name
STAT_SUFFIX = {made.split(".")[1]: name.removeprefix(f"{WINDOW}_") for name, _, made in map(str.split, PINNED.strip().splitlines()) if made.startswith("rolling_stats.")}
TIE_BREAK_M = 5e-9


@dataclass(frozen=True)
class FeatureConfig:
    version: int = 3
    windows_m: tuple[float, ...] = (2.0, 5.0, 10.0, 25.0)
    detrend_window_m: float = 40.0
    detrend_degree: int = 3
    peak_sigmas: float = 4.0
    peak_radius: float = 2.0
    flank_span: tuple[float, float] = (0.5, 3.0)
    head_spacing_m: float = 0.5
    nominal_standoff_m: float = 2.0
    edge_policy: str = "flag"


def window_prefixes(cfg: FeatureConfig) -> list[str]:
    """One name per window: its width in metres, with p for the decimal point."""
    text = [format(w, "g") for w in cfg.windows_m]
    return ["w" + t.replace(".", "p") + "m" for t in text]


def pinned_columns(cfg: FeatureConfig = FeatureConfig()) -> list[str]:
    """The table's names in order, its block of window rows once for each window."""
    names = [row.split()[0] for row in PINNED.strip().splitlines()]
    block = [n for n in names if n.startswith(WINDOW)]
    at = names.index(block[0])
    out = names[:at]
    for prefix in window_prefixes(cfg):
        out += [n.replace(WINDOW, prefix) for n in block]
    out += names[at + len(block) :]
    assert_no_forbidden(out, TRUTH_COLUMNS)
    return out


def feature_frame(series: Series, cfg: FeatureConfig = FeatureConfig(), chainage: str = "chainage_m", label: str | None = None, grouped: bool = False) -> DataFrame:
    """Features of every row.

    The input needs the keys, survey_id, line_id, run_id, the position, the
    registered chainage, dist_to_weld_m, lat, lon and the three heads. Windows and
    peaks count rows. With ``label`` the rows come out under that column in place of
    the position. Stages that are read several times are cut from the plan.

    Surveys that fit in a chunk are worked on whole and nothing is written; ``grouped``
    as in ``map_short``.
    """
    if series.one_chunk:
        return _of_short(series, cfg, chainage, label, grouped)
    if not series.dense:
        return feature_frame(by_position(series, "__label"), cfg, chainage, "__label")
    keys, idx = list(series.keys), series.idx
    rows = series.df
    heads = {"b_lo_nt": "r_lo_nt", "b_mid_nt": "r_mid_nt", "b_hi_nt": "r_hi_nt"}
    flat = detrend(series, chainage, heads, cfg.detrend_window_m, cfg.detrend_degree)
    df = _across_heads(flat.df, cfg)

    # equal neighbouring positions would divide by zero; the nudge is far below the position's accuracy
    work = flat.with_df(df.withColumn("__s", F.col(chainage) + F.col(idx) * F.lit(TIE_BREAK_M)))
    work = gradient(work, "r_mid_nt", "__s", "dr_ds_nt_per_m")
    work = gradient(work, "dr_ds_nt_per_m", "__s", "d2r_ds2_nt_per_m2")

    step = mean_step(rows, keys, chainage)
    wins = {p: f"__w{i}" for i, p in enumerate(window_prefixes(cfg))}
    sized = step.select(
        *keys, "mean_step", *[odd_window(w, F.col("mean_step")).alias(f"__w{i}") for i, w in enumerate(cfg.windows_m)],
        odd_window(cfg.detrend_window_m, F.col("mean_step")).alias("__wd"),
    )
    sized = cut(sized)
    widest = F.greatest(*[F.col(c) for c in wins.values()], F.col("__wd"))
    reach = int(sized.agg(F.max(widest)).first()[0] or 1)
    work = work.with_df(cut(work.df.drop("__s").join(sized, keys)))
    peaks_on = work.with_df(work.df.withColumn("__abs", F.abs("r_mid_nt")))
    peaks = peak_shapes(peaks_on, "__abs", cfg.peak_sigmas)
    peaks = decay_exponents(peaks_on, "__abs", peaks, cfg.flank_span, "mean_step")
    peaks = cut(peaks.join(step.select(*keys, "mean_step"), keys).select(
        *keys, idx, "width", (F.col("width") * F.col("mean_step")).alias("fwhm_m"), F.col("asymmetry").alias("peak_asymmetry"),
        "decay_exponent", F.col("prominence").alias("peak_prominence_nt"),
    ))
    shaped = assign_to_peaks(work, peaks, ["fwhm_m", "peak_asymmetry", "decay_exponent", "peak_prominence_nt"], cfg.peak_radius, "__dist")
    rolled = rolling_stats(shaped, "r_mid_nt", wins, reach)

    out = rolled.df.withColumn("peak_distance_m", F.col("__dist") * F.col("mean_step"))
    out = out.withColumn("__half", F.floor(widest / 2).cast("long"))
    flagged = flag_edges(work.with_df(out), F.col("__half"), drop=cfg.edge_policy == "drop")
    return _pinned(flagged, cfg, idx, chainage, label)


def _across_heads(df: DataFrame, cfg: FeatureConfig) -> DataFrame:
    lo, mid, hi = F.col("r_lo_nt"), F.col("r_mid_nt"), F.col("r_hi_nt")
    return df.withColumn("g1_nt_per_m", s.first_difference(lo, hi, cfg.head_spacing_m)).withColumn(
        "g2_nt_per_m2", s.second_difference(lo, mid, hi, cfg.head_spacing_m)
    ).withColumn("standoff_est_m", s.standoff_m(mid, F.col("g2_nt_per_m2"), cfg.nominal_standoff_m))


def _pinned(df: DataFrame, cfg: FeatureConfig, idx: str, chainage: str, label: str | None) -> DataFrame:
    """The frame's columns, with the features that a row's others give."""
    cube = F.pow(F.col("standoff_est_m"), F.lit(3.0))
    out = df.withColumn("r_mag_norm_nt_m3", F.col("r_mid_nt") * cube).withColumn(
        "peak_prominence_norm_nt_m3", F.col("peak_prominence_nt") * cube
    ).withColumn("gps_locked", s.locked(F.col("lat"), F.col("lon")))
    out = out.select("*", *[
        F.col(f"{p}_{stat}").alias(f"{p}_{suffix}") for p in window_prefixes(cfg) for stat, suffix in STAT_SUFFIX.items() if stat != suffix
    ])
    key_cols = ["survey_id", "line_id", "run_id", F.col(label or idx).alias(idx), chainage]
    return out.select(
        *key_cols, F.lit(cfg.version).cast("long").alias("feature_version"), "dq_flag",
        *[F.col(c).cast("float").alias(c) for c in pinned_columns(cfg)],
    )


def _of_short(series: Series, cfg: FeatureConfig, chainage: str, label: str | None, grouped: bool) -> DataFrame:
    prefixes, heads = window_prefixes(cfg), {"r_lo_nt": "b_lo_nt", "r_mid_nt": "b_mid_nt", "r_hi_nt": "b_hi_nt"}
    made = [*heads, *short.PEAK_COLUMNS, *[f"{p}_{stat}" for p in prefixes for stat in ROLLING]]

    def call(c: dict, starts) -> dict:
        return short.features(c[chainage], {r: c[b] for r, b in heads.items()}, starts, prefixes, cfg, TIE_BREAK_M)

    cols = [c for c in series.df.columns if c in {*series.keys, "survey_id", "line_id", "run_id", series.idx, label, chainage, "dist_to_weld_m", "lat", "lon", *heads.values()}]
    fields = [*[T.StructField(c, T.DoubleType()) for c in made], T.StructField("edge", T.BooleanType())]
    df = map_short(series.with_df(series.df.select(*cols)), [chainage, *heads.values()], call, fields, grouped)
    df = df.withColumn("dq_flag", F.when(F.col("edge"), "edge").otherwise("clean"))
    if cfg.edge_policy == "drop":
        df = df.filter("dq_flag = 'clean'")
    return _pinned(_across_heads(df, cfg), cfg, series.idx, chainage, label)
