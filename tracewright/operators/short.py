"""Short series, each worked on whole: the arrays of a survey in, arrays of the same rows out.

The same steps as in ``registration`` and ``features``, for surveys that fit in a chunk. There every
step deals the rows out again or writes them; here rows are dealt out once, and the
0.1 m grid, which has some twelve points a row, exists for one survey at a time.
NaN stands for NULL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from .baseline import fit_polynomial
from .series import ROLLING, _walk, centred_medians, window_stats

#: Points of a survey's grid that are held at once.
GRID_POINTS = 1 << 20


def bounds(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """First row and end of every group."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n]))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a / b``, NaN where ``b`` is zero."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b == 0, np.nan, a / b)


def gradient(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """As ``series.gradient``."""
    end = np.array([np.nan])
    x0, x1, y0, y1 = (np.concatenate(p) for p in ((end, x[:-1]), (x[1:], end), (end, y[:-1]), (y[1:], end)))
    hs, hd = x - x0, x1 - x
    inside = ratio(hs * hs * y1 + (hd * hd - hs * hs) * y - hd * hd * y0, hs * hd * (hd + hs))
    return np.where(np.isnan(hs), ratio(y1 - y, hd), np.where(np.isnan(hd), ratio(y - y0, hs), inside))


def latest_known(known: np.ndarray) -> np.ndarray:
    """Row of the last known value at or before each row, -1 without any."""
    return np.maximum.accumulate(np.where(known, np.arange(len(known)), -1))


def next_known(known: np.ndarray) -> np.ndarray:
    """Row of the first known value at or after each row, the number of rows without any."""
    n = len(known)
    return np.minimum.accumulate(np.where(known, np.arange(n), n)[::-1])[::-1]


def between(at: np.ndarray, x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Linear between the rows ``lo`` and ``hi``, flat where there is but one of them."""
    has_lo, has_hi = lo >= 0, hi < len(x)
    a, b = np.maximum(lo, 0), np.minimum(hi, len(x) - 1)
    slope = np.nan_to_num(ratio(y[b] - y[a], x[b] - x[a]), nan=0.0)
    value = y[a] + slope * (at - x[a])
    return np.where(~has_lo, np.where(has_hi, y[b], np.nan), np.where(has_hi, value, y[a]))


def _interpolated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    known = ~np.isnan(y)
    return between(x, x, y, latest_known(known), next_known(known))


def dead_reckoned(t: np.ndarray, gps: np.ndarray, starts: np.ndarray, cfg, smooth_m: float) -> np.ndarray:
    """As ``registration.dead_reckon``, of all groups."""
    fix = np.flatnonzero(~np.isnan(gps))
    groups, windows, first = bounds(starts, len(t)), [], []
    for a, b in groups:
        dt = np.diff(t[a:b])
        dt = dt[~np.isnan(dt)]
        n = max(1, int(np.round(smooth_m / max(cfg.speed * (np.median(dt) if len(dt) else 1.0), 1e-6))))
        lo, hi = np.searchsorted(fix, (a, b))
        cap = hi - lo - ((hi - lo) % 2 == 0)
        if hi > lo:
            first.append(lo)
            windows.append(max(1, min(n + (n % 2 == 0), cap)))
    smooth = np.full(len(t), np.nan)
    if len(fix):
        smooth[fix] = centred_medians([gps[fix]], np.array(first), np.array(windows), repeat_ends=True)[0]

    out = np.empty(len(t))
    for a, b in groups:
        at, near = t[a:b], smooth[a:b]
        known = ~np.isnan(near)
        pace = np.full(b - a, cfg.speed)
        if known.sum() >= 2:
            v = gradient(near[known], at[known])
            # a speed that is not known takes the upper end
            vall = np.full(b - a, np.nan)
            vall[known] = np.where(np.isnan(v), cfg.speed_max, np.clip(v, cfg.speed_min, cfg.speed_max))
            pace = _interpolated(at, vall)
        step = np.zeros(b - a)
        step[1:] = np.nan_to_num((pace[1:] + pace[:-1]) / 2 * np.diff(at), nan=0.0)
        raw = np.cumsum(step)
        out[a:b] = np.maximum.accumulate(raw + np.nan_to_num(_interpolated(at, near - raw), nan=0.0))
    return out


class _Grid:
    """The envelope of one survey's signal on the uniform grid, made in blocks."""

    def __init__(self, x: np.ndarray, y: np.ndarray, step: float, window: int, beyond: int, most: int):
        known = ~np.isnan(y)
        self.x, self.y, self.step, self.beyond, self.most = x, y, step, beyond, most
        self.lo, self.hi = latest_known(known), np.append(next_known(known)[1:], len(x))
        self.n = int(np.ceil((x[-1] - x[0]) / step))
        w = max(3, min(window, self.n - 1))
        self.window = w + (w % 2 == 0)
        self.held = None
        self.mean = 0.0
        sums = [(float(v[:own].sum()), own) for _, own, v in self.blocks()]
        self.mean = sum(s for s, _ in sums) / self.n

    def place(self, i: np.ndarray) -> np.ndarray:
        return self.x[0] + i * self.step

    def _raw(self, a: int, b: int) -> np.ndarray:
        lo, hi = max(0, a - self.window), min(self.n, b + self.window)
        at = self.place(np.arange(lo, hi))
        row = np.searchsorted(self.x, at, side="right") - 1
        v = between(at, self.x, self.y, self.lo[row], self.hi[row])
        middle = centred_medians([v], np.array([0]), np.array([self.window]), repeat_ends=True)[0]
        return np.abs(v - middle)[a - lo : b - lo]

    def blocks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """First point, number of own points, and the envelope of these and of ``beyond`` points behind them."""
        if self.n <= self.most:
            if self.held is None:
                self.held = self._raw(0, self.n)
            yield 0, self.n, self.held - self.mean
            return
        for a in range(0, self.n, self.most):
            b = min(a + self.most, self.n)
            yield a, b - a, self._raw(a, min(b + self.beyond, self.n)) - self.mean


def _teeth(grid: _Grid, span: float, lo: int, hi: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Tooth numbers and detected positions, as ``best_lag`` and ``comb_teeth`` find them."""
    none = np.empty(0, dtype="int64"), np.empty(0)
    top = min(hi, grid.n - 1)
    if top < lo:
        return none
    lags, products, squares = np.arange(lo, top + 1), np.zeros(top + 1 - lo), 0.0
    for _, own, v in grid.blocks():
        head = np.where(np.arange(len(v)) < own, v, 0.0)
        products += [float(head[:-k] @ v[k:]) if k < len(v) else 0.0 for k in lags]
        squares += float(head @ head)
    best = int(np.argmax(products))
    lag = int(lags[best])
    if not products[best] > 0 or np.floor(span / (lag * grid.step)) < 2 or np.sqrt(squares / grid.n) < 1e-9:
        return none
    sums = np.zeros(lag)
    for a, own, v in grid.blocks():
        sums += np.bincount((a + np.arange(own)) % lag, weights=v[:own], minlength=lag)
    phase, half, last = int(np.argmax(sums)), lag / 4.0, grid.n - 1
    number = np.arange(grid.n // lag + 1)
    centre = phase + number * lag
    number = number[(centre - half >= 0) & (centre + half <= last) & (centre >= margin) & (last - centre >= margin)]
    begin = np.ceil(phase + number * lag - half).astype("int64")
    end = np.ceil(phase + number * lag + half).astype("int64")
    found = np.empty(len(number), dtype="int64")
    for a, own, v in grid.blocks():
        for i in np.flatnonzero((begin >= a) & (begin < a + own)):
            found[i] = begin[i] + np.argmax(v[begin[i] - a : end[i] - a])
    return number, grid.place(found)


def _line(k: np.ndarray, at: np.ndarray) -> tuple[float, float]:
    """Slope and intercept, summed as the engine's ``regr_slope`` and ``regr_intercept`` do it, to the last digit."""
    n = ck = m2 = x_mean = y_mean = 0.0
    for x, y in zip(k.tolist(), at.tolist()):
        n += 1
        dx = x - x_mean
        step = dx / n
        x_mean += step
        y_mean += (y - y_mean) / n
        ck += dx * (y - y_mean)
        m2 += dx * (dx - step)
    pitch = ck / m2
    return pitch, y_mean / n * n - pitch * (x_mean / n * n)


def _lattice(k: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Kept teeth, their lattice positions and the pitch, as ``fit_lattice``."""
    if len(k) < 2:
        return None
    pitch, phase = _line(k, at)
    e = at - (phase + k * pitch)
    mad = np.median(np.abs(e - np.median(e))) * 1.4826 + 1e-9
    kept = np.abs(e) < max(3.0 * mad, 0.5)
    if kept.sum() >= 2:
        k, at = k[kept], at[kept]
    pitch, phase = _line(k, at)
    return at, phase + k * pitch, pitch


def warped(x: np.ndarray, kx: np.ndarray, ky: np.ndarray) -> np.ndarray:
    """As ``registration.warp`` through at least two knots in the order of ``kx``."""
    slope = ratio(np.diff(ky), np.diff(kx))
    behind, ahead = np.append(np.nan, slope), np.append(slope, np.nan)
    steep = np.where(np.isnan(ahead), np.where(np.isnan(behind), 1.0, behind), ahead)
    j = np.searchsorted(kx, x, side="right") - 1
    before = 1.0 if np.isnan(ahead[0]) else ahead[0]
    i = np.maximum(j, 0)
    return np.where(j < 0, ky[0] + before * (x - kx[0]), ky[i] + steep[i] * (x - kx[i]))


def nearest_distance(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    marks = np.sort(marks)
    j = np.searchsorted(marks, x, side="right")
    lo, hi = np.append(-np.inf, marks)[j], np.append(marks, np.inf)[j]
    return np.minimum(x - lo, hi - x)


def longest_gap(fix: np.ndarray, x: np.ndarray) -> float:
    """Largest distance from the first to the last row of a run without a fix."""
    gone = np.concatenate([[False], ~fix, [False]])
    turns = np.flatnonzero(gone[1:] != gone[:-1])
    return float((x[turns[1::2] - 1] - x[turns[::2]]).max()) if len(turns) else 0.0


def registered(dr: np.ndarray, signal: np.ndarray, fix: np.ndarray, cfg, step: float, window: int, lags: tuple[int, int], most: int = GRID_POINTS) -> dict:
    """Chainage, distance to the next weld and quality of one survey, as ``registration.register``."""
    span, found = float(dr[-1] - dr[0]), None
    if span >= 1.5 * cfg.pitch_m and len(dr) >= 20 and not np.isnan(signal).all():
        grid = _Grid(dr, signal, step, window, lags[1], most)
        found = _lattice(*_teeth(grid, span, *lags, window / 2.0))
    out = {"chainage_m": dr, "dist_to_weld_m": np.nan, "n_welds_detected": 0, "pitch_estimate_m": np.nan}
    if found is not None:
        detected, lattice, pitch = found
        chainage = np.maximum.accumulate(warped(dr, detected, lattice))
        out = {"chainage_m": chainage, "dist_to_weld_m": nearest_distance(chainage, lattice), "n_welds_detected": len(lattice), "pitch_estimate_m": pitch}
    note = "survey shorter than the comb search" if span < 1.5 * cfg.pitch_m else "no reliable comb found" if found is None else "ok"
    return out | {"gps_locked_fraction": float(fix.mean()), "max_interpolated_gap_m": longest_gap(fix, dr), "note": note}


def odd_window(width: float, step: float, minimum: int = 3) -> int:
    """As ``series.odd_window``."""
    n = max(minimum, int(np.round(width / step)))
    return n + (n % 2 == 0)


def without_polynomial(axis: np.ndarray, y: np.ndarray, degree: int) -> np.ndarray | None:
    """Values less their robust polynomial, None without any known row."""
    known = ~np.isnan(axis) & ~np.isnan(y)
    if not known.any():
        return None
    coef = fit_polynomial(axis[known], y[known], degree)
    lo = np.nanmin(axis)
    x = np.nan_to_num(2.0 * ratio(axis - lo, np.nanmax(axis) - lo) - 1.0, nan=0.0)
    fit = np.zeros(len(y))
    for c in reversed(coef):
        fit = fit * x + c
    return y - fit


def _stops(y: np.ndarray, at: np.ndarray, limit: np.ndarray, strict: bool) -> list[list[tuple]]:
    """Per side what ``series.reach`` finds for the rows ``at``: (row, limit, minimum passed, stop, its value, value next to it)."""
    asked, out = np.full(len(y), np.nan), []
    asked[at] = limit
    v, t, rows = y.tolist(), asked.tolist(), list(range(len(y)))
    none, inf = float("nan"), [float("inf")] * len(v)
    for turn, near in ((slice(None), [*v[1:], none]), (slice(None, None, -1), [none, *v[:-1]])):
        out.append(sorted(_walk(rows[turn], v[turn], inf, t[turn], inf, near[turn], strict)[1]))
    return out


def peak_shapes(y: np.ndarray, min_sigmas: float) -> dict[str, np.ndarray]:
    """As ``series.peak_shapes``: rows of the peaks, prominence, width and asymmetry."""
    names = ("p", "prominence", "width", "asymmetry")
    none = dict(zip(names, (np.empty(0, dtype="int64"), *[np.empty(0)] * 3)))
    known = y[~np.isnan(y)]
    sigma = 1.4826 * np.median(np.abs(known - np.median(known))) if len(known) >= 8 else 0.0
    if not sigma > 0:
        return none
    first = np.flatnonzero(np.append(True, ~(y[1:] == y[:-1])))
    last = np.append(first[1:], len(y)) - 1
    value = y[first]
    tops = 1 + np.flatnonzero((value[1:-1] > value[:-2]) & (value[1:-1] > value[2:]))
    tops = tops[value[tops] - known.min() >= min_sigmas * sigma]
    if not len(tops):
        return none
    at, top = (first[tops] + last[tops]) // 2, value[tops]
    bases = [np.array([q[2] if q[2] < float("inf") else q[1] for q in side]) for side in _stops(y, at, top, True)]
    prominence = top - np.maximum(*bases)
    strong = prominence >= min_sigmas * sigma
    at, top, prominence = at[strong], top[strong], prominence[strong]
    if not len(at):
        return none
    level, ends = top - prominence * 0.5, []
    for toward, side in zip((1, -1), _stops(-y, at, -level, False)):
        stop, here, near = (np.array([np.nan if q[k] is None else q[k] for q in side], dtype=float) for k in (3, 4, 5))
        here, near = -here, -near
        ends.append(stop + toward * np.where(here < level, ratio(level - here, near - here), 0.0))
    left, right = ends
    width = np.fmax(1.0, right - left)
    return dict(zip(names, (at, prominence, width, ((right - at) - (at - left)) / width)))


def decay_exponents(y: np.ndarray, p: np.ndarray, width: np.ndarray, span: tuple[float, float], step: float) -> np.ndarray:
    """As ``series.decay_exponents``."""
    out = np.full(len(p), np.nan)
    mids = (p[1:] + p[:-1]) // 2
    begin = np.append(0, np.maximum(mids, p[:-1] + 1)) if len(p) else p
    end = np.append(np.minimum(mids, p[1:] - 1), len(y) - 1) if len(p) else p
    for i, at in enumerate(p):
        lo = max(1, int(np.floor(span[0] * width[i])))
        hi = max(lo + 2, int(np.floor(span[1] * width[i])))
        rows = np.arange(max(begin[i], at - hi), min(end[i], at + hi) + 1)
        d = np.abs(rows - at)
        ok = (d >= lo) & (y[rows] > 0)
        if ok.sum() >= 4:
            x, v = np.log(d[ok] * step), np.log(y[rows][ok])
            far = x - x.mean()
            out[i] = ratio((far * (v - v.mean())).sum(), (far * far).sum())
    return out


def near_peaks(n: int, p: np.ndarray, width: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """The peak of each row within ``radius`` widths of one (-1 else) and the distance in rows, as ``series.assign_to_peaks``."""
    if not len(p):
        return np.full(n, -1), np.full(n, np.nan)
    rows = np.arange(n)
    a, b = np.searchsorted(p, rows, side="right") - 1, np.searchsorted(p, rows)
    da = np.where(a >= 0, rows - p[np.maximum(a, 0)], np.inf)
    db = np.where(b < len(p), p[np.minimum(b, len(p) - 1)] - rows, np.inf)
    k, d = np.where(da <= db, a, b), np.minimum(da, db)
    within = d <= radius * width[k]
    return np.where(within, k, -1), np.where(within, d, np.nan)


def features(axis: np.ndarray, heads: dict[str, np.ndarray], starts: np.ndarray, prefixes: list[str], cfg, tie_break: float) -> dict[str, np.ndarray]:
    """What ``features.feature_frame`` makes of more than a row, for all groups; ``heads`` by their residual's name, ``r_mid_nt`` among them.

    A group without a known row of any head isn't kept.
    """
    n, groups = len(axis), bounds(starts, len(axis))
    keep, left = np.ones(n, dtype=bool), {name: np.full(n, np.nan) for name in heads}
    steps, sizes, detrend = np.ones(len(groups)), {p: np.full(len(groups), 3) for p in prefixes}, np.full(len(groups), 3)
    for i, (a, b) in enumerate(groups):
        got = {name: without_polynomial(axis[a:b], y[a:b], cfg.detrend_degree) for name, y in heads.items()}
        if all(v is None for v in got.values()):
            keep[a:b] = False
            continue
        for name, v in got.items():
            if v is not None:
                left[name][a:b] = v
        if b - a > 1:
            steps[i] = float(np.nanmax(axis[a:b]) - np.nanmin(axis[a:b])) / (b - a - 1)
        for p, width in zip(prefixes, cfg.windows_m):
            sizes[p][i] = odd_window(width, float(steps[i]))
        detrend[i] = odd_window(cfg.detrend_window_m, float(steps[i])) if cfg.detrend_window_m > 0 else 3
    if cfg.detrend_window_m > 0:
        for name, middle in zip(left, centred_medians(list(left.values()), starts, detrend)):
            left[name] = left[name] - middle

    mid = left["r_mid_nt"]
    crossed = np.zeros(n)
    crossed[1:] = ((mid[1:] < 0) != (mid[:-1] < 0)) & ~np.isnan(mid[1:]) & ~np.isnan(mid[:-1])
    crossed[starts] = 0.0
    out = {name: np.full(n, np.nan) for name in PEAK_COLUMNS} | {"edge": np.zeros(n, dtype=bool)}
    half = np.maximum.reduce([detrend, *sizes.values()]) // 2
    for i, (a, b) in enumerate(groups):
        y, rows = mid[a:b], np.arange(b - a)
        s = axis[a:b] + rows * tie_break
        out["dr_ds_nt_per_m"][a:b] = first = gradient(y, s)
        out["d2r_ds2_nt_per_m2"][a:b] = gradient(first, s)
        out["edge"][a:b] = (rows < half[i]) | (rows >= b - a - half[i])
        top = peak_shapes(np.abs(y), cfg.peak_sigmas)
        if not len(top["p"]):
            continue
        decay = decay_exponents(np.abs(y), top["p"], top["width"], cfg.flank_span, steps[i])
        k, d = near_peaks(b - a, top["p"], top["width"], cfg.peak_radius)
        values = {"fwhm_m": top["width"] * steps[i], "peak_asymmetry": top["asymmetry"], "decay_exponent": decay, "peak_prominence_nt": top["prominence"]}
        for name, v in values.items():
            out[name][a:b] = np.where(k >= 0, v[k], np.nan)
        out["peak_distance_m"][a:b] = d * steps[i]
    rolled = window_stats(pd.Series(mid), pd.Series(crossed), starts, sizes)
    return left | out | {c: rolled[c].to_numpy() for c in (f"{p}_{stat}" for p in prefixes for stat in ROLLING)} | {"keep": keep}


PEAK_COLUMNS = ("dr_ds_nt_per_m", "d2r_ds2_nt_per_m2", "fwhm_m", "peak_asymmetry", "decay_exponent", "peak_prominence_nt", "peak_distance_m")
