"""Calculus and windows on ordered series: derivative, interpolation, grids, rolling statistics, peaks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import safe_div
from ..session import cut
from .ordered import SINGLE_TASK_ROWS, Series, after, before, by_position, earlier, following, highest, later, latest, map_groups, order_rows, total, with_keys
from .quantiles import median_mad

ROLLING = ("mean", "std", "max", "ptp", "kurt", "zcr", "energy")
LEVEL_FANOUT = 1024


def gradient(series: Series, y: str, x: str, out: str) -> Series:
    """dy/dx on an irregular axis: second order inside, one-sided at the ends."""
    near = series.running(
        __y0=before(F.col(y)), __x0=before(F.col(x)), __y1=after(F.col(y)), __x1=after(F.col(x))
    ).df
    hs, hd = F.col(x) - F.col("__x0"), F.col("__x1") - F.col(x)
    back, ahead = safe_div(F.col(y) - F.col("__y0"), hs), safe_div(F.col("__y1") - F.col(y), hd)
    inside = safe_div(hs * hs * F.col("__y1") + (hd * hd - hs * hs) * F.col(y) - hd * hd * F.col("__y0"), hs * hd * (hd + hs))
    value = F.when(hs.isNull(), ahead).when(hd.isNull(), back).otherwise(inside)
    return series.with_df(near.withColumn(out, value).drop("__y0", "__x0", "__y1", "__x1"))


def zero_crossing(series: Series, y: str, out: str) -> Series:
    """1.0 where the sign differs from the previous row, 0.0 on the first."""
    prior = series.running(__p=before(F.col(y))).df
    flip = (F.col(y) < 0) != (F.col("__p") < 0)
    return series.with_df(prior.withColumn(out, F.coalesce(flip, F.lit(False)).cast("double")).drop("__p"))


def interpolate(series: Series, x: str, anchors: dict[str, Column]) -> Series:
    """Linear interpolation of each anchor expression (NULL where unknown) over ``x``; flat beyond the ends."""
    steps, cols = {}, series.df.columns
    for i, v in enumerate(anchors.values()):
        known = F.when(v.isNotNull(), F.struct(F.col(x).alias("x"), v.alias("y")))
        steps[f"__lo{i}"], steps[f"__hi{i}"] = latest(known), following(known)
    near = series.running(**steps).df
    out = []
    for i, name in enumerate(anchors):
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        slope = F.coalesce(safe_div(hi["y"] - lo["y"], hi["x"] - lo["x"]), F.lit(0.0))
        out.append(F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(lo["y"] + slope * (F.col(x) - lo["x"])).alias(name))
    return series.with_df(near.select(*[c for c in cols if c not in anchors], *out))


def monotone(series: Series, x: str, out: str) -> Series:
    """Running maximum: the axis never goes back."""
    return series.running(**{out: highest(F.col(x))})


def resample(series: Series, x: str, y: str, step: float, block: int = 1 << 16) -> DataFrame:
    """The series on a uniform grid, by linear interpolation.

    A row makes the grid's points from its own place to before the next row's, so
    only rows are ordered, not the points, of which there may be many times more.
    A gap of more than ``block`` points is cut into blocks, which are spread.
    """
    keys = list(series.keys)
    rows = series.df.select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"), F.col(series.idx).alias("__o")).filter("__x is not null")
    bounds = rows.groupBy(*keys).agg(F.min("__x").alias("__first"), F.max("__x").alias("__end"))
    knot = F.when(F.col("__y").isNotNull(), F.struct(F.col("__x").alias("x"), F.col("__y").alias("y")))
    placed = order_rows(rows, keys, ["__x", "__o"], idx="__i", longest=series.longest, chunk_rows=series.chunk_rows)
    placed = placed.running(__lo=latest(knot), __hi=later(knot), __next=after(F.col("__x"))).df.join(bounds, keys)
    at = lambda i: F.col("__first") + i * step

    def begin(place: Column) -> Column:
        """Number of the first point that is not below ``place``, as the points themselves are rounded."""
        i = F.ceil((place - F.col("__first")) / step).cast("long")
        return F.when(at(i - 1) >= place, i - 1).when(at(i) >= place, i).otherwise(i + 1)

    n = F.ceil((F.col("__end") - F.col("__first")) / step).cast("long")
    most = bounds.agg(F.max(n)).first()[0] or 0
    parts = placed.withColumn("__n", n).filter("__n > 0").withColumn(
        "__a", F.when(F.col("__i") == 0, F.lit(0)).otherwise(begin(F.col("__x")))
    ).withColumn("__b", F.least("__n", F.coalesce(begin(F.col("__next")), "__n")) - 1).filter("__a <= __b")
    parts = parts.select(*keys, "__first", "__lo", "__hi", "__a", "__b")
    if most > block:
        long = F.col("__b") - F.col("__a") >= block
        blocks = parts.filter(long).withColumn("__c", F.explode(F.sequence(F.col("__a"), F.col("__b"), F.lit(block).cast("long"))))
        blocks = blocks.repartition(*keys, "__c").withColumn("__a", F.col("__c")).withColumn("__b", F.least("__b", F.col("__c") + block - 1)).drop("__c")
        parts = parts.filter(~long).unionByName(blocks)
    points = parts.withColumn("grid_i", F.explode(F.sequence("__a", "__b"))).withColumn("grid_x", at(F.col("grid_i")))
    lo, hi = F.col("__lo"), F.col("__hi")
    slope = F.coalesce(safe_div(hi["y"] - lo["y"], hi["x"] - lo["x"]), F.lit(0.0))
    value = F.when(lo.isNull(), hi["y"]).when(hi.isNull(), lo["y"]).otherwise(lo["y"] + slope * (F.col("grid_x") - lo["x"]))
    return points.select(*keys, "grid_i", "grid_x", value.alias(y))


def odd_window(width: float, step: Column, minimum: int = 3) -> Column:
    """Rows of a window of ``width``, rounded half to even and made odd."""
    n = F.greatest(F.lit(minimum), F.bround(F.lit(float(width)) / step).cast("int"))
    return F.when(n % 2 == 1, n).otherwise(n + 1)


def mean_step(df: DataFrame, keys: Sequence[str], axis: str) -> DataFrame:
    return df.groupBy(*keys).agg(_mean_step(axis, lambda c: c).alias("mean_step"), F.count(F.lit(1)).alias("n_rows"))


def _mean_step(axis: str, over: Callable[[Column], Column]) -> Column:
    n = over(F.count(F.lit(1)))
    return F.when(n < 2, F.lit(1.0)).otherwise((over(F.max(axis)) - over(F.min(axis))) / F.greatest(F.lit(1), n - 1))


def beside_mean_step(series: Series, axis: str) -> DataFrame:
    """The rows that have a key with its ``mean_step``, which is taken where a key's rows lie if they fit in a task."""
    keys = list(series.keys)
    if series.longest is None or series.longest > SINGLE_TASK_ROWS:
        return series.df.join(mean_step(series.df, keys, axis).drop("n_rows"), keys)
    w = Window.partitionBy(*keys)
    return with_keys(series.df, keys).withColumn("mean_step", _mean_step(axis, lambda c: c.over(w)))


def rolling_stats(series: Series, y: str, windows: dict[str, str], reach: int | Column) -> Series:
    """Centred full-window statistics of ``y`` for each window.

    ``windows`` maps a prefix to the column holding that key's odd window length;
    ``reach`` bounds half of the longest one, of all keys or of the row's own. Each
    task sees one chunk and the rows that reach into it, or the chunks of whole keys
    where these are short. Sliding frames in the engine add up every frame again,
    which costs the window length per row; pandas slides them.
    """
    series = series.measured()
    kept, idx = series.df.columns, series.idx
    # 1 below zero, 0 not, -1 unknown: the call sees no difference between NaN and NULL
    signed = series.with_df(series.df.withColumn("__neg", F.coalesce((F.col(y) < 0).cast("byte"), F.lit(-1).cast("byte"))))
    schema = T.StructType([signed.df.schema[c] for c in kept] + [
        T.StructField(f"{p}_{s}", T.DoubleType()) for p in windows for s in ROLLING
    ])

    def chunks(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        neg = pdf["__neg"].to_numpy()
        crossed = np.zeros(len(pdf))
        crossed[1:] = (neg[1:] != neg[:-1]) & (neg[1:] >= 0) & (neg[:-1] >= 0)
        crossed[starts] = 0.0
        got = window_stats(pdf[y].astype("float64"), pd.Series(crossed), starts, {p: pdf[c].to_numpy()[starts] for p, c in windows.items()})
        return pdf.assign(**got).loc[pdf["__core"], [f.name for f in schema.fields]]

    # one row more before a frame: the first of a frame may cross from it
    tagged = signed.halo(reach + 1, reach)
    out = map_groups(tagged, series.chunk_keys(), idx, chunks, schema, deal=series.keys if series.by_key else None)
    return series.with_df(_no_nan(out, [f"{p}_{s}" for p in windows for s in ROLLING]))


def window_stats(v: pd.Series, crossings: pd.Series, starts: np.ndarray, windows: dict[str, np.ndarray]) -> dict[str, pd.Series]:
    """Statistics of groups that begin at ``starts``, each over its odd windows; NaN counts as missing."""
    n, out = len(v), {}
    first = np.repeat(starts, np.diff([*starts, n]))
    end = np.repeat([*starts[1:], n], np.diff([*starts, n]))
    centred, known = _centred(v, starts), np.concatenate([[0], v.notna().cumsum()])
    at = np.arange(n)
    for prefix, sizes in windows.items():
        w = np.repeat(np.asarray(sizes).astype("int64"), np.diff([*starts, n]))
        lo, hi = np.maximum(first, at - w // 2), np.minimum(end, at + w // 2 + 1)
        spans = _Spans(start=lo, end=hi)
        # as with ``min_periods=w``: a frame without w known values has no statistic
        full, all_zc = known[hi] - known[lo] >= w, hi - lo >= w
        roll = v.rolling(spans, min_periods=1)
        top = roll.max()
        out |= {
            f"{prefix}_mean": roll.mean().where(full), f"{prefix}_std": roll.std().where(full), f"{prefix}_max": top.where(full),
            f"{prefix}_ptp": (top - roll.min()).where(full), f"{prefix}_kurt": centred.rolling(spans, min_periods=1).kurt().where(full & (w >= 4)),
            f"{prefix}_zcr": crossings.rolling(spans, min_periods=1).mean().where(all_zc),
            f"{prefix}_energy": (v * v).rolling(spans, min_periods=1).sum().where(full),
        }
    return out


class _Spans(BaseIndexer):
    """Frames from ``start`` to before ``end``; one that begins behind the last one's end is added up afresh."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.start.astype("int64"), self.end.astype("int64")


def _centred(v: pd.Series, starts: np.ndarray) -> pd.Series:
    """Values less the whole part of their group's mean, which moments of fourth order need to stay exact."""
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, len(v)]))
    parts = v.replace([np.inf, -np.inf], np.nan).groupby(group)
    mean = parts.transform("mean")
    return v - mean.round().where(parts.transform("min") - mean > -1e5, 0.0)


def rolling_median(series: Series, y: str, window: str, reach: int, out: str, repeat_ends: bool = False) -> Series:
    """Centred median over the key's odd window length; short at the ends, or with the end values repeated."""
    return rolling_medians(series, {y: out}, window, reach, repeat_ends)


def rolling_medians(series: Series, columns: dict[str, str], window: str, reach: int, repeat_ends: bool = False) -> Series:
    """As ``rolling_median`` for several columns, input to output name, in one shuffle and one pass of the workers."""
    kept, idx = series.df.columns, series.idx
    schema = T.StructType([*series.df.schema.fields, *[T.StructField(out, T.DoubleType()) for out in columns.values()]])

    def chunks(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        # chunk borders inside a series carry at least ``reach`` neighbours, so the repeats only count at its ends
        values = [pdf[y].to_numpy(dtype="float64", na_value=np.nan) for y in columns]
        for out, v in zip(columns.values(), centred_medians(values, starts, pdf[window].to_numpy()[starts], repeat_ends)):
            pdf[out] = v
        return pdf.loc[pdf["__core"], [*kept, *columns.values()]]

    return series.with_df(map_groups(series.halo(reach, reach), series.chunk_keys(), idx, chunks, schema))


def centred_medians(values: Sequence[np.ndarray], starts: np.ndarray, window: np.ndarray, repeat_ends: bool = False) -> list[np.ndarray]:
    """Centred medians of groups that begin at ``starts``, each over its odd ``window``; NaN counts as missing."""
    rows = np.diff([*starts, len(values[0])])
    w = np.asarray(window).astype("int64")
    pad = w // 2 if repeat_ends else np.zeros_like(w)
    size = rows + 2 * pad
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(first))
    source = np.clip(at - first - np.repeat(pad, size), 0, np.repeat(rows - 1, size)) + np.repeat(starts, size)
    own = (at - first >= np.repeat(pad, size)) & (at - first < np.repeat(pad + rows, size))
    # the frames of a centred window, none beyond its group
    end = at + 1 + np.repeat((w - 1) // 2, size)
    spans = _Spans(start=np.maximum(first, end - np.repeat(w, size)), end=np.minimum(first + np.repeat(size, size), end))
    return [pd.Series(v[source]).rolling(spans, min_periods=1).median().to_numpy()[own] for v in values]


def smooth_polynomial(series: Series, y: str, window: int, degree: int, out: str) -> Series:
    """Local polynomial smoothing of fixed width: one weighted sum per row, a polynomial fit at both ends."""
    half, kept, idx = window // 2, series.df.columns, series.idx
    t = np.arange(-half, half + 1, dtype=float)
    weights = np.linalg.pinv(np.vander(t, degree + 1, increasing=True))[0]
    sizes = series.df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("__n"))
    schema = T.StructType([*series.df.schema.fields, T.StructField(out, T.DoubleType())])

    def one_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx, ignore_index=True)
        v = pdf[y].to_numpy(dtype=float)
        got = np.convolve(v, weights[::-1], mode="same") if len(v) >= window else v.copy()
        pos = pdf[idx].to_numpy()
        n = int(pdf["__n"].iloc[0])
        for end in (pos < half, pos >= n - half):
            if end.any() and len(v) >= window:
                part = slice(0, window) if pos[end][0] < half else slice(len(v) - window, len(v))
                fit = np.polyfit(pos[part] - pos[part][0], v[part], degree)
                got[end] = np.polyval(fit, pos[end] - pos[part][0])
        pdf[out] = got
        return pdf.loc[pdf["__core"], [*kept, out]]

    tagged = series.halo(window, window).join(sizes, list(series.keys))
    return series.with_df(tagged.groupBy(*series.chunk_keys()).applyInPandas(one_chunk, schema))


def metre_frames(df: DataFrame, keys: Sequence[str], axis: str, half_m: float, aggregates: dict, block_m: float | None = None) -> DataFrame:
    """Centred frames of a fixed length on the axis, whatever the spacing.

    Rows are cut into blocks of the axis and copied into the neighbouring blocks
    they reach, so a long line spreads over many tasks.
    """
    mm, half = F.round(F.col(axis) * 1000).cast("long"), int(round(half_m * 1000))
    size = max(half, int((block_m or max(64 * half_m, 1.0)) * 1000))
    home = F.expr(f"floor(__mm / {size})").cast("long")
    base = df.withColumn("__mm", mm).withColumn("__home", home)
    targets = F.sequence(F.expr(f"floor((__mm - {half}) / {size})").cast("long"), F.expr(f"floor((__mm + {half}) / {size})").cast("long"))
    tagged = base.withColumn("__block", F.explode(targets))
    w = Window.partitionBy(*keys, "__block").orderBy("__mm").rangeBetween(-half, half)
    out = tagged.select("*", *[f(w).alias(n) for n, f in aggregates.items()])
    return out.filter("__block = __home").select(*df.columns, *aggregates)


def local_maxima(series: Series, y: str) -> DataFrame:
    """Rows higher than both neighbours; a flat top counts once, at its middle (rounded down).

    The first and last stretch of a series are never maxima.
    """
    prior = series.running(__p=before(F.col(y)))
    stretch = prior.running(__run=total(F.coalesce(F.col(y) != F.col("__p"), F.lit(True)).cast("long"))).df
    keys = list(series.keys)
    flats = stretch.groupBy(*keys, "__run").agg(
        F.min(series.idx).alias("__first"), F.max(series.idx).alias("__last"), F.first(y).alias("value")
    )
    around = Series(flats, series.keys, "__first", series.longest, series.chunk_rows).running(__lo=before(F.col("value")), __hi=after(F.col("value"))).df
    tops = around.filter((F.col("value") > F.col("__lo")) & (F.col("value") > F.col("__hi")))
    return tops.select(*keys, F.expr("(__first + __last) div 2").alias(series.idx), "value")


def reach(
    series: Series, y: Column, threshold: Column, strict: bool, row_before: Column | None = None, row_after: Column | None = None
) -> DataFrame:
    """For rows with a ``threshold``: the nearest row beyond it on each side, and the minimum in between.

    Beyond is ``y > threshold`` if ``strict`` else ``y >= threshold``. Result per
    query row and ``side``: ``stop_idx`` and ``stop_value`` (NULL if the series
    ends first), ``stop_next`` (of the row next to the stop toward the query, from
    ``row_before``/``row_after``) and ``between_min`` (NULL if nothing lies between).

    A chunk keeps a falling stack of the values that can still stop somebody.
    Queries that leave their chunk meet only the stacks of the chunks before it,
    chunk group by chunk group, so each level is a small fraction of the one below
    and no task sees a whole series.
    """
    keys, null = list(series.keys), F.lit(None)
    items = series.df.select(
        *keys, F.expr(f"`{series.idx}` div {series.chunk_rows}L").alias("__c"), F.col(series.idx).cast("long").alias("__pos"),
        y.cast("double").alias("__v"), threshold.cast("double").alias("__t"),
        (null if row_after is None else row_after).cast("double").alias("__a0"), (null if row_before is None else row_before).cast("double").alias("__a1"),
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.select(*keys).schema.fields)
    schema = f"{fields}, " + ", ".join(f"{c} {t}" for c, t in _REACH_FIELDS)
    whole = series.one_chunk
    got = map_groups(items, [*keys, "__c"], "__pos", _first_level(keys, strict, whole), schema)
    done: list[DataFrame] = []
    while not whole:
        got = cut(got)
        spread = got.groupBy(*keys).agg((F.max("__c") - F.min("__c")).alias("d")).agg(F.max("d")).first()[0]
        if not spread:
            break
        done.append(got.filter("__kind = 1"))
        # waiting queries come before the stack of their own chunk; the right side runs backwards
        sign = F.when(F.col("__side") == 0, 1).otherwise(-1)
        place = F.col("__c") * sign * F.lit(1 << 32) + F.when(F.col("__kind") == 2, F.lit(0)).otherwise(F.col("__o") + 1)
        items = got.filter("__kind in (0, 2)").withColumn("__o", place).withColumn("__c", F.expr(f"__c div {LEVEL_FANOUT}"))
        got = map_groups(items, [*keys, "__side", "__c"], "__o", _next_level(keys, strict), schema)
    done.append(got.filter("__kind in (1, 2)"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(
        *keys, F.col("__pos").alias(series.idx), F.when(F.col("__side") == 0, "left").otherwise("right").alias("side"),
        F.col("__stop").alias("stop_idx"), F.when(F.col("__kind") == 1, F.col("__v")).alias("stop_value"),
        F.when(F.col("__kind") == 1, F.col("__a")).alias("stop_next"), F.when(F.col("__b") < float("inf"), F.col("__b")).alias("between_min"),
    )


_REACH_FIELDS = [
    ("__side", "int"), ("__c", "long"), ("__o", "long"), ("__pos", "long"), ("__v", "double"), ("__g", "double"), ("__t", "double"),
    ("__b", "double"), ("__a", "double"), ("__kind", "int"), ("__stop", "long"),
]


def _walk(pos, v, g, t, b, a, strict: bool):
    """One pass over rows in order: (stack entries, queries).

    ``g`` is the minimum hidden behind an entry, ``b`` what a query has passed so
    far. A query is (pos, threshold, passed minimum, stop position, stop value,
    stop neighbour), the last three None if nothing in here stops it.
    """
    inf = float("inf")
    sv, sg, sp, sa, head, queries = [], [], [], [], inf, []
    for p, x, hidden, limit, passed, near in zip(pos, v, g, t, b, a):
        if limit == limit:
            low, i = passed, len(sv) - 1
            while i >= 0 and not (sv[i] > limit if strict else sv[i] >= limit):
                low = min(low, sg[i], sv[i] if sv[i] > -inf else inf)
                i -= 1
            if i >= 0:
                queries.append((p, limit, min(low, sg[i]), sp[i], sv[i], sa[i]))
            else:
                queries.append((p, limit, min(low, head), None, None, None))
        if x != x:
            continue
        low = inf
        while sv and sv[-1] <= x:
            top = sv.pop()
            low = min(low, sg.pop(), top if top > -inf else inf)
            sp.pop()
            sa.pop()
        if sv:
            sg[-1] = min(sg[-1], low)
        else:
            head = min(head, low)
        sv.append(x)
        sg.append(hidden)
        sp.append(p)
        sa.append(near)
    # rows before the first entry stand behind an entry below all values
    return (list(zip([-1, *sp], [-inf, *sv], [head, *sg], [np.nan, *sa])), queries)


def _reach_frame(pdf: pd.DataFrame, keys: list[str], parts: list) -> pd.DataFrame:
    """Rows of groups, each with its first row; kind 0 is a stack entry, 1 an answered query, 2 one that left the chunk."""
    rows, owner, chunk, inf = [], [], pdf["__c"].to_numpy(), float("inf")
    for start, side, entries, queries in parts:
        c = int(chunk[start])
        rows += [(side, c, o, p, v, g, np.nan, inf, a, 0, None) for o, (p, v, g, a) in enumerate(entries)]
        for p, t, low, stop, at, near in queries:
            kind = 2 if stop is None else 1
            rows.append((side, c, 0, p, np.nan if at is None else at, inf, t, low, np.nan if near is None else near, kind, stop))
        owner.append((start, len(entries) + len(queries)))
    out = pd.DataFrame(rows, columns=[c for c, _ in _REACH_FIELDS])
    out["__stop"] = out["__stop"].astype("Int64")
    source = np.repeat([s for s, _ in owner], [n for _, n in owner])
    for i, k in enumerate(keys):
        out.insert(i, k, pdf[k].take(source).reset_index(drop=True))
    return out


def _first_level(keys: list[str], strict: bool, whole: bool):
    def solve(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        parts = []
        cols = {c: pdf[c].tolist() for c in ("__pos", "__v", "__t", "__a0", "__a1")}
        bounds = [*starts.tolist(), len(pdf)]
        for a, b in zip(bounds, bounds[1:]):
            inf, own = [float("inf")] * (b - a), {c: v[a:b] for c, v in cols.items()}
            for side in (0, 1):
                turn = slice(None, None, -1 if side else 1)
                entries, queries = _walk(
                    own["__pos"][turn], own["__v"][turn], inf, own["__t"][turn], inf, own[f"__a{side}"][turn], strict
                )
                parts.append((a, side, [] if whole else entries, queries))
        return _reach_frame(pdf, keys, parts)

    return solve


def _next_level(keys: list[str], strict: bool):
    def solve(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        cols = [pdf[c].tolist() for c in ("__pos", "__v", "__g", "__t", "__b", "__a")]
        side, bounds = pdf["__side"].tolist(), [*starts.tolist(), len(pdf)]
        return _reach_frame(pdf, keys, [(a, int(side[a]), *_walk(*[v[a:b] for v in cols], strict)) for a, b in zip(bounds, bounds[1:])])

    return solve


def prominences(series: Series, y: str, peaks: DataFrame) -> DataFrame:
    """Height of each peak over the higher of its two bases; a base lies between the peak and the next higher row."""
    keys, idx = list(series.keys), series.idx
    marks = peaks.select(*keys, idx, F.col("value").alias("__top"))
    marked = series.with_df(series.df.select(*keys, idx, y).join(marks, [*keys, idx], "left"))
    bases = reach(marked, F.col(y), F.col("__top"), strict=True).select(*keys, idx, "between_min")
    low = bases.join(marks, [*keys, idx]).groupBy(*keys, idx).agg(
        F.first("__top").alias("value"), F.max(F.coalesce("between_min", "__top")).alias("__base")
    )
    return low.select(*keys, idx, "value", (F.col("value") - F.col("__base")).alias("prominence"))


def half_widths(series: Series, y: str, peaks: DataFrame) -> DataFrame:
    """Crossings of half prominence on both sides of each peak, interpolated between rows."""
    keys, idx = list(series.keys), series.idx
    rows = series.with_df(series.df.select(*keys, idx, y)).running(__prev=before(F.col(y)), __next=after(F.col(y)))
    level = peaks.select(*keys, idx, (F.col("value") - F.col("prominence") * 0.5).alias("__lev"))
    asked = rows.with_df(rows.df.join(level, [*keys, idx], "left"))
    # looking for the first row at or below the level
    hits = reach(asked, -F.col(y), -F.col("__lev"), strict=False, row_before=F.col("__prev"), row_after=F.col("__next"))
    at, near, lev = -F.col("stop_value"), F.col("stop_next"), F.col("__lev")
    toward = F.when(F.col("side") == "left", 1).otherwise(-1)
    frac = F.when(at < lev, safe_div(lev - at, near - at)).otherwise(0.0)
    hits = hits.join(level, [*keys, idx]).select(*keys, idx, "side", (F.col("stop_idx") + toward * frac).alias("__x"))
    ends = hits.groupBy(*keys, idx).agg(
        F.max(F.when(F.col("side") == "left", F.col("__x"))).alias("left_x"), F.max(F.when(F.col("side") == "right", F.col("__x"))).alias("right_x")
    )
    return peaks.join(ends, [*keys, idx])


def peak_shapes(series: Series, y: str, min_sigmas: float) -> DataFrame:
    """Maxima of ``y`` standing out by ``min_sigmas`` robust deviations, with width and asymmetry in rows."""
    keys, idx = list(series.keys), series.idx
    if not series.dense:
        at = by_position(series, _LABEL)
        return _labelled(peak_shapes(at, y, min_sigmas), at)
    stats = median_mad(series.df, keys, y, series.longest)
    sigma = F.lit(1.4826) * F.col("mad")
    tops = local_maxima(series, y).join(stats.filter((sigma > 0) & (F.col("n") >= 8)).select(*keys, sigma.alias("__s")), keys)
    # a peak stands out at most by its height over the lowest row
    floor = series.df.groupBy(*keys).agg(F.min(y).alias("__min"))
    tops = tops.join(floor, keys).filter(F.col("value") - F.col("__min") >= F.lit(min_sigmas) * F.col("__s"))
    tops = cut(tops)
    strong = prominences(series, y, tops).join(tops.select(*keys, idx, "__s"), [*keys, idx])
    strong = cut(strong.filter(F.col("prominence") >= F.lit(min_sigmas) * F.col("__s")).drop("__s"))
    shaped = half_widths(series, y, strong)
    width = F.greatest(F.lit(1.0), F.col("right_x") - F.col("left_x"))
    asym = ((F.col("right_x") - F.col(idx)) - (F.col(idx) - F.col("left_x"))) / width
    return cut(shaped.select(*keys, idx, "value", "prominence", width.alias("width"), asym.alias("asymmetry")))


def decay_exponents(series: Series, y: str, peaks: DataFrame, span: tuple[float, float], step: str) -> DataFrame:
    """Slope of ln(y) on ln(distance) over both flanks of each peak, up to the midpoints to its neighbours.

    ``peaks`` and the series rows carry the mean step of the key in ``step``.
    Each row looks at the peak before and after it, so flanks need no pair join.
    """
    keys, idx = list(series.keys), series.idx
    if not series.dense:
        at = by_position(series, _LABEL)
        return _labelled(decay_exponents(at, y, _placed(peaks, at), span, step), at)
    lo = F.greatest(F.lit(1), F.floor(F.lit(span[0]) * F.col("width")).cast("long"))
    hi = F.greatest(lo + 2, F.floor(F.lit(span[1]) * F.col("width")).cast("long"))
    marks = peaks.select(*keys, idx, F.struct(F.col(idx).alias("p"), lo.alias("lo"), hi.alias("hi")).alias("__pk"))
    rows = series.with_df(series.df.select(*keys, idx, y, step).join(marks, [*keys, idx], "left"))
    near = rows.running(__a=earlier(F.col("__pk")), __b=later(F.col("__pk"))).df
    here = F.col(idx)
    mid = F.expr("(__a.p + __b.p) div 2")
    own_a = F.col("__a").isNotNull() & (F.col("__b").isNull() | (here <= mid)) & F.col("__pk").isNull()
    own_b = F.col("__b").isNotNull() & (F.col("__a").isNull() | (here >= mid)) & F.col("__pk").isNull()
    fits = near.select(*keys, idx, y, step, F.explode(F.array_compact(F.array(F.when(own_a, F.col("__a")), F.when(own_b, F.col("__b"))))).alias("__own"))
    d = F.abs(F.col(idx) - F.col("__own.p"))
    fits = fits.filter(d.between(F.col("__own.lo"), F.col("__own.hi")) & (F.col(y) > 0))
    ln_d, ln_y = F.ln(d * F.col(step)), F.ln(F.when(F.col(y) > 0, F.col(y)))
    got = fits.select(*keys, F.col("__own.p").alias(idx), ln_d.alias("__ld"), ln_y.alias("__ly")).groupBy(*keys, idx).agg(
        F.regr_slope("__ly", "__ld").alias("s"), F.count(F.lit(1)).alias("n")
    )
    return peaks.join(got.select(*keys, idx, F.when(F.col("n") >= 4, F.col("s")).alias("decay_exponent")), [*keys, idx], "left")


def assign_to_peaks(series: Series, peaks: DataFrame, columns: Sequence[str], radius: float, distance: str) -> Series:
    """Values of the nearest peak on rows within ``radius`` widths of it, NULL elsewhere; ties take the earlier peak."""
    keys, idx = list(series.keys), series.idx
    cols = series.df.columns
    if not series.dense:
        at = by_position(series, _LABEL)
        done = assign_to_peaks(at, _placed(peaks, at), columns, radius, distance).df
        return series.with_df(done.drop(idx).withColumnRenamed(_LABEL, idx).select(*cols, *columns, distance))
    marks = peaks.select(*keys, idx, F.struct(F.col(idx).alias("p"), "width", *columns).alias("__pk"))
    near = series.with_df(series.df.join(marks, [*keys, idx], "left")).running(__a=latest(F.col("__pk")), __b=following(F.col("__pk"))).df
    da, db = F.col(idx) - F.col("__a.p"), F.col("__b.p") - F.col(idx)
    use_a = db.isNull() | (da <= db)
    out = near.withColumn("__k", F.when(use_a, F.col("__a")).otherwise(F.col("__b"))).withColumn("__d", F.abs(F.col(idx) - F.col("__k.p")))
    within = F.col("__d") <= F.lit(radius) * F.col("__k.width")
    return series.with_df(out.select(*cols, *[F.when(within, F.col(f"__k.{c}")).alias(c) for c in columns], F.when(within, F.col("__d")).alias(distance)))


_LABEL = "__label"


def _labelled(peaks: DataFrame, at: Series) -> DataFrame:
    """Peaks by row position, under the index that the rows came with."""
    names = at.df.select(*at.keys, at.idx, _LABEL)
    return peaks.join(names, [*at.keys, at.idx]).drop(at.idx).withColumnRenamed(_LABEL, at.idx).select(*peaks.columns)


def _placed(peaks: DataFrame, at: Series) -> DataFrame:
    """Peaks by the rows' own index, under their row position."""
    places = at.df.select(*at.keys, F.col(_LABEL).alias(at.idx), F.col(at.idx).alias("__place"))
    return peaks.join(places, [*at.keys, at.idx]).drop(at.idx).withColumnRenamed("__place", at.idx).select(*peaks.columns)


def _no_nan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in set(columns) else F.col(c) for c in df.columns])
