"""Joins on closeness: nearest source, band pairs, one-to-one greedy matching, first seen."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ordered import Series, after, before, earlier, following, later, latest, order_rows, total

SMALL_KEY_ROWS = 2_000
#: rows of the stretches that are walked in one group, on average
WALK_ROWS = 10_000


def nearest(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_x: str, right_x: str, right_id: str, payload: Sequence[str] = ()
) -> DataFrame:
    """The nearest right row of the same key for every left row, and the distance.

    Both sides are merged into one ordered series, so each left row looks at its
    two neighbours only. Equal distances take the lower position, equal
    positions the smaller id. Without any right row: NULL and infinity.
    """
    keys, payload = list(keys), list(payload)
    right = right.filter(F.col(right_x).isNotNull()).groupBy(*keys, F.col(right_x).alias("__x")).agg(
        F.min(F.struct(F.col(right_id), *[F.col(c) for c in payload])).alias("__r")
    )
    lcols = left.columns
    both = left.withColumn("__x", F.col(left_x)).withColumn("__side", F.lit(1)).unionByName(
        right.withColumn("__side", F.lit(0)), allowMissingColumns=True
    )
    tie = F.xxhash64(*[F.col(c) for c in lcols])
    series = order_rows(both, keys, [F.col("__x").asc_nulls_last(), F.col("__side"), tie], idx="__i")
    ref = F.when(F.col("__side") == 0, F.struct(F.col("__x").alias("x"), F.col("__r").alias("r")))
    near = series.running(__lo=latest(ref), __hi=following(ref)).df.filter("__side = 1")
    d_lo, d_hi = F.col("__x") - F.col("__lo.x"), F.col("__hi.x") - F.col("__x")
    pick_lo = d_hi.isNull() | (d_lo <= d_hi)
    best = F.when(pick_lo, F.col("__lo")).otherwise(F.col("__hi"))
    out = near.withColumn("__b", best).withColumn("distance_m", F.abs(F.col("__x") - F.col("__b.x")))
    return out.select(
        *lcols,
        F.col(f"__b.r.{right_id}").alias(right_id),
        *[F.col(f"__b.r.{c}").alias(c) for c in payload],
        F.coalesce("distance_m", F.lit(float("inf"))).alias("distance_m"),
    )


def nearest_distance(series: Series, x: str, is_reference: Column) -> DataFrame:
    """Distance of every row to the nearest reference row of its key, on an ordered axis."""
    ref = F.when(is_reference, F.col(x))
    near = series.running(__lo=latest(ref), __hi=following(ref)).df
    return near.withColumn("distance", F.least(F.col(x) - F.col("__lo"), F.col("__hi") - F.col(x))).drop("__lo", "__hi")


#: Rows of one side that a block may hold before it is split.
CROWDED_ROWS = 20_000


def band_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_x: str, right_x: str, tolerance: float, crowded_rows: int = CROWDED_ROWS) -> DataFrame:
    """All pairs of equal keys with ``abs(left_x - right_x) <= tolerance``.

    Positions fall into blocks of the tolerance; the right side is copied to the
    two blocks next to its own, which turns the range condition into an equi-join.
    A count finds the blocks that hold more than ``crowded_rows`` of a side; these
    are split into groups of that many rows of each side, and every group of one
    side meets every group of the other in a task of its own.
    """
    keys = list(keys)
    l = left.withColumn("__b", F.floor(F.col(left_x) / tolerance).cast("long"))
    r = right.withColumn("__b0", F.floor(F.col(right_x) / tolerance).cast("long")).withColumn(
        "__b", F.explode(F.array(F.col("__b0") - 1, F.col("__b0"), F.col("__b0") + 1))
    ).drop("__b0")
    l, r = _split_crowded(l, r, [*keys, "__b"], left.columns, right.columns, crowded_rows)
    pairs = l.join(r, [*keys, "__b", "__lg", "__rg"]).filter(F.abs(F.col(left_x) - F.col(right_x)) <= tolerance)
    return pairs.drop("__b", "__lg", "__rg")


def _split_crowded(l: DataFrame, r: DataFrame, on: list[str], l_columns: Sequence[str], r_columns: Sequence[str], crowded_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their group numbers ``__lg`` and ``__rg``: 0 in common blocks, all pairs of groups in crowded ones."""
    count = lambda df, name: df.groupBy(*on).agg(F.count(F.lit(1)).alias(name))
    # one row per crowded block, at most one for each crowded_rows rows
    sizes = cut(
        count(l, "__ln").join(count(r, "__rn"), on).filter(F.greatest("__ln", "__rn") > crowded_rows)
        .select(*on, F.ceil(F.col("__ln") / crowded_rows).cast("int").alias("__lm"), F.ceil(F.col("__rn") / crowded_rows).cast("int").alias("__rm"))
    )
    if sizes.isEmpty():
        zero = {"__lg": F.lit(0), "__rg": F.lit(0)}
        return l.withColumns(zero), r.withColumns(zero)

    def grouped(df: DataFrame, columns: Sequence[str], own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        marked = df.join(sizes, on, "left")
        hashed = F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.coalesce(own_n, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other_n, F.lit(1)) - 1))
        return marked.withColumn(own, hashed).withColumn(other, every).drop("__lm", "__rm")

    return grouped(l, l_columns, "__lg", "__lm", "__rg", "__rm"), grouped(r, r_columns, "__rg", "__rm", "__lg", "__lm")


def interval_rows(rows: DataFrame, intervals: DataFrame, keys: Sequence[str], x: str, lo: str, hi: str, block: float) -> DataFrame:
    """Rows inside intervals of the same key (both ends included), one row per hit.

    Intervals are copied to each block they touch, so a long interval spreads
    over many tasks and rows meet only the intervals of their own block.
    """
    blocks = F.sequence(F.floor(F.col(lo) / block).cast("long"), F.floor(F.col(hi) / block).cast("long"))
    spread = intervals.withColumn("__b", F.explode(blocks))
    hit = rows.withColumn("__b", F.floor(F.col(x) / block).cast("long")).join(spread, [*keys, "__b"])
    return hit.filter(F.col(x).between(F.col(lo), F.col(hi))).drop("__b")


def greedy_match(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_x: str,
    right_x: str,
    left_id: str,
    right_id: str,
    tolerance: float,
    payload: Sequence[str] = (),
    small_rows: int = SMALL_KEY_ROWS,
) -> DataFrame:
    """Closest pairs first, every left and right row used at most once.

    Equal to walking all pairs within the tolerance in the order (distance,
    left id, right id). On a line the next pair to take is always two
    neighbouring positions that are each other's nearest, so each round takes all
    such pairs at once and drops rows that can no longer reach a partner; no pair
    list is built. Rows at one position act together and pair off in id order.

    A key falls into stretches, which a gap wider than the tolerance ends. Those of
    at most ``small_rows`` rows are walked instead, many in a group, which saves the
    rounds; crowded stretches share the rounds.
    """
    keys, payload = list(keys), list(payload)
    l = left.select(*keys, F.col(left_x).cast("double").alias("__x"), F.lit(0).alias("__kind"), F.struct(F.col(left_id)).alias("__id0"))
    r = right.select(
        *keys, F.col(right_x).cast("double").alias("__x"), F.lit(1).alias("__kind"),
        F.struct(F.col(right_id), *[F.col(c) for c in payload]).alias("__id1"),
    )
    both = l.unionByName(r, allowMissingColumns=True).filter("__x is not null")
    series = order_rows(
        both, keys, [F.col("__x"), F.col("__kind"), F.col(f"__id0.{left_id}"), F.col(f"__id1.{right_id}")], idx="__i"
    )
    # a gap wider than the tolerance ends a stretch: no pair crosses it, so stretches are matched each by itself
    near = series.running(__px=before(F.col("__x")))
    apart = (F.col("__x") - F.col("__px") > tolerance).cast("long")
    rest, taken = cut(near.running(__st=total(F.coalesce(apart, F.lit(0)))).df.drop("__px")), []
    own, keys = list(keys), [*keys, "__st"]
    sizes = rest.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__kind").alias("__k0"), F.max("__kind").alias("__k1")).filter("__k0 <> __k1")
    sizes = cut(sizes.select(*keys, "__n"))
    if small_rows:
        small = sizes.filter(F.col("__n") <= small_rows)
        groups = 1 + int(small.agg(F.sum("__n")).first()[0] or 0) // WALK_ROWS
        few = rest.join(small.select(*keys), keys, "left_semi")
        taken.append(cut(_match_small(few, keys, left_id, right_id, tolerance, groups)))
    rest = rest.join(sizes.filter(F.col("__n") > small_rows), keys, "left_semi")
    crowded = not rest.isEmpty()
    while crowded:
        heads = rest.groupBy(*keys, "__x", "__kind").agg(
            F.min("__i").alias("__first"), F.count(F.lit(1)).alias("__m"),
            F.min(F.col(f"__id0.{left_id}")).alias("__h0"), F.min(F.col(f"__id1.{right_id}")).alias("__h1"),
        )
        place = F.struct("__x", F.col("__first").alias("f"), F.col("__m").alias("m"), F.col("__h0").alias("h0"), F.col("__h1").alias("h1"))
        sides = Series(heads, tuple(keys), "__first", series.longest, series.chunk_rows).running(
            __l0=earlier(F.when(F.col("__kind") == 0, place)), __l1=earlier(F.when(F.col("__kind") == 1, place)),
            __r0=later(F.when(F.col("__kind") == 0, place)), __r1=later(F.when(F.col("__kind") == 1, place)),
        ).df
        is_left = F.col("__kind") == 0
        lo = F.when(is_left, F.col("__l1")).otherwise(F.col("__l0"))
        hi = F.when(is_left, F.col("__r1")).otherwise(F.col("__r0"))
        sides = sides.withColumn("__lo", lo).withColumn("__hi", hi)
        d_lo, d_hi = F.col("__x") - F.col("__lo.__x"), F.col("__hi.__x") - F.col("__x")
        tie = F.coalesce(d_lo == d_hi, F.lit(False))
        head_lo_first = F.when(is_left, F.col("__lo.h1") < F.col("__hi.h1")).otherwise(F.col("__lo.h0") < F.col("__hi.h0"))
        use_lo = d_hi.isNull() | (d_lo < d_hi) | (tie & head_lo_first)
        best = F.when(use_lo, F.col("__lo")).otherwise(F.col("__hi"))
        reach = F.when(use_lo, d_lo).otherwise(d_hi)
        choice = cut(
            sides.select(
                *keys, "__x", "__kind", "__first", "__m", "__h0", "__h1", tie.alias("__tie"), best["f"].alias("__best"), reach.alias("__d"),
                F.when(tie, F.array(F.col("__lo.f"), F.col("__hi.f"))).otherwise(F.array(best["f"])).alias("__all"),
            ).filter(F.col("__d") <= tolerance)
        )
        assigned = _arenas(choice, keys)
        # rows keep their place in the original order; their rank at a position follows from it
        alive = rest.join(choice.select(*keys, "__x", "__kind", "__first"), [*keys, "__x", "__kind"])
        seated = alive.join(assigned, [*keys, "__first"]).withColumn("__k", F.col("__i") - F.col("__first"))
        if not assigned.filter("__mixed").isEmpty():
            seated = cut(seated)
            mixed = seated.filter("__mixed")
            by_id = [F.col(f"__id0.{left_id}"), F.col(f"__id1.{right_id}")]
            ranked = order_rows(mixed.drop("__k"), [*keys, "__arena", "__kind"], by_id, idx="__k").df
            seated = seated.filter("not __mixed").unionByName(ranked)
        seated = seated.filter("__k < __take")
        on = [*keys, "__arena", "__k"]
        la = seated.filter("__kind = 0").select(*on, "__id0", F.col("__i").alias("__ia"), F.col("__x").alias("__xa"))
        rb = seated.filter("__kind = 1").select(*on, "__id1", F.col("__i").alias("__ib"), F.col("__x").alias("__xb"))
        pairs = cut(la.join(rb, on).select(*keys, "__id0", "__id1", "__ia", "__ib", F.abs(F.col("__xa") - F.col("__xb")).alias("__d")))
        if pairs.isEmpty():
            break
        taken.append(pairs)
        used = pairs.select(*keys, F.col("__ia").alias("__i")).unionByName(pairs.select(*keys, F.col("__ib").alias("__i")))
        rest = cut(alive.select(*rest.columns).join(used, [*keys, "__i"], "left_anti"))
    taken = taken or [pairs]
    matched = reduce(DataFrame.unionByName, [t.select(*own, "__id0", "__id1", "__d") for t in taken])
    return matched.select(
        *own,
        F.col(f"__id0.{left_id}").alias(left_id),
        F.col(f"__id1.{right_id}").alias(right_id),
        *[F.col(f"__id1.{c}").alias(c) for c in payload],
        F.col("__d").alias("distance_m"),
    )


def _match_small(rows: DataFrame, keys: list[str], left_id: str, right_id: str, tolerance: float, groups: int) -> DataFrame:
    """Greedy pairs of stretches with few rows; a group has many stretches, all of whose rows come together."""
    flat = rows.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("__g"), "__i", "__kind", "__x", F.col(f"__id0.{left_id}").alias("__l"), F.col(f"__id1.{right_id}").alias("__r"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", __ia long, __ib long, __d double"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["__s"] = pdf.groupby(keys, dropna=False, sort=False).ngroup()
        left, right = pdf[pdf["__kind"] == 0].sort_values(["__s", "__l"]), pdf[pdf["__kind"] == 1].sort_values(["__s", "__r"])
        ends = np.arange(pdf["__s"].max() + 2)
        cut_l, cut_r = np.searchsorted(left["__s"], ends), np.searchsorted(right["__s"], ends)
        at_l, at_r = left["__x"].to_numpy(), right["__x"].to_numpy()
        got_l, got_r, got_d = [], [], []
        for l0, l1, r0, r1 in zip(cut_l, cut_l[1:], cut_r, cut_r[1:]):
            gaps = np.abs(at_l[l0:l1, None] - at_r[None, r0:r1])
            i, j = np.nonzero(gaps <= tolerance)
            d = gaps[i, j]
            free_l, free_r = np.ones(l1 - l0, bool), np.ones(r1 - r0, bool)
            for n in np.lexsort((j, i, d)):
                if free_l[i[n]] and free_r[j[n]]:
                    free_l[i[n]] = free_r[j[n]] = False
                    got_l.append(l0 + i[n]), got_r.append(r0 + j[n]), got_d.append(d[n])
        out = left.iloc[got_l][[*keys, "__i"]].rename(columns={"__i": "__ia"}).reset_index(drop=True)
        out["__ib"], out["__d"] = right["__i"].to_numpy()[got_r], np.asarray(got_d, float)
        return out

    pairs = flat.groupBy("__g").applyInPandas(walk, schema)
    a = rows.filter("__kind = 0").select(*keys, F.col("__i").alias("__ia"), "__id0")
    b = rows.filter("__kind = 1").select(*keys, F.col("__i").alias("__ib"), "__id1")
    return pairs.join(a, [*keys, "__ia"]).join(b, [*keys, "__ib"]).select(*keys, "__id0", "__id1", "__d")


def _arenas(choice: DataFrame, keys: list[str]) -> DataFrame:
    """Which positions pair off together in this round, and how many rows each may give.

    - Two positions that are each other's only nearest: all rows, in id order.
    - A position exactly halfway between two positions that both want it alone:
      the rows of the two sides are mixed by id against the middle.
    - Longer chains of equal distances between single rows: all pairs that the walk
      would take, see ``_chains``.
    - Other chains: the two smallest ids, one pair a round.
    """
    a = choice.filter("__kind = 0").select(
        *keys, F.col("__first").alias("__fa"), F.explode("__all").alias("__fb"), F.col("__best").alias("__ba"), F.col("__tie").alias("__ta"),
        F.col("__m").alias("__ma"), "__h0",
    )
    b = choice.filter("__kind = 1").select(
        *keys, F.col("__first").alias("__fb"), F.explode("__all").alias("__fa"), F.col("__best").alias("__bb"), F.col("__tie").alias("__tb"),
        F.col("__m").alias("__mb"), "__h1",
    )
    edges = _chains(cut(a.join(b, [*keys, "__fa", "__fb"])), keys)
    # a position has at most two nearest positions, so these counts are 1 or 2
    leaf_a, leaf_b = ~F.col("__ta"), ~F.col("__tb")
    edges = edges.withColumn(
        "__na", F.count(F.when(leaf_b, 1)).over(Window.partitionBy(*keys, "__fa"))
    ).withColumn("__nb", F.count(F.when(leaf_a, 1)).over(Window.partitionBy(*keys, "__fb")))
    plain = leaf_a & leaf_b
    star_b = F.col("__tb") & leaf_a & (F.col("__nb") == 2)
    star_a = F.col("__ta") & leaf_b & (F.col("__na") == 2)
    heads = (F.col("__ba") == F.col("__fb")) & (F.col("__bb") == F.col("__fa"))
    whole = F.lit(1 << 62)
    star_a, star_b = star_a & ~F.col("__single"), star_b & ~F.col("__single")
    take = F.when(F.col("__single"), F.when(F.col("__walked"), F.lit(1))).when(plain | star_a | star_b, whole).when(heads, F.lit(1))
    edges = edges.withColumn("__take", take.cast("long")).filter("__take is not null")
    edges = edges.withColumn("__arena", F.when(star_a, F.col("__fa")).otherwise(F.col("__fb")))
    left = edges.select(*keys, F.col("__fa").alias("__first"), "__arena", "__take", star_b.alias("__mixed"))
    right = edges.select(*keys, F.col("__fb").alias("__first"), "__arena", "__take", star_a.alias("__mixed"))
    return left.unionByName(right).distinct()


def _chains(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Marks edges of chains of single rows (``__single``) and which of them the walk takes (``__walked``).

    Edges of a chain have one distance, so the walk takes them by (left id, right
    id). A smallest edge among its neighbours is taken; going up from it every second
    one is, as each is free unless the one below it was taken; an edge above both its
    neighbours needs both to be untaken. So an edge is taken if it stands an even
    number of steps above the smallest edge on either side. A chain counts only if
    all its positions have one row and no tie of theirs leads out of it.
    """
    lo, hi = F.least("__fa", "__fb"), F.greatest("__fa", "__fb")
    per_a, per_b = Window.partitionBy(*keys, "__fa"), Window.partitionBy(*keys, "__fb")
    closed = (~F.col("__ta") | (F.count(F.lit(1)).over(per_a) == 2)) & (~F.col("__tb") | (F.count(F.lit(1)).over(per_b) == 2))
    marked = edges.withColumn("__ok", closed & (F.col("__ma") == 1) & (F.col("__mb") == 1)).withColumn("__lo", lo).withColumn("__hi", hi)
    line = order_rows(marked, keys, ["__lo", "__hi"], idx="__e")
    rank = F.struct("__h0", "__h1")
    near = line.running(__ph=before(F.col("__hi")), __pr=before(rank), __nl=after(F.col("__lo")), __nr=after(rank))
    joined = F.coalesce(F.col("__ph") == F.col("__lo"), F.lit(False))
    up = joined & (rank > F.col("__pr"))
    down = F.coalesce(F.col("__nl") == F.col("__hi"), F.lit(False)) & (rank > F.col("__nr"))
    steps = near.running(__chain=total((~joined).cast("long")), __from=latest(F.when(~up, F.col("__e"))), __to=following(F.when(~down, F.col("__e"))))
    rows = cut(steps.df)
    whole = rows.groupBy(*keys, "__chain").agg(F.min("__ok").alias("__single"))
    even = lambda n: F.pmod(n, F.lit(2)) == 0
    out = rows.join(whole, [*keys, "__chain"]).withColumn("__walked", even(F.col("__e") - F.col("__from")) & even(F.col("__to") - F.col("__e")))
    return out.select(*edges.columns, "__single", "__walked")


def match_all(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_x: str, right_x: str, left_id: str, right_id: str,
    tolerance: float, payload: Sequence[str] = (),
) -> DataFrame:
    """Every left row with its one-to-one partner, or NULL and infinity without one."""
    m = greedy_match(left, right, keys, left_x, right_x, left_id, right_id, tolerance, payload)
    out = left.join(m, [*keys, left_id], "left")
    return out.withColumn("distance_m", F.coalesce("distance_m", F.lit(float("inf"))))


def per_survey_sources(registry: DataFrame, surveys: DataFrame, line: str, survey: str) -> DataFrame:
    """The registry of its line repeated for every survey: sources are claimed once per survey."""
    return surveys.select(line, survey).distinct().join(registry, line)


def attach_peak_rows(indications: DataFrame, rows: DataFrame, columns: Sequence[str], survey: str = "survey_id", idx: str = "sample_idx") -> DataFrame:
    """Feature values of the peak row, joined on the integer position, and the extent."""
    picked = rows.select(survey, F.col(idx).alias("peak_sample_idx"), *columns)
    return indications.join(picked, [survey, "peak_sample_idx"], "left").withColumn(
        "extent_m", F.col("chainage_end_m") - F.col("chainage_start_m")
    )


def attach_truth(indications: DataFrame, rows: DataFrame, truth: str, survey: str = "survey_id", idx: str = "sample_idx") -> tuple[DataFrame, DataFrame]:
    """Indications with a known truth at the peak, and the count of those dropped for lack of one."""
    joined = indications.join(rows.select(survey, F.col(idx).alias("peak_sample_idx"), truth), [survey, "peak_sample_idx"], "left")
    dropped = joined.agg(F.count_if(F.col(truth).isNull()).alias("n_dropped"))
    return joined.filter(F.col(truth).isNotNull()), dropped


def first_seen(
    events: DataFrame, seen: DataFrame, keys: Sequence[str], event_x: str, seen_x: str, event_id: str,
    event_time: str, seen_time: str, tolerance: float,
) -> DataFrame:
    """Per event: the earliest earlier sighting on the same key within the tolerance.

    Sightings are first reduced to the earliest time per position, so repeated
    sightings of one place meet an event once.
    """
    earliest = seen.groupBy(*keys, seen_x).agg(F.min(seen_time).alias(seen_time))
    pairs = band_pairs(earliest, events, keys, seen_x, event_x, tolerance)
    pairs = pairs.filter(F.col(seen_time) <= F.col(event_time))
    return pairs.groupBy(*keys, event_id, event_time).agg(F.min(seen_time).alias("first_seen"))


def pair_values(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Values of two methods on the same units; a unit on one side only is an error."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), key, "full").withColumn(
        "a", F.coalesce("a", F.raise_error(F.lit("unit missing on the left")).cast("double"))
    ).withColumn("b", F.coalesce("b", F.raise_error(F.lit("unit missing on the right")).cast("double")))
