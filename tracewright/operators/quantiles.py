"""Exact quantiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, join_keyed

ACCURACY = 100_000
SMALL_GROUP_ROWS = 200_000
#: Parts of a bracket, which are counted before its values are looked at.
SPLITS = 64


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: Mapping[str, float],
    longest: int | None = None,
    accuracy: int = ACCURACY,
    also: Mapping[str, Column] | None = None,
    seen: str | None = None,
) -> DataFrame:
    """One row per key with a column per entry of ``probs`` and the count ``n``.

    Groups known to be small (``longest``) use the built-in exact percentile,
    whose buffer holds the group's distinct values. Otherwise a mergeable sketch
    first brackets every wanted rank, then only the values inside the brackets
    are kept one by one; everything between them is reduced to a count, a
    minimum and a maximum before the shuffle. Null and NaN values are skipped.

    ``also`` names further aggregates of the rows with a value, read in the sketch's
    pass; ``seen`` a column with the number of different values at the wanted ranks,
    which the key has at least. The table is read twice.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys, names, wanted = list(keys), list(probs), [float(p) for p in probs.values()]
    v = value.cast("double")
    named = {f"__also_{c}": e for c, e in (also or {}).items()}
    carried = [c for c in df.columns if c not in keys and c != "__v"] if also else []
    vals = df.select(*keys, *carried, F.when(~F.isnan(v), v).alias("__v")).filter("__v is not null")
    extra = [e.alias(c) for c, e in named.items()]
    if longest is not None and longest <= SMALL_GROUP_ROWS:
        agg = vals.groupBy(*keys).agg(
            F.percentile("__v", F.array(*[F.lit(p) for p in wanted])).alias("__q"), F.count("__v").alias("n"), *extra,
            *([F.count_distinct("__v").cast("int").alias("__also_" + seen)] if seen else []),
        )
        named |= {f"__also_{seen}": None} if seen else {}
        return agg.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)], "n", *[F.col(c).alias(c.removeprefix("__also_")) for c in named])

    got = _select_ranks(vals, keys, wanted, accuracy, extra)
    out = []
    for k, (name, p) in enumerate(zip(names, wanted)):
        h = _rank(F.col("n"), p)
        a, b = F.col("__a")[2 * k], F.col("__a")[2 * k + 1]
        out.append(F.when(a == b, a).otherwise(a + (b - a) * (h - F.floor(h))).alias(name))
    values = [F.size(F.array_distinct("__a")).alias(seen)] if seen else []
    return got.select(*keys, *out, "n", *[F.col(c).alias(c.removeprefix("__also_")) for c in named], *values)


def _rank(n: Column, p: float) -> Column:
    return (n - 1) * F.lit(p)


def _cells(vals: DataFrame, keys: list[str], wanted: list[float], accuracy: int, extra: Sequence[Column] = (), splits: int = SPLITS) -> DataFrame:
    """Counts of single values inside the brackets, and of everything between two of them.

    ``__p`` is a place that grows with the value: a value belongs to the last bracket
    that starts at or below it. Inside, the bracket's span is cut into equal parts;
    what lies behind it comes last. Every cell has the count and the further
    aggregates of its key.
    """
    slack, ranks = 3.0 / accuracy, sorted(set(wanted))
    ends = [max(0.0, p - slack) for p in ranks] + [min(1.0, p + slack) for p in ranks]
    sketch = vals.groupBy(*keys).agg(F.percentile_approx("__v", ends, accuracy).alias("__ends"), F.count("__v").alias("n"), *extra)
    halves = [F.slice("__ends", 1, len(ranks)).alias("__lows"), F.slice("__ends", len(ranks) + 1, len(ranks)).alias("__highs")]
    told = _told(sketch)
    side = sketch.select(*keys, *told, *halves)
    marked = join_keyed(vals.select(*keys, "__v"), side, keys)
    # how many brackets start at or below the value, by halving: compiled code, which a function of arrays is not
    marked = marked.withColumn("__b", F.lit(0))
    for k in reversed(range(len(ranks).bit_length())):
        further = F.col("__v") >= F.get("__lows", F.col("__b") + ((1 << k) - 1))
        marked = marked.withColumn("__b", F.col("__b") + F.when(further, 1 << k).otherwise(0))
    marked = marked.select(*keys, *told, "__v", "__b", F.get("__lows", F.col("__b") - 1).alias("__lo"), F.get("__highs", F.col("__b") - 1).alias("__hi"))
    inside = (F.col("__b") > 0) & (F.col("__v") <= F.col("__hi"))
    # halves, so that the span of the largest numbers is finite; spans without a finite width are one part
    lo, width = F.col("__lo") / 2, F.col("__hi") / 2 - F.col("__lo") / 2
    at = F.when((width > 0) & (width < F.lit(float("inf"))), F.floor((F.col("__v") / 2 - lo) / width * (splits - 1))).otherwise(0)
    place = (F.col("__b") * (splits + 1) + F.when(inside, at.cast("int")).otherwise(splits)).cast("int")
    placed = marked.select(*keys, *told, "__v", place.alias("__p"), F.when(inside, F.col("__v")).alias("__cell"))
    return placed.groupBy(*keys, "__p", "__cell").agg(
        F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), *[F.max(c).alias(c) for c in told]
    )


def _told(df: DataFrame) -> list[str]:
    """The count and the further aggregates of a key, equal in all its rows."""
    return ["n", *[c for c in df.columns if c.startswith("__also_")]]


def _select_ranks(vals: DataFrame, keys: list[str], wanted: list[float], accuracy: int, extra: Sequence[Column] = (), splits: int = SPLITS) -> DataFrame:
    """Per key its count, further aggregates and ``__a``, the values at the two ranks around each wanted one.

    Cells are added up by place first, of which a key has at most
    (brackets + 1) * (splits + 1), and running counts over these places tell where
    each rank lies. Only the places whose rank isn't an end of theirs are looked
    into, each by itself, so no task holds the cells of a key. The cells are written
    once: three steps read them, and they are few beside the values.
    """
    cells = cut(_cells(vals, keys, wanted, accuracy, extra, splits))
    told = _told(cells)
    places = cells.groupBy(*keys, "__p").agg(
        F.sum("__c").alias("__c"), F.min("__min").alias("__min"), F.max("__max").alias("__max"), *[F.max(c).alias(c) for c in told]
    )
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = places.withColumn("__end", F.sum("__c").over(w) - 1).withColumn("__start", F.col("__end") - F.col("__c") + 1)
    n = F.col("n")
    ranks = F.array(*[r.cast("long") for p in wanted for r in (F.floor(_rank(n, p)), F.ceil(_rank(n, p)))])
    asked = F.filter(F.transform(ranks, lambda r, i: F.struct(i.alias("i"), r.alias("r"))), lambda a: a["r"].between(F.col("__start"), F.col("__end")))
    found = ranked.select(*keys, *told, "__p", "__start", "__end", "__min", "__max", F.explode(asked).alias("__a"))
    at = F.col("__a.r")
    known = F.when(at == F.col("__start"), F.col("__min")).when((at == F.col("__end")) | (F.col("__min") == F.col("__max")), F.col("__max"))
    found = found.select(*keys, *told, "__p", F.col("__a.i").alias("__i"), (at - F.col("__start")).alias("__r"), known.alias("__known"))

    seek = found.filter("__known is null").groupBy(*keys, "__p").agg(F.collect_list(F.struct("__i", "__r")).alias("__asked"))
    own = Window.partitionBy(*keys, "__p").orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    opened = cells.join(seek, [*keys, "__p"]).withColumn("__to", F.sum("__c").over(own) - 1).filter("__cell is not null")
    hit = F.filter("__asked", lambda a: a["__r"].between(F.col("__to") - F.col("__c") + 1, F.col("__to")))
    sought = opened.select(*keys, *told, F.explode(hit).alias("__h"), F.col("__cell").alias("__known")).select(*keys, *told, "__h.__i", "__known")

    every = found.filter("__known is not null").select(*keys, *told, "__i", "__known").unionByName(sought)
    missing = F.raise_error(F.lit("a rank lies outside its bracket"))
    # by the count as well: a table without keys and rows has no group
    got = every.groupBy(*keys, *told).agg(F.array_sort(F.collect_list(F.struct("__i", "__known"))).alias("__a"))
    return got.withColumn("__a", F.when(F.size("__a") == 2 * len(wanted), F.transform("__a", lambda s: s["__known"])).otherwise(missing))


def median_mad(df: DataFrame, keys: Sequence[str], value: Column | str, longest: int | None = None) -> DataFrame:
    """Per key: ``med`` and ``mad`` (median absolute deviation, unscaled), and ``n``."""
    value = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    vals = df.select(*keys, value.cast("double").alias("__x"))
    med = quantiles(vals, keys, "__x", {"med": 0.5}, longest)
    joined = join_keyed(vals, med, keys)
    mad = quantiles(joined, [*keys, "med"], F.abs(F.col("__x") - F.col("med")), {"mad": 0.5}, longest)
    return mad


def quantile_edges(df: DataFrame, keys: Sequence[str], value: str, bins: int, longest: int | None = None, also: Mapping[str, Column] | None = None) -> DataFrame:
    """Per key an array ``edges`` of ``bins+1`` equally spaced quantiles, the count ``n`` and the columns of ``also``."""
    probs = {f"__e{i}": i / bins for i in range(bins + 1)}
    q = quantiles(df, keys, value, probs, longest, also=also)
    return q.select(*keys, F.array(*[F.col(c) for c in probs]).alias("edges"), *[c for c in ("n", *(also or {}))])
