"""Evaluation: hit rates, average precision, bootstrap intervals, calibration, splits."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from fractions import Fraction
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import hash_fold, safe_div
from ..session import cut
from .ordered import cumulate, order_rows
from .quantiles import quantiles


def hit_rates(matches: DataFrame, registry: DataFrame, runs: DataFrame, line: str, run: str, source: str, kind: str = "defect") -> DataFrame:
    """Per source: the share of its own line's runs in which it was matched."""
    n_runs = runs.select(line, run).distinct().groupBy(line).agg(F.count(F.lit(1)).alias("n_runs"))
    hits = matches.select(run, source).filter(F.col(source).isNotNull()).distinct().join(
        registry.select(source, line), source).join(runs.select(line, run).distinct(), [line, run], "left_semi")
    hits = hits.groupBy(source).agg(F.count(F.lit(1)).alias("n_hit"))
    wanted = registry.filter(F.col("kind") == kind).select(source, line)
    return wanted.join(n_runs, line).join(hits, source, "left").select(
        source, line, "n_runs", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        (F.coalesce("n_hit", F.lit(0)) / F.col("n_runs")).alias("hit_rate"),
    )


def dig_rates(matched: DataFrame, runs: DataFrame, run: str, kind: str) -> DataFrame:
    """Per run: share of digs that hit no defect, and share that hit interference; 0 without digs."""
    k = F.col(kind)
    rates = matched.groupBy(run).agg(
        F.avg(F.coalesce(k != "defect", F.lit(True)).cast("double")).alias("false_dig_rate"),
        F.avg(F.coalesce(k == "interference", F.lit(False)).cast("double")).alias("interference_fraction"),
    )
    return runs.select(run).distinct().join(rates, run, "left").select(
        run, F.coalesce("false_dig_rate", F.lit(0.0)).alias("false_dig_rate"),
        F.coalesce("interference_fraction", F.lit(0.0)).alias("interference_fraction"),
    )


def localisation_errors(matched: DataFrame, kind: str = "matched_kind", distance: str = "distance_m") -> DataFrame:
    return matched.filter(F.col(kind) == "defect").withColumn("error_cm", F.col(distance) * 100.0)


def average_precision(df: DataFrame, keys: Sequence[str], truth: Column, score: str) -> DataFrame:
    """Step-wise area under precision and recall per key; equal scores are one threshold, one class only gives NULL."""
    rows = df.select(*keys, F.col(score).cast("double").alias("__s"), truth.cast("long").alias("__y"))
    steps = cumulate(rows, keys, "__s", {"tp": F.col("__y"), "n": F.lit(1)}, descending=True).df
    got = steps.groupBy(*keys).agg(
        F.sum(F.col("tp") * F.col("cum_tp") / F.col("cum_n")).alias("__a"), F.sum("tp").alias("n_pos"), F.sum("n").alias("n_all")
    )
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n_all"))
    return got.select(*keys, F.when(both, F.col("__a") / F.col("n_pos")).alias("average_precision"), "n_pos", "n_all")


def bootstrap(
    units: DataFrame, keys: Sequence[str], unit: str, values: Sequence[str], resamples: int, level: float, seed: int,
    statistic: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """Percentile interval of a statistic of each value column, per key.

    Every (replicate, unit) pair gets a Poisson(1) weight read from a sha256 of its own,
    which any engine repeats, so replicates need no draw table and units may sit
    anywhere. A unit's rows of all keys lie together and share its draws; a crowded
    unit is split. The copies of a unit meet the partial aggregate in their own task;
    only one sum per replicate is shuffled. Units are dealt over all tasks first, since
    their size tells little of the work they make.
    ``statistic`` maps (value, weight) column names to an aggregate; the default is
    the weighted mean. Units are physical objects, not readings.
    """
    keys, values = list(keys), list(values)
    stat = statistic or (lambda v, w: safe_div(F.sum(F.col(v) * F.col(w)), F.sum(F.when(F.col(v).isNotNull(), F.col(w)))))
    units = cut(units.select(*dict.fromkeys([*keys, unit, *values])))
    crowd = units.groupBy(unit).count().agg(F.max("count")).first()[0] or 0
    part = F.pmod(F.monotonically_increasing_id(), F.lit(-(-crowd // UNIT_ROWS) or 1))
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = units.select(F.col(unit).alias("__unit"), part.alias("__part"), F.struct(*keys, *values).alias("__row")).repartition(tasks, "__unit", "__part")
    together = dealt.groupBy("__unit", "__part").agg(F.collect_list("__row").alias("__rows"))
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("__unit").cast("string"), F.col("__b").cast("string")), 256)
    reps = together.select("__unit", "__rows", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("__b")).withColumn("__draw", draw)
    reps = reps.select("__rows", "__b", poisson_of_digest(F.col("__draw")).alias("__w"))
    reps = reps.select("__b", "__w", F.explode("__rows").alias("__row")).select("__b", "__w", *[F.col(f"__row.{c}").alias(c) for c in [*keys, *values]])
    per_rep = reps.groupBy(*keys, "__b").agg(*[stat(v, "__w").alias(v) for v in values])
    point = units.withColumn("__w", F.lit(1.0)).groupBy(*keys).agg(*[stat(v, "__w").alias(f"{v}_point") for v in values])
    tail = (1 - level) / 2
    ends = per_rep.groupBy(*keys).agg(*[F.percentile(v, F.array(F.lit(tail), F.lit(1 - tail))).alias(f"__q_{v}") for v in values])
    out = point.join(ends, keys) if keys else point.crossJoin(F.broadcast(ends))
    return out.select(
        *keys, *[c for v in values for c in (F.col(f"{v}_point"), F.col(f"__q_{v}")[0].alias(f"{v}_lo"), F.col(f"__q_{v}")[1].alias(f"{v}_hi"))]
    )


#: Rows of a unit that share a draw's digest; a unit with more is split.
UNIT_ROWS = 1000

#: P(count <= k) of Poisson(1) for k = 0, 1, 2, …
POISSON_STEPS = list(accumulate(math.exp(-1) / math.factorial(k) for k in range(12)))


def poisson_one(u: Column) -> Column:
    """Poisson(1) count of a uniform number, by its cumulative probabilities."""
    out = F.lit(0.0)
    for total in POISSON_STEPS:
        out = out + (u >= total).cast("double")
    return out


def poisson_of_digest(digest: Column) -> Column:
    """The same of the first 52 bits of a hexadecimal digest.

    Digits in lower case compare as their numbers do, so the steps are compared as
    text; one that rounds to 1 is never reached.
    """
    steps = [math.ceil(Fraction(p) * (1 << 52)) for p in POISSON_STEPS]
    out = F.when(digest < F.lit(f"{steps[0]:013x}"), F.lit(0.0))
    for k, step in enumerate(steps[1:], 1):
        if step < 1 << 52:
            out = out.when(digest < F.lit(f"{step:013x}"), F.lit(float(k)))
    return out.otherwise(F.lit(float(sum(step < 1 << 52 for step in steps))))


def paired_bootstrap(pairs: DataFrame, keys: Sequence[str], unit: str, a: str, b: str, resamples: int, level: float, seed: int) -> DataFrame:
    """Interval of mean(a) - mean(b) with the same weights on both; a missing side is an error."""
    whole = pairs.withColumn("delta", F.coalesce(F.col(a) - F.col(b), F.raise_error(F.lit("unpaired unit")).cast("double")))
    return bootstrap(whole, keys, unit, ["delta"], resamples, level, seed)


def bin_by_quantiles(df: DataFrame, keys: Sequence[str], value: str, bins: int, longest: int | None = None) -> DataFrame:
    """Adds ``bin``: 0-based quantile bin, right-closed with the lowest value included, equal edges merged.

    With fewer distinct values than bins there are only as many bins as values.

    The quantiles for every number of bins up to ``bins`` come from the same two
    passes. The values at their ranks tell most keys that have at least as many values
    as bins; only the others' values are counted.
    """
    keys = list(keys)
    parts = sorted({Fraction(i, d) for d in range(1, bins + 1) for i in range(d + 1)})
    names = {p: f"__e{i}" for i, p in enumerate(parts)}
    q = cut(quantiles(df, keys, value, {names[p]: float(p) for p in parts}, longest, seen="__seen"))
    unsure = q.filter(F.col("__seen") < bins)
    if unsure.isEmpty():
        sized = q.withColumn("__d", F.lit(bins))
    else:
        rows = df.join(unsure.select(*keys), keys, "left_semi") if keys else df
        distinct = rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.lit(1).alias("__1"))
        distinct = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d"))
        sized = q.join(distinct, keys, "left") if keys else q.crossJoin(F.broadcast(distinct))
        sized = sized.withColumn("__d", F.least(F.coalesce("__d", F.lit(bins)), F.lit(bins)).cast("int"))
    options = F.array(*[F.array(*[F.col(names[Fraction(i, d)]) for i in range(d + 1)]) for d in range(1, bins + 1)])
    edges = sized.select(*keys, F.element_at(options, F.col("__d")).alias("edges"))
    joined = df.join(edges, keys) if keys else df.crossJoin(F.broadcast(edges))
    cuts = F.array_distinct("edges")
    inner = F.slice(cuts, F.lit(2), F.greatest(F.lit(0), F.size(cuts) - 2))
    return joined.withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(value))).cast("long")).drop("edges")


def error_by_quantile(df: DataFrame, truth: str, predicted: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    binned = bin_by_quantiles(df, keys, truth, bins)
    return binned.groupBy(*keys, "bin").agg(F.avg(F.abs(F.col(truth) - F.col(predicted))).alias("mae"), F.count(F.lit(1)).alias("n"))


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    binned = bin_by_quantiles(df, keys, confidence, bins)
    return binned.groupBy(*keys, "bin").agg(
        F.avg(confidence).alias("bin_mean_confidence"), F.avg(F.col(correct).cast("double")).alias("bin_accuracy"), F.count(F.lit(1)).alias("n")
    )


def group_interval_metrics(df: DataFrame, group: str, y: str, pred: str, lo: str, hi: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("coverage"),
        F.avg(F.abs(F.col(y) - F.col(pred))).alias("mae"),
        F.avg(F.col(hi) - F.col(lo)).alias("interval_width"),
    )


def class_recall_units(df: DataFrame, group: str, order: str, true: str, pred: str) -> DataFrame:
    """Per source: its class (first row) and the share of its rows predicted so."""
    first = df.groupBy(group).agg(F.min_by(true, order).alias("true_class"))
    return df.join(first, group).groupBy(group, "true_class").agg(F.avg((F.col(pred) == F.col("true_class")).cast("double")).alias("recall"))


def class_precision_units(df: DataFrame, group: str, true: str, pred: str, klass: str) -> DataFrame:
    return df.filter(F.col(pred) == klass).groupBy(group).agg(F.avg((F.col(true) == klass).cast("double")).alias("precision"))


def brier(df: DataFrame, keys: Sequence[str], true: str, probabilities: str, classes: Sequence[str]) -> DataFrame:
    """Mean squared distance between the probability array and the one-hot truth."""
    hot = F.array(*[(F.col(true) == c).cast("double") for c in classes])
    sq = F.aggregate(F.zip_with(probabilities, hot, lambda p, o: (p - o) * (p - o)), F.lit(0.0), lambda a, x: a + x)
    return df.groupBy(*keys).agg(F.avg(sq).alias("brier"), F.count(F.lit(1)).alias("n"))


def coverage_vs_nominal(df: DataFrame, y: str, lo: str, hi: str, nominal: float, keys: Sequence[str] = ()) -> DataFrame:
    got = df.groupBy(*keys).agg(F.avg(F.col(y).between(F.col(lo), F.col(hi)).cast("double")).alias("empirical"), F.count(y).alias("n"))
    return got.select(
        *keys, "empirical", F.lit(nominal).alias("nominal"), "n", F.coalesce(F.col("empirical") < nominal, F.lit(False)).alias("below_nominal")
    )


def absolute_error_summary(df: DataFrame, keys: Sequence[str], a: str, b: str, longest: int | None = None) -> DataFrame:
    """Median, 90th percentile and maximum of |a-b|, the median also in cm."""
    err = F.abs(F.col(a) - F.col(b))
    q = quantiles(df, keys, err, {"median_abs_error_m": 0.5, "p90_abs_error_m": 0.9, "max_abs_error_m": 1.0}, longest)
    return q.withColumn("median_abs_error_cm", F.col("median_abs_error_m") * 100.0)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str) -> DataFrame:
    """Rank of each distinct value, ties sharing the mean of their places."""
    steps = cumulate(df, keys, value, {"n": F.lit(1)}).df
    return steps.select(*keys, value, (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias(rank))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    keys = list(keys)
    base = df.select(*keys, x, y).dropna()
    ranked = base.join(average_ranks(base, keys, x, "__rx"), [*keys, x]).join(average_ranks(base, keys, y, "__ry"), [*keys, y])
    return ranked.groupBy(*keys).agg(F.corr("__rx", "__ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def with_fold(df: DataFrame, key: Column, folds: int) -> DataFrame:
    return df.withColumn("group_key", key).withColumn("fold", hash_fold(F.col("group_key"), folds))


def temporal_holdout(df: DataFrame, run: str, train_runs: Sequence[int], test_runs: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(run).isin(list(train_runs))), df.filter(F.col(run).isin(list(test_runs)))


def line_halves(df: DataFrame, line: str) -> DataFrame:
    """First and second half of the lines in id order, as ``train`` and ``test``."""
    lines = order_rows(df.select(line).distinct().withColumn("__one", F.lit(1)), ["__one"], [line], idx="__i").df
    n = lines.agg(F.count(F.lit(1)).alias("__n"))
    split = lines.crossJoin(F.broadcast(n)).select(line, F.when(F.col("__i") < F.floor(F.col("__n") / 2), "train").otherwise("test").alias("half"))
    return df.join(split, line)


def calibration_split(groups: DataFrame, group: str, frac: float, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """Marks whole groups as calibration: ``max(1, round(frac*n))`` of them, none if there is only one.

    ``by`` repeats the choice inside each class. Groups are taken in the order of a sha256, which any engine repeats.
    """
    by = list(by)
    distinct = groups.select(*by, group).distinct().withColumn("__one", F.lit(1))
    keys = [*by, "__one"]
    ordered = order_rows(distinct, keys, [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")), 256), F.col(group)], idx="__i").df
    sizes = distinct.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    k = F.when(F.col("__n") > 1, F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(frac)).cast("long"))).otherwise(0)
    return ordered.join(sizes, keys).select(*by, group, (F.col("__i") < k).alias("calibration"))


def examples_per_class(df: DataFrame, klass: str, order: str) -> DataFrame:
    cols = [c for c in df.columns if c != klass]
    return df.groupBy(klass).agg(F.min_by(F.struct(*cols), order).alias("__r")).select(klass, "__r.*")


def classes_covered(train: DataFrame, calibration: DataFrame, klass: str) -> DataFrame:
    """Whether every class seen in training also occurs in calibration."""
    missing = train.select(klass).distinct().join(calibration.select(klass).distinct(), klass, "left_anti")
    return missing.filter(F.col(klass).isNotNull()).agg((F.count(F.lit(1)) == 0).alias("covered"))


def gate_lower_bound(ci: DataFrame, lo: str, minimum: float) -> DataFrame:
    return ci.withColumn("passed", F.col(lo) >= minimum)


def gate_between(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    return df.withColumn("passed", F.col(value).between(lo, hi))


def top_features_allowed(importance: DataFrame, feature: str, value: str, forbidden: Sequence[str], top: int = 10) -> DataFrame:
    """Forbidden columns among the most important ones; none means passed."""
    best = importance.orderBy(F.col(value).desc(), feature).limit(top)
    return best.agg(
        F.collect_list(F.when(F.col(feature).isin(list(forbidden)), F.col(feature))).alias("offenders")
    ).withColumn("passed", F.size("offenders") == 0)
