"""Corpus profiles: balance, summary statistics, missingness, correlation, separability, contrast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from .drift import unpivot
from .metrics import average_precision
from .quantiles import median_mad, quantiles


def class_balance(df: DataFrame, klass: str) -> DataFrame:
    counts = df.groupBy(klass).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__t"))
    return counts.crossJoin(F.broadcast(total)).select(klass, "n", (F.col("n") / F.col("__t")).alias("share"))


def sample_skew(x: str) -> Column:
    n = F.count(x)
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1).cast("double")) / F.greatest(n - 2, F.lit(1)))


def sample_kurtosis(x: str) -> Column:
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def summary_stats(df: DataFrame, klass: str, columns: Sequence[str], longest: int | None = None) -> DataFrame:
    """Count, mean, deviation, skew and median per class and feature."""
    long = unpivot(df, columns, [klass])
    moments = long.groupBy(klass, "feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), sample_skew("x").alias("skew")
    )
    med = quantiles(long, [klass, "feature"], "x", {"median": 0.5}, longest).drop("n")
    return moments.join(med, [klass, "feature"])


def missingness(df: DataFrame, klass: str, columns: Sequence[str]) -> DataFrame:
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNull().alias("miss")) for c in columns]))
    long = df.select(klass, items.alias("i")).select(klass, "i.feature", "i.miss")
    return long.groupBy(klass, "feature").agg((F.avg(F.col("miss").cast("double")) * 100.0).alias("missing_pct"))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson r of every column pair, in a single aggregate without a shuffle of rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)
    ]))
    return one.select(rows.alias("p")).select("p.*")


def redundant_pairs(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    return pairs.filter(F.abs("r") >= threshold).orderBy(F.abs("r").desc(), "feature_a", "feature_b")


def separability(df: DataFrame, klass: str, columns: Sequence[str], contrasts: Sequence[tuple[str, str]]) -> DataFrame:
    """Average precision per feature and contrast, taking the better score direction, and the base rate.

    A contrast (a, b) asks how well a is told from b; ``*`` stands for all other classes.
    """
    k = F.col(klass)
    sides = F.array_compact(F.array(*[
        F.when((k == a) | (k == b) if b != "*" else F.lit(True), F.struct(F.lit(f"{a}_vs_{b}").alias("contrast"), (k == a).cast("long").alias("y")))
        for a, b in contrasts
    ]))
    long = unpivot(df.withColumn("__s", sides), columns, ["__s"])
    rows = long.select("feature", "x", F.explode("__s").alias("s")).select("feature", "x", "s.contrast", "s.y")
    signed = rows.select("feature", "contrast", "y", F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), F.col("x").alias("v")), F.struct(F.lit(-1).alias("sign"), (-F.col("x")).alias("v"))
    )).alias("d")).select("feature", "contrast", "y", "d.sign", "d.v")
    ap = average_precision(signed, ["feature", "contrast", "sign"], F.col("y"), "v")
    return ap.groupBy("feature", "contrast").agg(
        F.max(F.coalesce("average_precision", F.lit(0.0))).alias("average_precision"), F.max(F.col("n_pos") / F.col("n_all")).alias("base_rate")
    )


def contrast_ratio(df: DataFrame, keys: Sequence[str], flag: Column, residual: str, longest: int | None = None) -> DataFrame:
    """Median |residual| of flagged rows over that of the others, and the overall maximum, per key."""
    rows = df.select(*keys, flag.alias("__f"), F.abs(F.col(residual)).alias("__a"))
    med = quantiles(rows, [*keys, "__f"], "__a", {"med": 0.5}, longest)
    top = rows.groupBy(*keys).agg(F.max("__a").alias("max_abs"))
    wide = med.groupBy(*keys).agg(F.max(F.when(F.col("__f"), F.col("med"))).alias("median_in"), F.max(F.when(~F.col("__f"), F.col("med"))).alias("median_out"))
    return wide.join(top, list(keys)).withColumn("contrast", safe_div(F.col("median_in"), F.col("median_out")))


def common_mode_rejection(df: DataFrame, keys: Sequence[str], head: str, other: str) -> DataFrame:
    """How much the difference of two heads is quieter than one head, in dB."""
    got = df.groupBy(*keys).agg(F.stddev_samp(head).alias("std_head"), F.stddev_samp(F.col(head) - F.col(other)).alias("std_diff"))
    return got.withColumn("rejection_db", F.when(F.col("std_diff") > 0, 20.0 * F.log10(F.col("std_head") / F.col("std_diff"))))


def detectability(hits: DataFrame, rows: DataFrame, survey: str, obj: str, signal: str, severity: str, limit: float = 4.0, longest: int | None = None) -> DataFrame:
    """Per object: share of surveys whose largest |robust z| in its window passes the limit, mean peak, peak per severity.

    ``hits`` are rows already matched to object windows.
    """
    stats = median_mad(rows, [survey], signal, longest)
    z = F.abs(F.col(signal) - F.col("med")) / F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(1e-9))
    peak = hits.join(stats, survey).groupBy(obj, survey).agg(F.max(z).alias("peak_z"), F.max(severity).alias("severity"))
    return peak.groupBy(obj).agg(
        F.avg((F.col("peak_z") > limit).cast("double")).alias("hit_rate"), F.avg("peak_z").alias("mean_peak_z"),
        F.avg(safe_div(F.col("peak_z"), F.col("severity"))).alias("peak_per_severity"), F.count(F.lit(1)).alias("n_surveys"),
    )


def robust_scale(df: DataFrame, columns: Sequence[str], longest: int | None = None) -> DataFrame:
    """Median and interquartile range per column; a range of 0 scales by 1."""
    q = quantiles(unpivot(df, columns), ["feature"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}, longest)
    iqr = F.col("q3") - F.col("q1")
    return q.select("feature", "median", F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("iqr"))
