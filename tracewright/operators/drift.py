"""Reference summaries, population stability, two-sample tests and the monitor roll-up."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from ..session import cut, join_keyed
from .islands import top_per_key
from .ordered import cumulate
from .quantiles import quantile_edges

PSI_FLOOR = 1e-6
KS_TERMS = 60


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), name: str = "feature", value: str = "x") -> DataFrame:
    """One row per feature and finite value."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in columns]))
    long = df.select(*keys, items.alias("__i")).select(*keys, f"__i.{name}", f"__i.{value}")
    v = F.col(value)
    return long.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))


def feature_summary(long: DataFrame, bins: int = 10, keys: Sequence[str] = ("feature",), longest: int | None = None) -> DataFrame:
    """Mean, population deviation, range and quantile edges per feature."""
    stats = {"mean": F.avg("x"), "std": F.stddev_pop("x"), "min": F.min("x"), "max": F.max("x")}
    found = quantile_edges(long, keys, "x", bins, longest, also=stats)
    # the reference is read by every later comparison
    return cut(found.select(*keys, *stats, "n", F.col("edges").alias("bin_edges")))


def reference_sample(long: DataFrame, keys: Sequence[str], row_id: Column, size: int, seed: int) -> DataFrame:
    """The ``size`` rows per key with the smallest seeded hash.

    The hash is the start of a sha256, so any engine draws the same rows. A cut on
    it leaves little more than ``size`` rows per key for the ranking; a key that the
    cut leaves short, which is very rare, is ranked whole.
    """
    n = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), row_id), 256), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    hashed = join_keyed(long.withColumn("__u", h), n, keys)
    # six standard deviations above the wanted count: fewer than ``size`` rows pass with a chance of about 1e-9
    share = (F.lit(float(size)) + 6.0 * math.sqrt(size) + 40.0) / F.col("__n")
    near = hashed.filter(F.col("__u") <= share)
    found = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("__f"))
    short = cut(n.join(found, list(keys), "left").filter(F.coalesce("__f", F.lit(0)) < F.least("__n", F.lit(size))).select(*keys))
    if not short.isEmpty():
        near = near.join(short, list(keys), "left_anti").unionByName(hashed.join(short, list(keys), "left_semi"))
    return top_per_key(near, list(keys), [F.col("__u"), F.col("x")], size).drop("__u", "__n", "rank")


def bin_of(x: Column, edges: Column) -> Column:
    """0-based bin of a value clipped into the edges; bins are left-closed, the last one closed."""
    inside = F.least(F.greatest(x, edges[0]), F.element_at(edges, -1))
    return F.least(F.size(F.filter(edges, lambda e: e <= inside)) - 1, F.size(edges) - 2)


def psi(reference: DataFrame, current: DataFrame, edges: DataFrame, keys: Sequence[str] = ("feature",), edge_col: str = "bin_edges") -> DataFrame:
    """Population stability index on the reference's edges; empty bins count with a small share, an empty side gives 0."""
    keys = list(keys)
    both = reference.select(*keys, "x", F.lit(1).alias("__ref")).unionByName(current.select(*keys, "x", F.lit(0).alias("__ref")))
    binned = join_keyed(both, edges.select(*keys, edge_col), keys).withColumn("__bin", bin_of(F.col("x"), F.col(edge_col)))
    counts = binned.groupBy(*keys, "__bin").agg(F.sum("__ref").alias("r"), F.sum(1 - F.col("__ref")).alias("c"))
    bins = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.size(edge_col) - 2)).alias("__bin"))
    full = bins.join(counts, [*keys, "__bin"], "left").fillna(0, ["r", "c"])
    totals = full.groupBy(*keys).agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    pr = F.greatest(safe_div(F.col("r"), F.col("nr")), F.lit(PSI_FLOOR))
    pc = F.greatest(safe_div(F.col("c"), F.col("nc")), F.lit(PSI_FLOOR))
    out = full.join(totals, keys).groupBy(*keys).agg(F.sum((pc - pr) * F.ln(pc / pr)).alias("__p"), F.max("nr").alias("nr"), F.max("nc").alias("nc"))
    return out.select(*keys, F.when((F.col("nr") == 0) | (F.col("nc") == 0), F.lit(0.0)).otherwise(F.col("__p")).alias("psi"))


def ks(reference: DataFrame, current: DataFrame, keys: Sequence[str] = ("feature",)) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic, and its p-value by the asymptotic series."""
    keys = list(keys)
    both = reference.select(*keys, "x", F.lit(1).alias("__ref")).unionByName(current.select(*keys, "x", F.lit(0).alias("__ref")))
    steps = cumulate(both, keys, "x", {"r": F.col("__ref"), "c": 1 - F.col("__ref")}).df
    totals = both.groupBy(*keys).agg(F.sum("__ref").alias("nr"), F.sum(1 - F.col("__ref")).alias("nc"))
    gap = F.abs(safe_div(F.col("cum_r"), F.col("nr")) - safe_div(F.col("cum_c"), F.col("nc")))
    out = steps.join(totals, keys).groupBy(*keys).agg(F.max(gap).alias("ks_stat"), F.max("nr").alias("nr"), F.max("nc").alias("nc"))
    return out.select(*keys, "ks_stat", _ks_pvalue(F.col("ks_stat"), F.col("nr"), F.col("nc")).alias("ks_pvalue"))


def _ks_pvalue(stat: Column, n: Column, m: Column) -> Column:
    """Asymptotic series of the two-sample test."""
    root = F.sqrt(n * m / (n + m).cast("double"))
    lam = (root + 0.12 + safe_div(F.lit(0.11), root)) * stat
    # summed by a loop over the terms: written out, the column would outgrow a compiled method
    sign = lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0), lambda acc, j: acc + sign(j) * F.exp(-2.0 * j * j * lam * lam))
    p = F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))
    return F.when(stat.isNotNull(), p)


class StoredSample:
    """A reference sample of bounded size, against which any number of groups is tested at once.

    ``sample`` has (feature, x), as ``reference_sample`` draws it, so it holds at
    most ``size`` values per feature and goes to the tasks; the groups' rows stay
    where they are and are never paired with it.
    """

    def __init__(self, sample: DataFrame, edges: DataFrame):
        got: dict[str, list[float]] = {}
        for r in sample.select("feature", F.col("x").cast("double").alias("x")).collect():
            got.setdefault(r["feature"], []).append(r["x"])
        self.values = {f: np.sort(np.array(x)) for f, x in got.items()}
        self.edges = edges
        self.shares = cut(self._shares(sample, edges))

    @staticmethod
    def _shares(sample: DataFrame, edges: DataFrame) -> DataFrame:
        """Share of the sample per bin, one array a feature."""
        bins = edges.select("feature", "bin_edges", F.explode(F.sequence(F.lit(0), F.size("bin_edges") - 2)).alias("__bin"))
        counts = sample.join(edges, "feature").groupBy("feature", bin_of(F.col("x"), F.col("bin_edges")).alias("__bin")).agg(F.count(F.lit(1)).alias("__c"))
        n = sample.groupBy("feature").agg(F.count(F.lit(1)).alias("nr"))
        one = F.struct("__bin", F.greatest(F.coalesce("__c", F.lit(0)) / F.col("nr"), F.lit(PSI_FLOOR)).alias("p"))
        full = bins.join(counts, ["feature", "__bin"], "left").join(n, "feature").groupBy("feature", "bin_edges", "nr").agg(F.sort_array(F.collect_list(one)).alias("__p"))
        return full.select("feature", "bin_edges", "nr", F.col("__p.p").alias("shares"))

    def _known(self, current: DataFrame) -> DataFrame:
        return current.filter(F.col("feature").isin(list(self.values)))

    def psi(self, current: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Population stability index per group and feature of ``current`` (keys, feature, x)."""
        keys = [*keys, "feature"]
        # a row a feature goes to the tasks: dealt out by feature, all rows of one would meet in a task
        binned = self._known(current).join(F.broadcast(self.shares), "feature").groupBy(*keys, "shares", bin_of(F.col("x"), F.col("bin_edges")).alias("__bin")).agg(F.count(F.lit(1)).alias("__c"))
        # at most one entry per bin
        per = binned.groupBy(*keys, "shares").agg(F.map_from_entries(F.collect_list(F.struct("__bin", "__c"))).alias("__m"), F.sum("__c").alias("n"))

        def part(acc: Column, i: Column) -> Column:
            p = F.greatest(F.coalesce(F.try_element_at("__m", i), F.lit(0)) / F.col("n"), F.lit(PSI_FLOOR))
            q = F.get("shares", i)
            return acc + (p - q) * F.ln(p / q)

        return per.select(*keys, F.aggregate(F.sequence(F.lit(0), F.size("shares") - 1), F.lit(0.0), part).alias("psi"), "n")

    def ks(self, current: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Two-sample statistic per group and feature.

        Between two values of the group its own curve is flat, so the gap to the
        reference's curve is largest at or just before one of the group's values.
        """
        keys, values = [*keys, "feature"], self.values

        @F.pandas_udf("below double, upto double")
        def places(feature: pd.Series, x: pd.Series) -> pd.DataFrame:
            out = pd.DataFrame({"below": np.nan, "upto": np.nan}, index=x.index)
            for name, at in x.groupby(feature):
                ref = values[name]
                out.loc[at.index, "below"] = np.searchsorted(ref, at.to_numpy(), "left") / len(ref)
                out.loc[at.index, "upto"] = np.searchsorted(ref, at.to_numpy(), "right") / len(ref)
            return out

        steps = cumulate(self._known(current), keys, "x", {"n": F.lit(1)}).df
        total = steps.groupBy(*keys).agg(F.sum("n").alias("nc"))
        steps = steps.withColumn("__r", places(F.col("feature"), F.col("x"))).join(total, keys)
        gap = F.greatest(F.abs(F.col("cum_n") / F.col("nc") - F.col("__r.upto")), F.abs((F.col("cum_n") - F.col("n")) / F.col("nc") - F.col("__r.below")))
        out = steps.groupBy(*keys, "nc").agg(F.max(gap).alias("ks_stat")).join(F.broadcast(self.shares.select("feature", "nr")), "feature")
        return out.select(*keys, "ks_stat", _ks_pvalue(F.col("ks_stat"), F.col("nr"), F.col("nc")).alias("ks_pvalue"))


def feature_drift(
    reference: DataFrame, current: DataFrame, edges: DataFrame, warn: float = 0.2, block: float = 0.3, keys: Sequence[str] = ("feature",)
) -> DataFrame:
    """PSI, KS and status per feature; features without a reference are left out."""
    keys = list(keys)
    cur = join_keyed(current, edges.select(*keys), keys, "left_semi")
    out = psi(reference, cur, edges, keys).join(ks(reference, cur, keys), keys, "left")
    return out.withColumn("status", F.when(F.col("psi") >= block, "block").when(F.col("psi") >= warn, "warn").otherwise("ok"))


def prediction_drift(reference: DataFrame, current: DataFrame, reference_rate: DataFrame, current_rate: DataFrame, limit: float, keys: Sequence[str]) -> DataFrame:
    """KS of the calibrated probabilities and the ratio of indications per km; flagged outside ``[1/limit, limit]``."""
    keys = list(keys)
    rates = current_rate.withColumnRenamed("rate", "rate_current").join(reference_rate.withColumnRenamed("rate", "rate_reference"), keys)
    ratio = F.when(F.col("rate_reference") > 0, F.col("rate_current") / F.col("rate_reference"))
    out = rates.join(ks(reference, current, keys), keys, "left").withColumn("ratio", ratio)
    return out.withColumn("flagged", F.coalesce(~F.col("ratio").between(1.0 / limit, limit), F.lit(False)))


def indications_per_km(indications: DataFrame, extents: DataFrame, survey: str) -> DataFrame:
    n = indications.groupBy(survey).agg(F.count(F.lit(1)).alias("n"))
    return extents.join(n, survey, "left").select(
        survey, F.coalesce(safe_div(F.coalesce("n", F.lit(0)) * 1000.0, F.col("length_m")), F.lit(0.0)).alias("rate")
    )


def surveyed_km(extents: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return extents.groupBy(*by).agg((F.sum("length_m") / 1000.0).alias("km"))


def monitor(checks: Sequence[DataFrame], survey: str) -> DataFrame:
    """Worst status per survey over rows of (survey, check_name, status); only feature drift may block."""
    rows = reduce(DataFrame.unionByName, [c.select(survey, "check_name", "status") for c in checks])
    rank = F.when(F.col("status") == "block", F.when(F.col("check_name") == "feature_drift", 2).otherwise(1)).when(
        F.col("status").isin("warn", "fail"), 1
    ).otherwise(0)
    worst = rows.groupBy(survey).agg(F.max(rank).alias("__w"), F.count_if(rank > 0).alias("n_raised"))
    return worst.select(survey, F.element_at(F.array(F.lit("ok"), F.lit("warn"), F.lit("block")), F.col("__w") + 1).alias("status"), "n_raised")
