"""Isotonic regression over tables of any size: blocks of equal value and the curve through them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .guards import GuardError
from .ordered import cumulate, following, latest, order_rows

#: Distinct values that one task pools by itself; a longer block is split first.
TASK_ROWS = 100_000
#: Knots of a curve up to which they go to the tasks; a longer curve meets the rows in order.
KNOTS = 100_000
#: Share of a block's totals below which a dip counts as rounding.
ROUNDING = 1e-12

BLOCKS = "x_lo double, x_hi double, value double, weight double"


@dataclass(frozen=True)
class Isotonic:
    """``blocks``: (x_lo, x_hi, value, weight) in order of ``x``, none of them overlapping."""

    blocks: DataFrame
    task_knots: int = KNOTS

    def knots(self) -> DataFrame:
        """(kx, ky): both ends of each block, one row where they are the same."""
        ends = F.array_distinct(F.array("x_lo", "x_hi"))
        return self.blocks.select(F.explode(ends).alias("kx"), F.col("value").alias("ky"))

    def apply(self, df: DataFrame, x: str, out: str) -> DataFrame:
        """``df`` with the curve's value at ``x``: flat outside, linear between blocks; null and NaN give null."""
        knots = self.knots()
        if knots.count() <= self.task_knots:
            rows = knots.toPandas().sort_values("kx")
            at, value = rows["kx"].to_numpy(), rows["ky"].to_numpy()

            @F.pandas_udf("double")
            def curve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for batch in batches:
                    yield pd.Series(np.interp(batch.to_numpy(float, na_value=np.nan), at, value))

            got = curve(F.col(x).cast("double"))
            return df.withColumn(out, F.when(F.col(x).isNotNull() & ~F.isnan(x), got))
        return self._in_order(df, knots, x, out)

    def _in_order(self, df: DataFrame, knots: DataFrame, x: str, out: str) -> DataFrame:
        """Rows and knots in one order: the knots beside a row are the last before and the first after it."""
        kept = [c for c in df.columns if c != out]
        usable = F.col(x).isNotNull() & ~F.isnan(x)
        row = F.struct(*[F.col(c) for c in kept]).alias("__row")
        rows = df.filter(usable).select(row, F.col(x).cast("double").alias("__x"), F.lit(None).cast("double").alias("__ky"))
        ends = knots.select(F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.col("kx").alias("__x"), F.col("ky").alias("__ky"))
        both = rows.unionByName(ends).withColumn("__one", F.lit(1))
        series = order_rows(both, ["__one"], ["__x"], idx="__at")
        # ties may be numbered anew by each reader
        series = series.with_df(cut(series.df))
        knot = F.when(F.col("__ky").isNotNull(), F.struct(F.col("__x").alias("x"), F.col("__ky").alias("y")))
        beside = series.running(__lo=latest(knot), __hi=following(knot)).df.filter("__row is not null")
        span = F.col("__hi.x") - F.col("__lo.x")
        share = F.when(span > 0, (F.col("__x") - F.col("__lo.x")) / span).otherwise(0.0)
        between = F.col("__lo.y") + share * (F.col("__hi.y") - F.col("__lo.y"))
        found = beside.select("__row.*", F.coalesce(between, F.col("__lo.y"), F.col("__hi.y")).alias(out))
        return found.unionByName(df.filter(~F.coalesce(usable, F.lit(False))).select(*kept, F.lit(None).cast("double").alias(out)))


def pool(x: np.ndarray, s: np.ndarray, w: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Blocks (x_lo, x_hi, total, weight) of rising means over points in order of ``x``."""
    blocks: list[tuple[float, float, float, float]] = []
    for lo, total, weight in zip(x.tolist(), s.tolist(), w.tolist()):
        hi = lo
        while blocks and blocks[-1][2] * weight >= total * blocks[-1][3]:
            lo, _, t, n = blocks.pop()
            total, weight = total + t, weight + n
        blocks.append((lo, hi, total, weight))
    return blocks


def _pool_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("step")
    got = pool(rows["x"].to_numpy(), rows["s"].to_numpy(float), rows["w"].to_numpy(float))
    return pd.DataFrame([(lo, hi, t / n, n) for lo, hi, t, n in got], columns=["x_lo", "x_hi", "value", "weight"])


def fit(df: DataFrame, x: str, y: str, task_rows: int = TASK_ROWS) -> Isotonic:
    """Non-decreasing fit of ``y`` on ``x`` by least squares; rows with a null or NaN in either are left out, none left is an error.

    Equal ``x`` are added up first. A block of more than ``task_rows`` values is split
    where its running total lies furthest below the straight line of the block's
    mean: that place is a border of the fit, so both sides are fitted apart. Without
    such a place the whole block has one value. All long blocks are searched in one
    pass over running totals, with partial sums before the shuffle; each row leaves when
    its block is short enough for a task. Neither a task nor the driver holds all values.
    """
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    # -0.0 and 0.0 are one value
    known = known.select(F.lit(1).alias("__one"), (F.col("x") + 0.0).alias("x"), "y")
    points = cumulate(known, ["__one"], "x", {"s": F.col("y"), "w": F.lit(1)}).df
    rest = cut(points.select("step", "x", "s", "w", "cum_s", "cum_w", F.lit(0).cast("long").alias("block")))
    if rest.isEmpty():
        raise GuardError(f"no row with {x} and {y}")
    done = []
    while True:
        size = rest.groupBy("block").agg(
            F.count(F.lit(1)).alias("n"), F.max("step").alias("last"), F.sum("s").alias("bs"), F.sum("w").alias("bw"),
            F.min_by(F.col("cum_s") - F.col("s"), "step").alias("s0"), F.min_by(F.col("cum_w") - F.col("w"), "step").alias("w0"),
        )
        # at most one long block for every task_rows values, so the table is small beside the rows
        long = cut(size.filter(F.col("n") > task_rows).drop("n"))
        short = rest.join(F.broadcast(long.select("block")), "block", "left_anti")
        done.append(cut(short.groupBy("block").applyInPandas(_pool_block, BLOCKS)))
        if long.isEmpty():
            break
        rows = rest.join(F.broadcast(long), "block")
        below = _below_mean()
        dips = rows.filter(F.col("step") < F.col("last")).groupBy("block").agg(F.min(F.struct(below.alias("d"), F.col("step").alias("at"))).alias("dip"))
        level = F.abs("s0") + F.abs("bs") + 1e-300
        cuts = cut(long.join(dips, "block").select("block", F.when(F.col("dip.d") < -ROUNDING * level, F.col("dip.at")).alias("at")))
        marked = rest.join(F.broadcast(cuts), "block")
        level_blocks = marked.filter("at is null").groupBy("block").agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), (F.sum("s") / F.sum("w")).alias("value"), F.sum("w").cast("double").alias("weight"))
        done.append(cut(level_blocks.drop("block")))
        split = marked.filter("at is not null").withColumn("block", F.when(F.col("step") <= F.col("at"), F.col("block")).otherwise(F.col("at") + 1))
        rest = cut(split.drop("at"))
        if rest.isEmpty():
            break
    return Isotonic(cut(reduce(DataFrame.unionByName, done)))


def _below_mean() -> Column:
    """Running total less the straight line from a block's start to its end."""
    return (F.col("cum_s") - F.col("s0")) - F.col("bs") / F.col("bw") * (F.col("cum_w") - F.col("w0"))
