"""Checks that stop a job rather than let a wrong frame through."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import Series, position


class GuardError(ValueError):
    """A frame breaks a stated assumption."""


def assert_point_in_time(df: DataFrame, as_of, time_col: str, key_col: str, what: str = "frame") -> DataFrame:
    """No row may be later than ``as_of`` or lack a time; names up to five offending keys."""
    bad = df.filter(F.col(time_col).isNull() | (F.col(time_col) > F.lit(as_of))).select(key_col).distinct()
    offenders = [r[0] for r in bad.orderBy(key_col).limit(5).collect()]
    if offenders:
        raise GuardError(f"{what}: rows later than {as_of}: {offenders}")
    return df


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "frame") -> DataFrame:
    sample = duplicate_keys(df, keys).limit(5).collect()
    if sample:
        raise GuardError(f"{what}: repeated keys {list(keys)}: {[tuple(r)[:-1] for r in sample]}")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    assert_unique(left, keys, "left side")
    assert_unique(right, keys, "right side")
    return left.join(right, list(keys), how)


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    assert_unique(right, keys, "right side")
    return left.join(right, list(keys), how)


def flag_edges(series: Series, half: int | Column, flag: str = "dq_flag", drop: bool = False) -> DataFrame:
    """The first and last ``half`` rows of a series are ``edge``, the rest ``clean``."""
    half = half if isinstance(half, Column) else F.lit(int(half))
    cols = series.df.columns
    placed = series.running(__pos=position()).df
    sizes = series.df.groupBy(*series.keys).agg(F.count(F.lit(1)).alias("__n"))
    out = placed.join(sizes, list(series.keys)).select(
        *cols,
        F.when((F.col("__pos") < half) | (F.col("__pos") >= F.col("__n") - half), "edge").otherwise("clean").alias(flag),
    )
    return out.filter(F.col(flag) == "clean") if drop else out


def assert_no_forbidden(columns: Sequence[str], forbidden: Sequence[str]) -> None:
    leaked = sorted(set(columns) & set(forbidden))
    if leaked:
        raise GuardError(f"columns that must not be features: {leaked}")


def assert_columns(columns: Sequence[str], expected: Sequence[str]) -> None:
    """The columns are the expected ones, in their order."""
    off = column_differences(columns, expected)
    if off["missing"] or off["extra"] or list(columns) != list(expected):
        raise GuardError(f"columns out of contract: {off}, or their order")


def column_differences(columns: Sequence[str], expected: Sequence[str]) -> dict[str, list[str]]:
    return {
        "missing": [c for c in expected if c not in set(columns)],
        "extra": [c for c in columns if c not in set(expected)],
    }


def key_set_differences(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys present on one side only, with the side."""
    l, r = left.select(*keys).distinct(), right.select(*keys).distinct()
    return l.join(r, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(
        r.join(l, list(keys), "left_anti").withColumn("side", F.lit("right"))
    )
