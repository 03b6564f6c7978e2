"""Content hashes, registration of surveys, incremental selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_DECIMALS = 6


def canonical(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The contract columns in their fixed order, floats rounded; other columns are dropped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in columns:
        col = F.col(c)
        if isinstance(types[c], (T.DoubleType, T.FloatType)):
            # adding zero turns -0.0 into 0.0
            col = _rounded(col.cast("double")) + F.lit(0.0)
        out.append(col.alias(c))
    return df.select(*out)


def _rounded(x: Column) -> Column:
    """A double at FLOAT_DECIMALS decimals by multiplying, rounding to a whole number and dividing.

    Any engine repeats these steps bit by bit. Spark's own ``round`` goes by the
    shortest text of the number instead, which tells halves apart differently.
    """
    scale = F.lit(float(10**FLOAT_DECIMALS))
    there = F.round(x * scale, 0) / scale
    return F.when(F.isnan(there) | (F.abs(there) == float("inf")), x).otherwise(there)


def content_hashes(df: DataFrame, survey: str, columns: Sequence[str]) -> DataFrame:
    """One hash per survey that ignores column order, row order and noise below the rounding.

    A row's text has its values in column order, each with its length before it and
    numbers with a fixed count of decimals, so any engine can repeat it. Rows are
    hashed one by one, each hash is cut into 60-bit numbers, and the
    numbers are added up per survey. Sums do not depend on the row order and are
    built map-side, so no task holds the rows of a survey.
    """
    ordered = sorted(c for c in columns if c != survey)
    base = canonical(df.select(survey, *ordered), [survey, *ordered])
    row = base.select(survey, F.sha2(F.concat_ws("|", *[_told(c, base.schema[c].dataType) for c in ordered]), 256).alias("__h"))
    return multiset_hash(row, [survey], "__h", "content_sha256")


def _told(column: str, kind: T.DataType) -> Column:
    """A value as ``length:text``, or ``n`` for null."""
    value = F.col(column)
    if isinstance(kind, T.DoubleType):
        text = F.coalesce(value.try_cast(f"decimal(38,{FLOAT_DECIMALS})").cast("string"), value.cast("string"))
    else:
        text = value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))


def multiset_hash(hashes: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """One hash per key over its members' sha256 values, whatever their order."""
    pieces = [F.conv(F.substring(column, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = hashes.groupBy(*keys).agg(
        *[F.sum(p).cast("string").alias(f"__s{i}") for i, p in enumerate(pieces)], F.count(F.lit(1)).cast("string").alias("__n")
    )
    return sums.select(*keys, F.sha2(F.concat_ws("|", *[f"__s{i}" for i in range(4)], "__n"), 256).alias(out))


def corpus_hash(hashes: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Hash of a set of member hashes: the order does not matter, a changed, added or lost member does."""
    return multiset_hash(hashes, group, column, "data_sha256")


def register(batch: DataFrame, registry: DataFrame, keys: Sequence[str] = ("line_id", "run_id"), content: str = "content_sha256") -> DataFrame:
    """Outcome of registering each survey: ``accepted`` (new), ``noop`` (same content) or ``conflict``."""
    known = registry.select(*keys, F.col(content).alias("__known"))
    return batch.join(known, list(keys), "left").withColumn(
        "outcome", F.when(F.col("__known").isNull(), "accepted").when(F.col("__known") == F.col(content), "noop").otherwise("conflict")
    ).drop("__known")


def todo(surveys: DataFrame, done: DataFrame, survey: str = "survey_id", content: str = "content_sha256", version: str = "feature_version", force: bool = False) -> DataFrame:
    """Surveys without finished output for their present content and version."""
    if force:
        return surveys
    finished = done.select(survey, content, version).filter(F.col(content).isNotNull()).distinct()
    return surveys.join(finished, [survey, content, version], "left_anti")


def insert_new(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not stored yet, each key once."""
    return rows.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
