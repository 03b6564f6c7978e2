"""User transforms: a stateless function of one survey, run on every survey of a table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .guards import GuardError, join_many_to_one
from .ordered import Series, map_groups

#: Rows of one survey that a call may hold without a declared reach.
WHOLE_SURVEY_ROWS = 2_000_000

#: (rows of one survey in order, its context) -> rows
Transform = Callable[[pd.DataFrame, Mapping[str, Any]], pd.DataFrame]


def user_transform(
    series: Series, transform: Transform, schema: T.StructType | str, context: DataFrame | None = None, reach: tuple[int, int] | None = None,
    max_rows: int = WHOLE_SURVEY_ROWS,
) -> DataFrame:
    """Key columns and what `transform` returns for every survey of `series`.

    A call sees the rows of exactly one survey, ordered by the index, and that
    survey's one row of `context` as a mapping (the key columns alone without
    `context`). There is nothing to fit: an object with a `fit` method is refused, so
    no state can pass from one survey, or from training, to another.

    Without `reach` a call gets the whole survey and may return any rows of
    `schema`; a survey of more than `max_rows` rows stops the job before any call.

    With `reach` (rows before, rows after) the transform promises that a row's
    result depends on no rows further away. Surveys of any length are then cut
    into chunks by row position, each called with that many rows more at
    both ends. The result must have one row for each row it got, with the index
    column, whose border rows are taken off again; a result that lost, made or
    doubled an index stops the job.

    Rows that repeat an index are an error with `reach`, as their results could not
    be told apart. Nulls in other columns are the transform's to handle. Surveys
    without a row of `context` stop the job, as do contexts of two rows for one
    survey. An empty table gives an empty result.
    """
    if hasattr(transform, "fit"):
        raise GuardError("a fitted transform belongs in a model: fit it once and carry it there")
    keys, idx = list(series.keys), series.idx
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    clash = [f.name for f in schema.fields if f.name in keys]
    if clash:
        raise GuardError(f"the keys are added to the result: {clash}")
    told = [c for c in context.columns if c not in keys] if context is not None else []
    key_fields = [series.df.schema[k] for k in keys]
    names = [f.name for f in schema.fields]

    if reach is None:
        longest = series.longest
        if longest is None:
            longest = int(series.df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        if longest > max_rows:
            raise GuardError(f"a survey of {longest} rows exceeds {max_rows}: declare the transform's reach")
        rows, by = series.df.withColumn("__core", F.lit(True)), keys
    else:
        if idx not in names:
            raise GuardError(f"with a reach the result needs the index column {idx}")
        rows, by = series.halo(*reach), series.chunk_keys()
    if context is not None:
        known = context.select(*keys, F.struct(F.lit(True).alias("__known"), *[F.col(c) for c in told]).alias("__context"))
        rows = join_many_to_one(rows, known, keys)
    has_context, has_reach = context is not None, reach is not None
    added = ["__core", *[c for c in by if c not in keys], *(["__context"] if has_context else [])]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        ctx = {k: rows[k].iloc[0] for k in keys}
        if has_context:
            found = rows["__context"].iloc[0]
            if found is None:
                raise ValueError(f"no context for {ctx}")
            ctx |= {c: found[c] for c in told}
        core = rows.loc[rows["__core"], idx]
        seen = rows.drop(columns=added)
        out = transform(seen, ctx)
        missing = [n for n in names if n not in out.columns]
        if missing:
            raise ValueError(f"the transform left out {missing}")
        if has_reach:
            if seen[idx].duplicated().any() or len(out) != len(seen) or set(out[idx]) != set(seen[idx]):
                raise ValueError(f"with a reach the transform must return each index of {ctx} once")
            out = out[out[idx].isin(core)]
        out = out[names].copy()
        for at, k in enumerate(keys):
            out.insert(at, k, rows[k].iloc[0])
        return out

    def call(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return pd.concat([one(rows.iloc[a:b]) for a, b in zip(starts, [*starts[1:], len(rows)])], ignore_index=True)

    result = T.StructType(key_fields + schema.fields)
    # pandas has no null in whole numbers and flags: one in a survey would change the type that another's call sees
    told_by_type = (T.DoubleType, T.FloatType, T.StringType)
    if all(isinstance(f.dataType, told_by_type) for f in rows.schema.fields if f.name not in (idx, *added)):
        return map_groups(rows, by, idx, call, result)
    return rows.groupBy(*by).applyInPandas(lambda pdf: one(pdf.sort_values(idx, kind="stable")), result)
