"""Ordered series: running values, neighbours and centred frames for keys of any size.

A plain ``Window.partitionBy(key)`` puts one key into one task. Here a key is
cut into chunks of ``chunk_rows`` consecutive positions. Running values are
computed inside each chunk, a one-row summary per chunk is scanned per key, and
the carry is joined back on ``(key, chunk)``: the rows are shuffled once and no
task holds more than a chunk. Centred frames copy the rows next to a chunk
border into the neighbouring chunk instead.

``longest`` is the known largest number of rows of a key. Where it fits in one
chunk the chunk column, the carry and the copies drop out of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut

CHUNK_ROWS = 1 << 16
#: Rows of whole groups that a call of ``map_groups`` sees at least, if there are so many.
CALL_ROWS = 1 << 15
SINGLE_TASK_ROWS = 2_000_000
_CHUNK = "__chunk"


@dataclass(frozen=True)
class Running:
    """One running value: what to compute and over which expression."""

    kind: str
    value: Column | None = None


def position() -> Running:
    """0-based row position within the key."""
    return Running("position")


def total(value: Column) -> Running:
    """Sum of this row and all before it."""
    return Running("total", value)


def highest(value: Column) -> Running:
    """Maximum of this row and all before it."""
    return Running("highest", value)


def latest(value: Column) -> Running:
    """Last non-null value at or before this row."""
    return Running("latest", value)


def earlier(value: Column) -> Running:
    """Last non-null value strictly before this row."""
    return Running("earlier", value)


def following(value: Column) -> Running:
    """First non-null value at or after this row."""
    return Running("following", value)


def later(value: Column) -> Running:
    """First non-null value strictly after this row."""
    return Running("later", value)


def before(value: Column) -> Running:
    """Value of the previous row, null on the first."""
    return Running("before", value)


def after(value: Column) -> Running:
    """Value of the next row, null on the last."""
    return Running("after", value)


@dataclass(frozen=True)
class Series:
    """Rows identified by ``keys`` and ordered by the integer ``idx`` within a key.

    ``dense``: ``idx`` is known to count 0, 1, 2, … without holes.
    """

    df: DataFrame
    keys: tuple[str, ...]
    idx: str
    longest: int | None = None
    chunk_rows: int = CHUNK_ROWS
    dense: bool = False

    @property
    def one_chunk(self) -> bool:
        return self.longest is not None and self.longest <= self.chunk_rows

    @property
    def by_key(self) -> bool:
        """A key's rows may meet in one task: they are no more than any chunk may have."""
        return self.longest is not None and self.longest <= max(self.chunk_rows, CHUNK_ROWS)

    def measured(self) -> Series:
        """The series with ``longest``, counted if it isn't known."""
        if self.longest is not None:
            return self
        most = self.df.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        return replace(self, longest=int(most or 0))

    def with_df(self, df: DataFrame) -> Series:
        return replace(self, df=df)

    def _chunk(self) -> Column:
        return F.expr(f"`{self.idx}` div {self.chunk_rows}L")

    def running(self, **steps: Running) -> Series:
        """Add one column per step."""
        df, keys = self.df, list(self.keys)
        kept = df.columns
        values = {f"__v_{n}": s.value for n, s in steps.items() if s.value is not None}
        df = df.select("*", *[v.alias(c) for c, v in values.items()])
        if self.one_chunk:
            w = Window.partitionBy(*keys).orderBy(self.idx)
            back = Window.partitionBy(*keys).orderBy(F.col(self.idx).desc())
            local = df.select("*", *[_local(n, s, w, back).alias(f"__l_{n}") for n, s in steps.items()])
            out = local.select(*kept, *[F.col(f"__l_{n}").alias(n) for n in steps])
            return self.with_df(out)

        df = df.withColumn(_CHUNK, self._chunk())
        by = [*keys, _CHUNK]
        w = Window.partitionBy(*by).orderBy(self.idx)
        back = Window.partitionBy(*by).orderBy(F.col(self.idx).desc())
        local = df.select(
            "*",
            *[_local(n, s, w, back).alias(f"__l_{n}") for n, s in steps.items()],
            (F.row_number().over(w) == 1).alias("__head_row"),
            F.lead(F.lit(1)).over(w).isNull().alias("__tail_row"),
        )
        summary = df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("__chunk_n"),
            *[_summary(n, s, self.idx).alias(f"__s_{n}") for n, s in steps.items() if s.kind != "position"],
        )
        wk = Window.partitionBy(*keys).orderBy(_CHUNK)
        wk_back = Window.partitionBy(*keys).orderBy(F.col(_CHUNK).desc())
        carry = summary.select(*by, *[_carry(n, s, wk, wk_back).alias(f"__c_{n}") for n, s in steps.items()])
        # chunks that nothing is carried into need no row here: short keys drop out
        carry = carry.filter(_any_not_null(steps))
        joined = local.join(carry, by, "left")
        out = joined.select(*kept, *[_combine(n, s).alias(n) for n, s in steps.items()])
        return self.with_df(out)

    def halo(self, before_rows: int | Column, after_rows: int | Column) -> DataFrame:
        """Rows tagged with a chunk, plus copies of border rows (``__core`` false).

        Reaches count rows, so chunks are cut by row position, whatever holes
        ``idx`` has. A row goes to every chunk that a frame with it may start in.
        Where a key may lie in one task, its rows are numbered there.
        """
        if self.one_chunk:
            return self.df.select("*", F.lit(0).cast("long").alias(_CHUNK), F.lit(True).alias("__core"))
        if self.dense:
            df = self.df.withColumn("__at", F.col(self.idx))
        elif self.by_key:
            df = replace(self, chunk_rows=CHUNK_ROWS).running(__at=position()).df
        else:
            df = self.running(__at=position()).df
        chunk_of = lambda row: F.floor(row / F.lit(self.chunk_rows)).cast("long")
        first = chunk_of(F.greatest(F.col("__at") - after_rows, F.lit(0)))
        tagged = df.withColumn(_CHUNK, F.explode(F.sequence(first, chunk_of(F.col("__at") + before_rows))))
        return tagged.withColumn("__core", F.col(_CHUNK) == chunk_of(F.col("__at"))).drop("__at")

    def chunk_keys(self) -> list[str]:
        return [*self.keys, _CHUNK]

    def framed(self, half: int, **aggregates) -> Series:
        """Centred row frames of ``2*half+1`` rows; each aggregate is ``f(window) -> Column``."""
        kept = self.df.columns
        tagged = self.halo(half, half)
        w = Window.partitionBy(*self.chunk_keys()).orderBy(self.idx).rowsBetween(-half, half)
        out = tagged.select("*", *[f(w).alias(n) for n, f in aggregates.items()])
        return self.with_df(out.filter("__core").select(*kept, *aggregates))


def by_length(series: Series) -> list[Series]:
    """The keys that fit in a chunk, and the longer ones if there are any, whose rows are written for the many steps that read them."""
    if series.one_chunk:
        return [series]
    keys = list(series.keys)
    # at most one key for each chunk of rows
    long = cut(series.df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > series.chunk_rows).select(*keys))
    rest = series.df.join(F.broadcast(long), keys, "left_anti")
    return [replace(series, df=rest, longest=series.chunk_rows), series.with_df(cut(series.df.join(F.broadcast(long), keys, "left_semi")))]


def by_position(series: Series, label: str) -> Series:
    """The same rows with their 0-based row position as ``idx`` and the old ``idx`` as ``label``."""
    if series.dense:
        return series.with_df(series.df.withColumn(label, F.col(series.idx)))
    placed = series.running(__at=position()).df
    return replace(series, df=placed.withColumnRenamed(series.idx, label).withColumnRenamed("__at", series.idx), dense=True)


def _any_not_null(steps) -> Column:
    cond = F.lit(False)
    for n in steps:
        cond = cond | F.col(f"__c_{n}").isNotNull()
    return cond


def _local(name: str, step: Running, w, back) -> Column:
    v = F.col(f"__v_{name}")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    if step.kind == "position":
        return (F.row_number().over(w) - 1).cast("long")
    if step.kind == "total":
        return F.sum(v).over(upto)
    if step.kind == "highest":
        return F.max(v).over(upto)
    if step.kind == "latest":
        return F.last(v, ignorenulls=True).over(upto)
    if step.kind == "earlier":
        return F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if step.kind == "following":
        return F.last(v, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    if step.kind == "later":
        return F.last(v, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    if step.kind == "before":
        return F.lag(v).over(w)
    if step.kind == "after":
        return F.lead(v).over(w)
    raise ValueError(step.kind)


def _summary(name: str, step: Running, idx: str) -> Column:
    v, i = F.col(f"__v_{name}"), F.col(idx)
    if step.kind == "total":
        return F.sum(v)
    if step.kind == "highest":
        return F.max(v)
    if step.kind in ("latest", "earlier"):
        return F.max_by(v, F.when(v.isNotNull(), i))
    if step.kind in ("following", "later"):
        return F.min_by(v, F.when(v.isNotNull(), i))
    if step.kind == "before":
        return F.max_by(v, i)
    return F.min_by(v, i)


def _carry(name: str, step: Running, wk, wk_back) -> Column:
    prior = wk.rowsBetween(Window.unboundedPreceding, -1)
    if step.kind == "position":
        return F.sum("__chunk_n").over(prior)
    s = F.col(f"__s_{name}")
    if step.kind == "total":
        return F.sum(s).over(prior)
    if step.kind == "highest":
        return F.max(s).over(prior)
    if step.kind in ("latest", "earlier"):
        return F.last(s, ignorenulls=True).over(prior)
    if step.kind in ("following", "later"):
        return F.last(s, ignorenulls=True).over(wk_back.rowsBetween(Window.unboundedPreceding, -1))
    if step.kind == "before":
        return F.lag(s).over(wk)
    return F.lead(s).over(wk)


def _combine(name: str, step: Running) -> Column:
    local, carry = F.col(f"__l_{name}"), F.col(f"__c_{name}")
    if step.kind == "position":
        return local + F.coalesce(carry, F.lit(0))
    if step.kind == "total":
        return F.when(local.isNull(), carry).when(carry.isNull(), local).otherwise(local + carry)
    if step.kind == "highest":
        return F.greatest(local, carry)
    if step.kind == "before":
        return F.when(F.col("__head_row"), carry).otherwise(local)
    if step.kind == "after":
        return F.when(F.col("__tail_row"), carry).otherwise(local)
    return F.coalesce(local, carry)


def indexed(df: DataFrame, keys: Sequence[str], idx: str, longest: int | None = None, chunk_rows: int = CHUNK_ROWS) -> Series:
    """A table that already carries a non-negative integer position per key."""
    return Series(df, tuple(keys), idx, longest, chunk_rows)


def order_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    idx: str = "sample_idx",
    longest: int | None = None,
    single_task_rows: int = SINGLE_TASK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> Series:
    """Number the rows of every key 0,1,2,… in ``order`` (a total order).

    Keys that fit in one task take one keyed window. If any key is larger, the
    whole table is range-partitioned on (key, order), so that a key spreads over
    as many partitions as it needs; each partition numbers its own rows and adds
    the rows of the same key in the partitions before it. That offset table has
    at most one row per partition border.
    """
    keys = list(keys)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = None
    if longest is None:
        stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
        longest, rows = int(stats[0] or 0), int(stats[1] or 0)
    if longest <= single_task_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        out = df.withColumn(idx, (F.row_number().over(w) - 1).cast("long"))
        return Series(out, tuple(keys), idx, longest, chunk_rows, dense=True)

    rows = rows if rows is not None else df.count()
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // single_task_rows))
    # the partition number must not change between the two readers below, hence the cut
    spread = cut(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id())
    )
    sizes = spread.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    prior = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__part", F.sum("__n").over(prior).alias("__off")).filter("__off is not null")
    w = Window.partitionBy(*keys, "__part").orderBy(*order)
    numbered = spread.withColumn("__rn", F.row_number().over(w)).join(F.broadcast(offsets), [*keys, "__part"], "left")
    out = numbered.select(*df.columns, (F.col("__rn") - 1 + F.coalesce("__off", F.lit(0))).cast("long").alias(idx))
    return Series(out, tuple(keys), idx, longest, chunk_rows, dense=True)


def cumulate(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    measures: dict[str, Column],
    descending: bool = False,
    single_task_rows: int = SINGLE_TASK_ROWS,
    chunk_rows: int = CHUNK_ROWS,
) -> Series:
    """Running totals of ``measures`` over the distinct values of ``value``, per key.

    Equal values are added up before the shuffle, so ties form one step. Each
    measure ``m`` gives ``m`` (at this value) and ``cum_m`` (up to this value).
    """
    steps = df.groupBy(*keys, value).agg(*[F.sum(e).alias(m) for m, e in measures.items()])
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    series = order_rows(steps, keys, [order], idx="step", single_task_rows=single_task_rows, chunk_rows=chunk_rows)
    return series.running(**{f"cum_{m}": total(F.col(m)) for m in measures})


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys are all known."""
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    return df


def map_groups(df: DataFrame, by: Sequence[str], order: str, call: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema, deal: Sequence[str] | None = None) -> DataFrame:
    """What ``call`` makes of whole groups, many short ones at once.

    A call gets rows sorted by ``by`` and ``order`` and the place of every group's
    first row. A group never falls into two calls. One call for each group would
    cost more than the work on it where groups have some hundred rows. The rows are
    dealt out by ``deal``, some of ``by``, so that those that lie so already aren't moved.
    """
    by = list(by)

    def starts(rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), dtype=bool)
        new[:1] = True
        for k in by:
            v, none = rows[k].to_numpy(), rows[k].isna().to_numpy()
            new[1:] |= ~((v[1:] == v[:-1]) | (none[1:] & none[:-1]))
        return np.flatnonzero(new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, enough = [], 0, CALL_ROWS
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < enough:
                continue
            rows = pd.concat(held, ignore_index=True)
            at = starts(rows)
            if at[-1]:
                yield call(rows.iloc[: at[-1]].reset_index(drop=True), at[:-1])
            # the last group may go on in the next batch
            held, n = [rows.iloc[at[-1] :]], len(rows) - int(at[-1])
            enough = max(CALL_ROWS, 2 * n)
        if n:
            rows = pd.concat(held, ignore_index=True)
            yield call(rows, starts(rows))

    return df.repartition(*(deal or by)).sortWithinPartitions(*by, order).mapInPandas(run, schema)


def map_short(
    series: Series, needed: Sequence[str], call: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]], made: Sequence[T.StructField], grouped: bool = False
) -> DataFrame:
    """The rows of short series with the columns that ``call`` makes of whole ones, many at once.

    A call gets the columns ``needed`` (NULL as NaN) of rows sorted by key and index,
    and the place of every key's first row. What it returns under "keep" tells which
    rows stay, the rest are the columns ``made`` (NaN becomes NULL). The other columns
    stay as they are. Rows without a key are left out.

    ``grouped``: the rows are what this function returned for the same keys, selected
    at most, so that a key's rows lie together and in order. They aren't moved again.
    """
    keys, idx = list(series.keys), series.idx
    df = series.df if grouped else with_keys(series.df, keys).repartition(*keys).sortWithinPartitions(*keys, idx)
    schema = T.StructType([*df.schema.fields, *made])

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(len(rows), dtype=bool)
        new[:1] = True
        for k in keys:
            v = rows[k]
            new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy()
        return np.flatnonzero(new)

    def done(rows: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        got = call({c: rows[c].cast(pa.float64()).to_numpy() for c in needed}, at)
        keep = got.pop("keep", None)
        for f in made:
            v = got[f.name]
            rows = rows.append_column(f.name, pa.array(v, type=to_arrow_type(f.dataType), mask=np.isnan(v) if v.dtype.kind == "f" else None))
        yield from (rows if keep is None else rows.filter(pa.array(keep))).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, CALL_ROWS
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n < enough:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            at = starts(rows)
            if at[-1]:
                yield from done(rows.slice(0, at[-1]), at[:-1])
            # the last key may go on in the next batch
            held = rows.slice(at[-1]).to_batches()
            n = len(rows) - int(at[-1])
            enough = max(CALL_ROWS, 2 * n)
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from done(rows, starts(rows))

    return df.mapInArrow(run, schema)
