"""Runs of adjacent rows: indications, label registries, dropouts; ranking and thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import deterministic_id
from .ordered import Series, cumulate, order_rows, position, total


def mark_runs(series: Series, inside: Column, run: str = "run") -> DataFrame:
    """Only the rows where ``inside`` holds, with a run number: adjacent rows share it.

    The number is the count of outside rows so far, so one running total finds
    all runs; rows missing from the numbering do not split a run.
    """
    hit = F.coalesce(inside, F.lit(False))
    marked = series.with_df(series.df.withColumn("__in", hit)).running(**{run: total((~F.col("__in")).cast("long"))})
    return marked.df.filter("__in").drop("__in")


def cluster_indications(
    series: Series,
    score: str,
    threshold: Column | float,
    version: str,
    chainage: str = "chainage_m",
    carry: tuple[str, ...] = (),
    edge: Column | None = None,
    survey: str = "survey_id",
    rank: bool = True,
    is_shadow: bool = False,
) -> DataFrame:
    """Runs of rows scoring above the threshold, each reduced to its extent and first maximum.

    ``carry`` columns are taken from the peak row. ``p_defect_cal`` is the share
    of the survey's rows scoring at most the peak.
    """
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    idx = series.idx
    rows = mark_runs(series, F.col(score) > threshold)
    peak = F.struct(F.col(idx), F.col(chainage), F.col(score), *[F.col(c) for c in carry])
    flag = edge if edge is not None else F.lit(False)
    keys = list(dict.fromkeys([*series.keys, survey]))
    got = rows.groupBy(*keys, "run").agg(
        F.max_by(peak, F.struct(F.col(score), -F.col(idx))).alias("p"),
        F.min(chainage).alias("chainage_start_m"),
        F.max(chainage).alias("chainage_end_m"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max(flag.cast("int")).alias("edge"),
    )
    out = got.select(
        *keys,
        F.col(f"p.{idx}").alias("peak_sample_idx"),
        F.col(f"p.{chainage}").alias("chainage_peak_m"),
        "chainage_start_m",
        "chainage_end_m",
        "n_rows",
        F.col(f"p.{score}").alias("anomaly_score"),
        *[F.col(f"p.{c}").alias(c) for c in carry],
        F.when(F.col("edge") == 1, "edge").otherwise("clean").alias("dq_flag"),
        F.lit(version).alias("pipeline_version"),
        F.lit(int(is_shadow)).alias("is_shadow"),
    )
    out = out.withColumn(
        "indication_id",
        deterministic_id(F.col(survey).cast("string"), F.col("pipeline_version"), F.col("peak_sample_idx"), F.col("chainage_peak_m")),
    )
    if rank:
        ranks = percentile_rank(series.df, list(series.keys), score).withColumnRenamed("value", "anomaly_score")
        out = out.join(ranks, [*series.keys, "anomaly_score"], "left").withColumnRenamed("share", "p_defect_cal")
    return out


def percentile_rank(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Per key and distinct score: the share of the key's rows scoring at most that (null scores count below the line only)."""
    steps = cumulate(df.filter(F.col(score).isNotNull()), keys, score, {"n": F.lit(1)}).df
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    return steps.join(sizes, keys).select(*keys, F.col(score).alias("value"), (F.col("cum_n") / F.col("__all")).alias("share"))


def select_budget(
    indications: DataFrame,
    extents: DataFrame,
    digs_per_km: float,
    survey: str = "survey_id",
    score: str = "anomaly_score",
    tie: str = "peak_sample_idx",
) -> DataFrame:
    """The best ``max(1, round(digs_per_km * km))`` indications of every survey, ranked.

    ``extents`` has ``length_m`` per survey. Rounding is half to even.
    """
    budget = extents.select(
        survey, F.greatest(F.lit(1), F.bround(F.lit(float(digs_per_km)) * F.col("length_m") / 1000.0).cast("long")).alias("budget")
    )
    ranked = order_rows(indications, [survey], [F.col(score).desc(), F.col(tie)], idx="rank").df
    return ranked.join(budget, survey).filter(F.col("rank") < F.col("budget")).withColumn("rank", F.col("rank") + 1)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every key, with their rank from 1.

    A row_number bounded by a filter keeps only k rows per key and task before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def ranked_list(indications: DataFrame, n: int, metric: str = "risk_score", tie: str = "indication_id") -> DataFrame:
    """The ``n`` indications with the highest risk, missing risk last."""
    return indications.orderBy(F.col(metric).desc_nulls_last(), F.col(tie)).limit(n)


def truth_registry(series: Series, line: str, chainage: str, flags: dict[str, Column], kind_of: Column | None = None) -> DataFrame:
    """Contiguous labelled runs of each flag become sources numbered along the line."""
    parts = []
    kind_of = kind_of if kind_of is not None else F.lit(None).cast("string")
    for kind, flag in flags.items():
        rows = mark_runs(series, flag)
        parts.append(
            rows.groupBy(*dict.fromkeys([*series.keys, line]), "run").agg(
                F.lit(kind).alias("kind"),
                F.min_by(kind_of, F.col(series.idx)).alias("defect_type"),
                F.avg(chainage).alias("chainage_m"),
                F.min(chainage).alias("chainage_start_m"),
                F.max(chainage).alias("chainage_end_m"),
                F.min(series.idx).alias("start_idx"),
                F.max(series.idx).alias("end_idx"),
            )
        )
    runs = parts[0]
    for p in parts[1:]:
        runs = runs.unionByName(p)
    numbered = order_rows(runs, [line, "kind"], ["start_idx"], idx="number").df
    return numbered.select(
        F.format_string("%s_%s_%02d", F.col(line).cast("string"), "kind", "number").alias("source_id"),
        line, "kind", "defect_type", "chainage_m", "chainage_start_m", "chainage_end_m", "start_idx", "end_idx",
    )


def reference_rows(df: DataFrame, line: str, survey: str) -> DataFrame:
    """The rows of the smallest survey id of every line, the one sources are read from."""
    first = df.groupBy(line).agg(F.min(survey).alias(survey))
    return df.join(first, [line, survey], "left_semi")


def run_bounds(series: Series, inside: Column, axis: str) -> DataFrame:
    """Start, end, midpoint and size of every run."""
    rows = mark_runs(series, inside)
    return rows.groupBy(*series.keys, "run").agg(
        F.min(axis).alias("start"),
        F.max(axis).alias("end"),
        ((F.min(axis) + F.max(axis)) / 2).alias("midpoint"),
        F.min(series.idx).alias("start_idx"),
        F.max(series.idx).alias("end_idx"),
        F.count(F.lit(1)).alias("n_rows"),
    ).drop("run")


def bridged_gaps(series: Series, present: Column, axis: str) -> DataFrame:
    """Runs of rows without a fix and the distance they bridge.

    The distance is the axis difference between the first and the last row of the run.
    """
    return run_bounds(series, ~present, axis).select(
        *series.keys, "start_idx", (F.col("end_idx") + 1).alias("end_idx"), "n_rows", (F.col("end") - F.col("start")).alias("bridged")
    )


def block_heatmap(indications: DataFrame, line: str, chainage: str, block_m: float, metric: Column) -> DataFrame:
    """Maximum metric and count per line and block; rows without a metric are dropped."""
    block = F.floor(F.col(chainage) / block_m) * F.lit(block_m)
    return (
        indications.select(line, block.alias("block_start_m"), metric.alias("__m"))
        .filter("__m is not null")
        .groupBy(line, "block_start_m")
        .agg(F.max("__m").alias("max_metric"), F.count(F.lit(1)).alias("n"))
    )


def metric_or_fallback(df: DataFrame, preferred: str, fallback: str) -> DataFrame:
    """Table-wide choice: ``preferred`` if any row has it, else ``fallback``; adds ``metric_name`` and ``metric``."""
    has = df.agg(F.coalesce(F.max(F.col(preferred).isNotNull()), F.lit(False)).alias("__has"))
    return df.crossJoin(F.broadcast(has)).select(
        *df.columns,
        F.when(F.col("__has"), F.lit(preferred)).otherwise(F.lit(fallback)).alias("metric_name"),
        F.when(F.col("__has"), F.col(preferred)).otherwise(F.col(fallback)).alias("metric"),
    )


def thin(series: Series, target: int) -> DataFrame:
    """Every ``max(1, n div target)``-th row of each key, for display."""
    sizes = series.df.groupBy(*series.keys).agg(F.greatest(F.lit(1), F.expr(f"count(1) div {target}")).alias("__stride"))
    cols = series.df.columns
    return series.running(__pos=position()).df.join(sizes, list(series.keys)).filter(F.pmod("__pos", "__stride") == 0).select(*cols)


def heat_points(df: DataFrame, lat: str, lon: str, weight: str) -> DataFrame:
    """Located rows with weights not below zero."""
    return df.dropna(subset=[lat, lon]).withColumn(weight, F.greatest(F.col(weight), F.lit(0.0)))


def extents(df: DataFrame, keys: list[str], axis: str) -> DataFrame:
    return df.groupBy(*keys).agg((F.max(axis) - F.min(axis)).alias("length_m"))
