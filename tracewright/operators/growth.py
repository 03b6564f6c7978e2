"""Growth per object, pooled and shrunk rates, remaining life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_div

INF = float("inf")


def log_slopes(obs: DataFrame, obj: str, x: str, y: str) -> DataFrame:
    """Least-squares slope of ln(y) on x per object, and its variance from the residuals.

    Fewer than three points leave the variance unknown; equal x leave both unknown.
    """
    ly = F.ln(F.when(F.col(y) > 0, F.col(y)))
    rows = obs.select(obj, F.col(x).cast("double").alias("__x"), ly.alias("__y"))
    means = rows.groupBy(obj).agg(
        F.count(F.lit(1)).alias("n_obs"), F.count("__y").alias("__ok"), F.avg("__x").alias("__mx"), F.avg("__y").alias("__my")
    )
    dx, dy = F.col("__x") - F.col("__mx"), F.col("__y") - F.col("__my")
    centred = rows.join(means, obj)
    fit = centred.groupBy(obj, "n_obs", "__ok", "__mx", "__my").agg(F.sum(dx * dx).alias("sxx"), F.sum(dx * dy).alias("sxy"))
    usable = (F.col("sxx") > 0) & (F.col("__ok") == F.col("n_obs"))
    fit = fit.withColumn("slope", F.when(usable, safe_div(F.col("sxy"), F.col("sxx"))))
    # residuals are summed row by row: the difference of sums would lose a nearly exact fit
    e = dy - F.col("slope") * dx
    sse = rows.join(fit.select(obj, "__mx", "__my", "slope"), obj).groupBy(obj).agg(F.sum(e * e).alias("sse"))
    var = F.when(F.col("slope").isNotNull() & (F.col("n_obs") > 2), safe_div(safe_div(F.col("sse"), F.col("n_obs") - 2), F.col("sxx")))
    return fit.join(sse, obj).select(obj, "n_obs", "slope", var.alias("slope_var"))


def pooled_rate(slopes: DataFrame) -> DataFrame:
    """One row: inverse-variance mean of the slopes and its variance.

    An unknown or zero variance weighs 1; without any slope the rate is 0 with infinite variance.
    """
    w = F.when(F.col("slope_var") > 0, 1.0 / F.col("slope_var")).otherwise(F.lit(1.0))
    used = slopes.filter((F.col("n_obs") >= 2) & F.col("slope").isNotNull())
    one = used.agg(F.sum(w * F.col("slope")).alias("a"), F.sum(w).alias("b"), F.count(F.lit(1)).alias("n_slopes"))
    return one.select(
        F.coalesce(safe_div(F.col("a"), F.col("b")), F.lit(0.0)).alias("pooled_rate"),
        F.coalesce(safe_div(F.lit(1.0), F.col("b")), F.lit(INF)).alias("pooled_var"), "n_slopes",
    )


def shrunk_rates(slopes: DataFrame, pooled: DataFrame, obj: str, min_obs: int) -> DataFrame:
    """Own rate pulled toward the pooled one by precision.

    Two observations borrow the pooled variance; too few or no slope take the pooled rate.
    """
    both = slopes.crossJoin(F.broadcast(pooled.select("pooled_rate", "pooled_var")))  # a single row
    own = F.when(F.col("n_obs") >= min_obs, F.col("slope"))
    own_var = F.when(own.isNotNull(), F.coalesce("slope_var", "pooled_var"))
    finite_pos = lambda c: F.when((c > 0) & (c < INF), 1.0 / c).otherwise(F.lit(0.0))
    p_own, p_pop = finite_pos(own_var), finite_pos(F.col("pooled_var"))
    weight = F.when(own.isNull(), F.lit(0.0)).otherwise(F.coalesce(safe_div(p_own, p_own + p_pop), F.lit(0.0)))
    rate = F.when(own.isNull(), F.col("pooled_rate")).otherwise(weight * own + (1 - weight) * F.col("pooled_rate"))
    return both.select(
        obj, "n_obs", own.alias("own_rate"), own_var.alias("own_var"), rate.alias("shrunk_rate"), weight.alias("shrinkage_weight")
    )


def fit_rates(obs: DataFrame, obj: str, x: str, y: str, min_obs: int) -> DataFrame:
    slopes = log_slopes(obs, obj, x, y)
    return shrunk_rates(slopes, pooled_rate(slopes), obj, min_obs)


def gate_errors(obs: DataFrame, obj: str, run: str, y: str, train_runs: list[int], test_run: int, min_obs: int) -> DataFrame:
    """Per test row: error of the projected value and of assuming no growth, from the last training value."""
    train = obs.filter(F.col(run).isin(train_runs))
    last = train.groupBy(obj).agg(F.max_by(F.struct(F.col(run), F.col(y)), F.col(run)).alias("l"))
    rates = fit_rates(train, obj, run, y, min_obs).select(obj, "shrunk_rate")
    test = obs.filter(F.col(run) == test_run).select(obj, F.col(run).alias("__r"), F.col(y).alias("__y"))
    joined = test.join(last, obj).join(rates, obj)
    grown = F.col(f"l.{y}") * F.exp(F.col("shrunk_rate") * (F.col("__r") - F.col(f"l.{run}")))
    return joined.select(obj, F.abs(grown - F.col("__y")).alias("model_error"), F.abs(F.col(f"l.{y}") - F.col("__y")).alias("no_growth_error"))


def life(current: Column, rate: Column, limit: float) -> Column:
    return (
        F.when(current.isNull(), F.lit(None).cast("double"))
        .when((current <= 0) | (current >= limit), F.lit(0.0))
        .when(rate <= 0, F.lit(INF))
        .otherwise((F.ln(F.lit(float(limit))) - F.ln(F.when(current > 0, current))) / F.when(rate > 0, rate))
    )


def remaining_life(df: DataFrame, lo: str, med: str, hi: str, rate: str, limit: float) -> DataFrame:
    """Intervals until the limit; a higher present value leaves less, so the ends swap."""
    r = F.col(rate)
    return df.select(
        "*", life(F.col(hi), r, limit).alias("life_lo"), life(F.col(med), r, limit).alias("life_med"), life(F.col(lo), r, limit).alias("life_hi")
    )


def growth_frame(matched: DataFrame, rows: DataFrame, runs: DataFrame, source: str = "matched_source_id") -> DataFrame:
    """Severity at the peak of every matched defect, per source and run; unknown severities are left out."""
    truth = rows.select("survey_id", F.col("sample_idx").alias("peak_sample_idx"), F.col("severity_smys").alias("y_true"))
    hits = matched.filter(F.col("matched_kind") == "defect").join(truth, ["survey_id", "peak_sample_idx"], "left")
    return hits.join(runs.select("survey_id", "run_id").distinct(), "survey_id").filter("y_true is not null").select(
        source, "survey_id", "run_id", "y_true", "distance_m"
    )


def latest_run(df: DataFrame, obj: str, run: str) -> DataFrame:
    cols = [c for c in df.columns if c != obj]
    return df.groupBy(obj).agg(F.max_by(F.struct(*cols), F.col(run)).alias("__r")).select(obj, "__r.*")
