"""Data-quality checks over all surveys at once, the report and the gate.

Every check returns one row per survey: ``n_affected``, ``value`` (the measured
figure) and ``failed``; :func:`report` turns them into statuses.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import haversine_m, safe_div
from .ordered import Series, before, total
from .quantiles import median_mad, quantiles

# fixed values: contract of a raw reading and the gate action of each check
FIELD_RANGE_NT = (20_000.0, 80_000.0)
DEFECT_TYPES = ("scc", "weld", "dent", "corrosion", "interference", "none")
HEADS = ("b_lo_nt", "b_mid_nt", "b_hi_nt")
GATES = {
    "schema": "fail", "range": "fail", "saturation": "fail", "sample_idx_monotonic": "fail", "sample_idx_gap": "warn",
    "duplicate_sample_idx": "fail", "duplicate_content": "fail", "survey_overlap": "fail", "gps_jump": "warn",
    "gps_chainage_consistency": "warn", "noise_floor": "warn", "background_regime": "warn", "interference_density": "warn",
    "coverage": "warn",
}
READING_SCHEMA = T.StructType([
    T.StructField("line_id", T.StringType(), False),
    T.StructField("run_id", T.LongType(), False),
    T.StructField("sample_idx", T.LongType(), False),
    T.StructField("t_s", T.DoubleType(), False),
    T.StructField("lat", T.DoubleType(), True),
    T.StructField("lon", T.DoubleType(), True),
    T.StructField("b_lo_nt", T.DoubleType(), False),
    T.StructField("b_mid_nt", T.DoubleType(), False),
    T.StructField("b_hi_nt", T.DoubleType(), False),
    T.StructField("defect", T.LongType(), False),
    T.StructField("defect_type", T.StringType(), False),
    T.StructField("severity_smys", T.DoubleType(), True),
    T.StructField("interference", T.LongType(), False),
    T.StructField("girth_weld", T.LongType(), False),
    T.StructField("chainage_true_m", T.DoubleType(), False),
])


def reading_rules() -> dict[str, Column]:
    """Violation condition of each rule of a raw reading."""
    lo, hi = FIELD_RANGE_NT
    rules = {f"{f.name}_null": F.col(f.name).isNull() for f in READING_SCHEMA.fields if not f.nullable}
    rules |= {f"{h}_range": ~F.col(h).between(lo, hi) for h in HEADS}
    rules |= {f"{c}_flag": ~F.col(c).isin(0, 1) for c in ("defect", "interference", "girth_weld")}
    rules |= {f"{c}_negative": F.col(c) < 0 for c in ("run_id", "sample_idx", "t_s")}
    rules["defect_type_category"] = ~F.col("defect_type").isin(*DEFECT_TYPES)
    return rules


def contract(df: DataFrame, survey: str, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking at least one rule (each counted once) and breaches in all."""
    hit = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    any_hit = reduce(lambda a, b: a | b, hit.values())
    breaches = reduce(lambda a, b: a + b, [c.cast("long") for c in hit.values()])
    out = df.groupBy(survey).agg(F.count_if(any_hit).alias("n_affected"), F.sum(breaches).cast("double").alias("value"))
    return out.withColumn("failed", F.col("n_affected") > 0)


def failure_cases(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per offending row and rule."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(*keys, F.explode(names).alias("rule"))


def value_range(df: DataFrame, survey: str, columns: Sequence[str], lo: float, hi: float) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False)) for c in columns])
    out = df.groupBy(survey).agg(F.count_if(bad).alias("n_affected"))
    return _scored(out, F.col("n_affected").cast("double"), F.col("n_affected") > 0)


def saturation(series: Series, survey: str, columns: Sequence[str], run_length: int) -> DataFrame:
    """Rows in runs of at least ``run_length`` equal consecutive values, added up over the columns.

    ``value`` is the number of columns hit.
    """
    prior = series.running(**{f"__p{i}": before(F.col(c)) for i, c in enumerate(columns)})
    changed = {
        f"__r{i}": total(F.coalesce(F.col(c) != F.col(f"__p{i}"), F.lit(True)).cast("long")) for i, c in enumerate(columns)
    }
    runs = prior.running(**changed).df
    heads = F.explode(F.array(*[F.struct(F.lit(c).alias("head"), F.col(f"__r{i}").alias("run")) for i, c in enumerate(columns)]))
    keys = list(dict.fromkeys([survey, *series.keys]))
    sizes = runs.select(*keys, heads.alias("h")).groupBy(*keys, "h.head", "h.run").agg(F.count(F.lit(1)).alias("n"))
    long_runs = F.when(F.col("n") >= run_length, F.col("n"))
    out = sizes.groupBy(survey).agg(
        F.coalesce(F.sum(long_runs), F.lit(0)).alias("n_affected"),
        F.count_distinct(F.when(long_runs.isNotNull(), F.col("head"))).cast("double").alias("value"),
    )
    return out.withColumn("failed", F.col("n_affected") > 0)


def monotonic(file_rows: Series, survey: str, idx: str) -> DataFrame:
    """Steps of ``idx`` that do not increase, in the order the file was written."""
    prior = file_rows.running(__p=before(F.col(idx))).df
    out = prior.groupBy(survey).agg(F.count_if(F.col(idx) - F.col("__p") <= 0).alias("n_affected"))
    return _scored(out, F.col("n_affected").cast("double"), F.col("n_affected") > 0)


def index_gaps(series: Series, survey: str, step_m: float, max_gap_m: float) -> DataFrame:
    """Jumps of the sorted index beyond the allowed gap; ``value`` is the missing length.

    Repeated indexes are reduced to one row first, so a crowd of copies costs nothing.
    """
    idx = series.idx
    distinct = series.with_df(series.df.select(survey, *[k for k in series.keys if k != survey], idx).distinct())
    gap = F.col(idx) - F.col("__p")
    allowed = F.greatest(F.lit(1), F.bround(F.lit(max_gap_m / step_m)).cast("long"))
    wide = F.when(gap > allowed, gap)
    out = distinct.running(__p=before(F.col(idx))).df.groupBy(survey).agg(
        F.count(wide).alias("n_affected"), F.coalesce(F.sum((wide - 1) * F.lit(step_m)), F.lit(0.0)).alias("value")
    )
    return out.withColumn("failed", F.col("n_affected") > 0)


def duplicate_index(df: DataFrame, survey: str, idx: Sequence[str]) -> DataFrame:
    """Rows after the first of every key."""
    per_key = df.groupBy(survey, *idx).agg(F.count(F.lit(1)).alias("n"))
    out = per_key.groupBy(survey).agg(F.sum(F.col("n") - 1).alias("n_affected"))
    return _scored(out, F.col("n_affected").cast("double"), F.col("n_affected") > 0)


def duplicate_content(hashes: DataFrame, survey: str, content: str) -> DataFrame:
    """How many other surveys hold the same content, and the smallest id that does.

    The members of a group share ``content``, so the full list of copies is the
    rows of equal ``content``; pairs are never formed.
    """
    groups = hashes.groupBy(content).agg(F.count(F.lit(1)).alias("n"), F.min(survey).alias("first_survey"))
    out = hashes.select(survey, content).join(groups, content)
    return out.select(
        survey, content, "first_survey", (F.col("n") - 1).alias("n_affected"), (F.col("n") - 1).cast("double").alias("value"),
        (F.col("n") > 1).alias("failed"),
    )


def overlap_pairs(extents: DataFrame, line: str, survey: str) -> DataFrame:
    """Surveys of one line whose extents overlap, with the common range; each pair once.

    One line per survey extent: a survey meets only surveys of its own line.
    """
    a = extents.select(line, F.col(survey).alias("a"), F.col("start_m").alias("a0"), F.col("end_m").alias("a1"), F.col("step_m").alias("step_a"))
    b = extents.select(line, F.col(survey).alias("b"), F.col("start_m").alias("b0"), F.col("end_m").alias("b1"))
    lo, hi = F.greatest("a0", "b0"), F.least("a1", "b1")
    return a.join(b, line).filter((F.col("a") < F.col("b")) & (lo < hi)).select(line, "a", "b", lo.alias("lo"), hi.alias("hi"), "step_a")


def overlap_correlation(
    rows: DataFrame, extents: DataFrame, line: str, survey: str, idx: str, signal: str, min_rows: int = 10, fresh: DataFrame | None = None
) -> DataFrame:
    """Pearson r of the signal over the common index window of every overlapping pair.

    With ``fresh`` only pairs with at least one of those surveys are looked at.

    An index that a survey repeats counts once, with the mean. Rows of the two
    surveys meet on ``(line, idx)``; the sums behind r are built
    map-side, so a pair needs one small record per task.
    """
    pairs = overlap_pairs(extents, line, survey)
    if fresh is not None:
        new = fresh.select(F.col(survey).alias("__s")).distinct().withColumn("__new", F.lit(True))
        for side in ("a", "b"):
            pairs = pairs.join(new.select(F.col("__s").alias(side), F.col("__new").alias(f"__{side}")), side, "left")
        pairs = pairs.filter("__a or __b").drop("__a", "__b")
    # one row per index, so that a file that repeats an index meets another one row by row, not all by all
    single = rows.groupBy(line, survey, idx).agg(F.avg(signal).alias("__v"))
    left = single.select(line, F.col(survey).alias("a"), F.col(idx).alias("__i"), F.col("__v").alias("x"))
    right = single.select(line, F.col(survey).alias("b"), F.col(idx).alias("__i"), F.col("__v").alias("y"))
    window = (F.col("__i") >= F.expr("cast(lo / step_a as long)")) & (F.col("__i") <= F.expr("cast(hi / step_a as long)"))
    joined = left.join(pairs, [line, "a"]).filter(window).join(right, [line, "b", "__i"])
    return joined.groupBy(line, "a", "b").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_rows)


def overlap_check(corr: DataFrame, surveys: DataFrame, survey: str, threshold: float) -> DataFrame:
    sides = corr.select(F.col("a").alias(survey), F.col("b").alias("other"), "r").unionByName(
        corr.select(F.col("b").alias(survey), F.col("a").alias("other"), "r")
    )
    worst = sides.filter("r is not null").groupBy(survey).agg(F.max(F.abs("r")).alias("value"), F.max_by("other", F.abs("r")).alias("other"))
    out = surveys.select(survey).distinct().join(worst, survey, "left")
    bad = F.coalesce(F.col("value") > threshold, F.lit(False))
    return out.select(
        survey, F.when(bad, F.col("other")).alias("overlap_with"), bad.cast("long").alias("n_affected"),
        F.coalesce("value", F.lit(0.0)).alias("value"), bad.alias("failed"),
    )


def _fix_steps(series: Series, lat: str, lon: str) -> DataFrame:
    """Distance from the previous locked fix, on locked rows."""
    fixes = series.with_df(series.df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()))
    steps = fixes.running(__plat=before(F.col(lat)), __plon=before(F.col(lon))).df
    return steps.withColumn("__d", haversine_m(F.col("__plat"), F.col("__plon"), F.col(lat), F.col(lon)))


def jump_distance(series: Series, survey: str, lat: str, lon: str, max_jump_m: float) -> DataFrame:
    """Steps between consecutive fixes longer than allowed; ``value`` is the longest step."""
    out = _fix_steps(series, lat, lon).groupBy(survey).agg(
        F.count_if(F.col("__d") > max_jump_m).alias("n_affected"), F.coalesce(F.max("__d"), F.lit(0.0)).alias("value")
    )
    return out.withColumn("failed", F.col("n_affected") > 0)


def path_vs_span(series: Series, survey: str, lat: str, lon: str, axis: str, tolerance: float = 0.02) -> DataFrame:
    """Relative difference between the summed fix steps and the axis span of the fixes."""
    span = F.max(axis) - F.min(axis)
    out = _fix_steps(series, lat, lon).groupBy(survey).agg(F.coalesce(F.sum("__d"), F.lit(0.0)).alias("path"), span.alias("span"))
    value = F.coalesce(safe_div(F.abs(F.col("path") - F.col("span")), F.col("span")), F.lit(0.0))
    out = out.select(survey, value.alias("value"))
    bad = F.col("value") > tolerance
    return out.select(survey, bad.cast("long").alias("n_affected"), "value", bad.alias("failed"))


def noise_floor(series: Series, survey: str, columns: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Standard deviation of first differences over the square root of two, per column; columns outside the range are counted."""
    prior = series.running(**{f"__p{i}": before(F.col(c)) for i, c in enumerate(columns)}).df
    sig = [F.stddev_pop(F.col(c) - F.col(f"__p{i}")) / F.sqrt(F.lit(2.0)) for i, c in enumerate(columns)]
    out = prior.groupBy(survey).agg(*[s.alias(f"__s{i}") for i, s in enumerate(sig)])
    bad = reduce(lambda a, b: a + b, [
        F.coalesce((F.col(f"__s{i}") < lo) | (F.col(f"__s{i}") > hi), F.lit(False)).cast("long") for i in range(len(columns))
    ])
    worst = F.greatest(*[F.col(f"__s{i}") for i in range(len(columns))]) if len(columns) > 1 else F.col("__s0")
    return out.select(survey, bad.alias("n_affected"), worst.alias("value"), (bad > 0).alias("failed"))


def regime_shift(
    rows: DataFrame, line: str, survey: str, columns: Sequence[str], z_threshold: float = 3.0, longest: int | None = None
) -> DataFrame:
    """z of a survey's median against the medians of the other surveys of its line, per column.

    Leave-one-out mean and deviation come from each line's sums, taken around the
    line's mean, so no survey is paired with another. Fewer than two others, or
    no spread among them, gives no z.
    """
    long = rows.select(line, survey, F.explode(F.array(*[
        F.struct(F.lit(c).alias("head"), F.col(c).cast("double").alias("x")) for c in columns
    ])).alias("h")).select(line, survey, "h.head", "h.x")
    med = quantiles(long, [line, survey, "head"], "x", {"med": 0.5}, longest).drop("n")
    return loo_z(med, [line, "head"], "med").groupBy(survey).agg(
        F.count_if(F.col("z") > z_threshold).alias("n_affected"), F.max("z").alias("value")
    ).withColumn("failed", F.col("n_affected") > 0)


def loo_z(medians: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    centre = medians.groupBy(*group).agg(
        F.avg(value).alias("__c"), F.count(value).alias("__n"), (F.var_pop(value) * F.count(value)).alias("__ss")
    )
    d = F.col(value) - F.col("__c")
    m = F.col("__n") - 1
    # sums of the others around the line mean: -d and ss - d^2
    mean_others = safe_div(-d, m)
    var_others = safe_div(F.col("__ss") - d * d - safe_div(d * d, m), m - 1)
    std = F.sqrt(F.when(var_others > 1e-13 * F.col("__ss"), var_others))
    z = F.when(m >= 2, F.abs(d - mean_others) / std)
    return medians.join(centre, list(group)).withColumn("z", z).drop("__c", "__n", "__ss")


def outlier_density(
    rows: DataFrame, survey: str, column: str, expected: float = 0.05, limit: float = 5.0, longest: int | None = None
) -> DataFrame:
    """Share of rows whose robust z exceeds the limit."""
    stats = median_mad(rows, [survey], column, longest)
    mad = F.when(F.col("mad") == 0, F.lit(1e-9)).otherwise(F.col("mad"))
    z = F.lit(0.6745) * (F.col(column) - F.col("med")) / mad
    out = rows.join(stats, survey).groupBy(survey).agg(
        F.count_if(F.abs(z) > limit).alias("n_affected"), F.avg((F.abs(z) > limit).cast("double")).alias("value")
    )
    return out.withColumn("failed", F.col("value") > expected)


def coverage(rows: DataFrame, expected: DataFrame, survey: str, axis: str, minimum: float = 0.95) -> DataFrame:
    """Walked extent over the declared length; without one the check passes."""
    ext = rows.groupBy(survey).agg((F.max(axis) - F.min(axis)).alias("__len"))
    out = ext.join(expected.select(survey, "expected_length_m"), survey, "left").withColumn(
        "value", safe_div(F.col("__len"), F.col("expected_length_m"))
    )
    bad = F.coalesce(F.col("value") < minimum, F.lit(False))
    return out.select(survey, bad.cast("long").alias("n_affected"), "value", bad.alias("failed"))


def report(checks: Mapping[str, DataFrame], survey: str, gates: Mapping[str, str] = GATES) -> DataFrame:
    """All checks as one table: survey, check, status, affected rows, detail as JSON."""
    parts = []
    for name, df in checks.items():
        detail = [c for c in df.columns if c not in (survey, "n_affected", "failed")]
        parts.append(df.select(
            F.col(survey), F.lit(name).alias("check_name"),
            F.when(F.col("failed"), F.lit(gates.get(name, "warn"))).otherwise("pass").alias("status"),
            F.col("n_affected").cast("long").alias("n_affected"),
            F.to_json(F.struct(*detail)).alias("detail"),
        ))
    return reduce(DataFrame.unionByName, parts)


def gate(dq: DataFrame, survey: str) -> DataFrame:
    """Counts per status and the verdict: any failed check quarantines the survey."""
    n = {s: F.count_if(F.col("status") == s) for s in ("pass", "warn", "fail")}
    out = dq.groupBy(survey).agg(*[c.alias(f"n_{s}") for s, c in n.items()])
    return out.withColumn("verdict", F.when(F.col("n_fail") > 0, "quarantined").otherwise("accepted"))


def _scored(df: DataFrame, value: Column, failed: Column) -> DataFrame:
    return df.select("*", value.alias("value"), failed.alias("failed"))


def feature_contract(df: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Repeated keys, missing values in required features and unknown flags, one row per survey."""
    survey = keys[0]
    holes = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in required])
    rows = df.groupBy(survey).agg(
        F.count_if(holes).alias("n_holes"), F.count_if(~F.col("dq_flag").isin("clean", "edge")).alias("n_flags")
    )
    repeats = df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).groupBy(survey).agg(F.sum("n").alias("n_repeats"))
    return rows.join(repeats, survey)
