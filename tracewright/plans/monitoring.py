"""Monitoring job: predicted surveys against what their release saw in training."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drift, quality
from ..operators.guards import GuardError
from ..operators.islands import extents
from ..session import cut

PREDICTION = "prediction"


@dataclass(frozen=True)
class MonitorLimits:
    psi_warn: float = 0.2
    psi_block: float = 0.3
    rate_ratio: float = 3.0
    regime_z: float = 3.0


@dataclass(frozen=True)
class Reference:
    """Bins and a bounded sample per feature and of the predictions, and the indications per km of the training surveys."""

    sample: drift.StoredSample
    columns: tuple[str, ...]
    probability: str
    rate: float


@dataclass(frozen=True)
class Monitored:
    """``report``: one row a survey. The others hold a row per survey and feature, per survey, per survey."""

    report: DataFrame
    features: DataFrame
    predictions: DataFrame
    regime: DataFrame


def training_reference(
    rows: DataFrame, row_id: str, columns: Sequence[str], indications: DataFrame, probability: str, bins: int = 10, size: int = 2000, seed: int = 42
) -> Reference:
    """What a release keeps of its training surveys."""
    seen = drift.unpivot(rows, columns, [row_id])
    shown = drift.unpivot(indications.withColumn(PREDICTION, F.col(probability)), [PREDICTION], ["indication_id"])
    edges = drift.feature_summary(seen.select("feature", "x").unionByName(shown.select("feature", "x")), bins).select("feature", "bin_edges")
    one = drift.reference_sample(seen, ["feature"], F.col(row_id).cast("string"), size, seed).select("feature", "x")
    two = drift.reference_sample(shown, ["feature"], F.col("indication_id"), size, seed).select("feature", "x")
    km = drift.surveyed_km(extents(rows, ["survey_id"], "chainage_m")).first()["km"]
    return Reference(drift.StoredSample(one.unionByName(two), edges), tuple(columns), probability, indications.count() / km if km else 0.0)


def monitor_surveys(
    asked: DataFrame, registry: DataFrame, rows: DataFrame, indications: DataFrame, reference: Reference, heads: Sequence[str],
    limits: MonitorLimits = MonitorLimits(), coverage: DataFrame | None = None,
) -> Monitored:
    """Status of every asked survey: the worst of its checks, of which only feature drift may block.

    ``asked``: survey_id. ``registry``: survey_id, line_id, status. ``rows``: the
    features of all accepted surveys, also those the background is compared with.
    ``indications``: those of the release. ``coverage``: one row with
    ``below_nominal``, which warns every survey of the release.

    A survey that is not registered or not accepted stops the job, as does one
    without features. One without indications has no prediction test; its rate is 0.
    """
    asked = cut(asked.select("survey_id").distinct())
    refused = asked.join(registry.filter("status = 'accepted'"), "survey_id", "left_anti").orderBy("survey_id").limit(5).collect()
    if refused:
        raise GuardError(f"surveys that may not be monitored: {[r['survey_id'] for r in refused]}")
    mine = rows.join(asked, "survey_id", "left_semi")
    empty = asked.join(mine.select("survey_id").distinct(), "survey_id", "left_anti").orderBy("survey_id").limit(5).collect()
    if empty:
        raise GuardError(f"surveys without features: {[r['survey_id'] for r in empty]}")

    long = drift.unpivot(mine, reference.columns, ["survey_id"])
    features = reference.sample.psi(long, ["survey_id"]).join(reference.sample.ks(long, ["survey_id"]), ["survey_id", "feature"])
    level = F.when(F.col("psi") >= limits.psi_block, "block").when(F.col("psi") >= limits.psi_warn, "warn").otherwise("ok")
    features = cut(features.withColumn("status", level))

    found = indications.join(asked, "survey_id", "left_semi")
    shown = drift.unpivot(found.withColumn(PREDICTION, F.col(reference.probability)), [PREDICTION], ["survey_id"])
    rate = drift.indications_per_km(found, extents(mine, ["survey_id"], "chainage_m"), "survey_id")
    ratio = F.col("rate") / F.lit(reference.rate) if reference.rate else F.lit(None).cast("double")
    outside = F.coalesce(~F.col("ratio").between(1.0 / limits.rate_ratio, limits.rate_ratio), F.lit(False))
    predictions = rate.withColumn("ratio", ratio).join(reference.sample.ks(shown, ["survey_id"]).drop("feature"), "survey_id", "left").withColumn("flagged", outside)
    predictions = cut(predictions)

    known = registry.filter("status = 'accepted'").select("survey_id", "line_id")
    lines = known.join(asked, "survey_id", "left_semi").select("line_id").distinct()
    beside = rows.drop("line_id").join(known.join(lines, "line_id", "left_semi"), "survey_id")
    regime = cut(quality.regime_shift(beside, "line_id", "survey_id", heads, limits.regime_z).join(asked, "survey_id", "left_semi"))

    raised = lambda flag: F.when(flag, "warn").otherwise("ok").alias("status")
    checks = [
        features.select("survey_id", F.lit("feature_drift").alias("check_name"), "status"),
        predictions.select("survey_id", F.lit("prediction_drift").alias("check_name"), raised(F.col("flagged"))),
        regime.select("survey_id", F.lit("background_regime").alias("check_name"), raised(F.col("failed"))),
    ]
    if coverage is not None:
        stale = F.broadcast(coverage.select("below_nominal"))
        checks.append(asked.crossJoin(stale).select("survey_id", F.lit("coverage").alias("check_name"), raised(F.col("below_nominal"))))
    worst = features.groupBy("survey_id").agg(
        F.max("psi").alias("psi_max"), F.max_by("feature", F.struct("psi", "feature")).alias("psi_feature"), F.count_if(F.col("status") == "block").alias("n_blocking"), F.max("ks_stat").alias("ks_max")
    )
    report = drift.monitor(checks, "survey_id").join(worst, "survey_id", "left").join(
        predictions.select("survey_id", "rate", "ratio", F.col("ks_stat").alias("prediction_ks")), "survey_id", "left"
    ).join(regime.select("survey_id", F.col("n_affected").alias("n_shifted")), "survey_id", "left")
    return Monitored(report, features, predictions, regime)
