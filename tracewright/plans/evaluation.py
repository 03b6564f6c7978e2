"""Evaluation jobs: detection metrics with intervals, cross-validation schemes, ablation, transfer."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import group_key, hash_fold
from ..operators import metrics
from ..operators.islands import cluster_indications, extents, select_budget
from ..operators.learn import (
    ClassModel, IsolationForest, MadModel, SeverityModel, fold_parts, out_of_fold_forest, predict_classes, predict_severity, split_for_calibration,
)
from ..operators.matching import attach_peak_rows, attach_truth, pair_values
from ..operators.ordered import indexed
from ..session import cut
from .jobs import match_surveys

# fixed values: limits of the release gates
RECALL_GAP_MIN = 0.15
COVERAGE_BAND = (0.87, 0.93)
CLASS_RECALL_MIN = 0.90


@dataclass(frozen=True)
class Scoring:
    """A score column and the threshold above which a row belongs to an indication."""

    name: str
    column: str
    threshold: float


def detect(rows: DataFrame, scoring: Scoring, registry: DataFrame, digs_per_km: float, tolerance: float, version: str = "eval") -> DataFrame:
    """Clusters of all surveys, cut to the budget of each survey's own extent and matched to its line's sources.

    ``rows``: survey_id, line_id, sample_idx, chainage_m and the score.
    """
    series = indexed(rows, ["survey_id"], "sample_idx")
    found = cluster_indications(series, scoring.column, scoring.threshold, version, carry=("line_id",), rank=False)
    best = select_budget(found, extents(rows, ["survey_id"], "chainage_m"), digs_per_km)
    return match_surveys(cut(best), registry, rows.select("line_id", "survey_id").distinct(), tolerance)


def recall_units(dug: DataFrame, registry: DataFrame, rows: DataFrame) -> DataFrame:
    """Share of its line's surveys in which each defect was dug up."""
    hits = dug.select("survey_id", F.col("matched_source_id").alias("source_id"))
    surveys = rows.select("line_id", "survey_id").distinct()
    return metrics.hit_rates(hits, registry, surveys, "line_id", "survey_id", "source_id")


def detection_units(dug: DataFrame, registry: DataFrame, rows: DataFrame) -> DataFrame:
    """(metric, unit, value): recall per source, dig shares per survey, localisation error per match."""
    recall = recall_units(dug, registry, rows).select(F.lit("recall").alias("metric"), F.col("source_id").alias("unit"), F.col("hit_rate").alias("value"))
    digs = metrics.dig_rates(dug, rows, "survey_id", "matched_kind")
    shares = [digs.select(F.lit(c).alias("metric"), F.col("survey_id").alias("unit"), F.col(c).alias("value")) for c in ("false_dig_rate", "interference_fraction")]
    err = metrics.localisation_errors(dug).select(F.lit("localisation_m").alias("metric"), F.col("indication_id").alias("unit"), F.col("distance_m").alias("value"))
    return reduce(DataFrame.unionByName, [recall, *shares, err])


def detection_report(rows: DataFrame, scorings: Sequence[Scoring], registry: DataFrame, digs_per_km: float, tolerance: float, resamples: int = 500, seed: int = 42) -> DataFrame:
    """Recall, false-dig rate and localisation error of each scoring with 95% intervals.

    Recall is resampled over sources, the false-dig rate over surveys, the error over matches.
    """
    parts = [detection_units(cut(detect(rows, s, registry, digs_per_km, tolerance)), registry, rows).withColumn("scoring", F.lit(s.name)) for s in scorings]
    units = cut(reduce(DataFrame.unionByName, parts).filter("metric <> 'interference_fraction'"))
    return metrics.bootstrap(units, ["scoring", "metric"], "unit", ["value"], resamples, 0.95, seed)


def recall_gap(rows: DataFrame, better: Scoring, base: Scoring, registry: DataFrame, digs_per_km: float, tolerance: float, resamples: int = 500, seed: int = 42) -> DataFrame:
    """Paired difference in recall over the same sources; the gate asks its lower end to reach the margin."""
    sides = [
        recall_units(cut(detect(rows, s, registry, digs_per_km, tolerance)), registry, rows).select("source_id", F.col("hit_rate").alias("value")) for s in (better, base)
    ]
    pairs = cut(pair_values(sides[0], sides[1], "source_id"))
    ci = metrics.paired_bootstrap(pairs, [], "source_id", "a", "b", resamples, 0.95, seed)
    return metrics.gate_lower_bound(ci, "delta_lo", RECALL_GAP_MIN)


def block_folds(rows: DataFrame, block_m: float, folds: int) -> DataFrame:
    return metrics.with_fold(rows, group_key(F.col("line_id"), F.col("chainage_m"), block_m), folds)


def line_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Whole lines stay in one fold."""
    return rows.withColumn("fold", hash_fold(F.col("line_id").cast("string"), folds))


def held_out_scores(rows: DataFrame, folds: int, row_id: str, forest: IsolationForest) -> DataFrame:
    """Rows with ``score`` from a forest that never saw their fold."""
    return out_of_fold_forest(rows, "fold", folds, row_id, forest, "score")


def ablation(rows: DataFrame, arms: dict[str, Sequence[str]], folds: int, row_id: str, make: Callable[[Sequence[str]], IsolationForest], registry: DataFrame, digs_per_km: float, tolerance: float, seed: int = 42) -> DataFrame:
    """Recall of each column set and its paired difference to the first one.

    All arms are resampled in one pass, by the same draws of a source.
    """
    seen = dict.fromkeys(c for columns in arms.values() for c in columns)
    needed = dict.fromkeys(["survey_id", "line_id", "sample_idx", "chainage_m", "fold", row_id, *seen])
    rows = cut(rows.select(*needed))  # every fold of every arm reads them
    recalls = {}
    for name, columns in arms.items():
        scored = held_out_scores(rows, folds, row_id, make(columns)).select("survey_id", "line_id", "sample_idx", "chainage_m", "score")
        dug = detect(scored, Scoring(name, "score", 0.0), registry, digs_per_km, tolerance)
        recalls[name] = cut(recall_units(dug, registry, rows).select("source_id", F.col("hit_rate").alias("value")))
    base = recalls[next(iter(arms))]
    sides = [F.when(F.col("arm") == i, F.col("a") - F.col("b")) for i in range(len(arms))]
    pairs = reduce(DataFrame.unionByName, [pair_values(units, base, "source_id").withColumn("arm", F.lit(i)) for i, units in enumerate(recalls.values())])
    wide = cut(pairs.groupBy("source_id").agg(*[F.max(side).alias(f"d{i}") for i, side in enumerate(sides)]))
    got = cut(metrics.bootstrap(wide, [], "source_id", [f"d{i}" for i in range(len(arms))], 500, 0.95, seed))
    parts = []
    for i, (name, units) in enumerate(recalls.items()):
        delta = got.select(*[F.col(f"d{i}_{end}").alias(f"delta_{end}") for end in ("point", "lo", "hi")])
        parts.append(units.agg(F.avg("value").alias("recall")).crossJoin(delta).withColumn("arm", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def transfer(rows: DataFrame, domain: str, half: str, group: str, y: str, row_id: str, model: SeverityModel, domains: Sequence[str]) -> DataFrame:
    """Severity error and coverage when trained on one domain and tested on another's held-out lines.

    ``half`` is ``train`` or ``test``; three tenths of the training groups calibrate.
    """
    parts = []
    for source in domains:
        dev = rows.filter((F.col(domain) == source) & (F.col(half) == "train"))
        split = cut(metrics.calibration_split(dev, group, 0.3, model.seed))
        marked = dev.join(split, group)
        fitted = SeverityModel(model.columns, model.alpha, model.trees, model.seed, model.levels).fit(marked.filter("not calibration"), marked.filter("calibration"), y)
        test = rows.filter((F.col(domain).isin(list(domains))) & (F.col(half) == "test"))
        got = fitted.predict(test, row_id)
        parts.append(metrics.group_interval_metrics(got, domain, y, "sev_pred", "sev_lo", "sev_hi").withColumn("trained_on", F.lit(source)).withColumnRenamed(domain, "tested_on"))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class EvaluationPlan:
    """What an evaluation needs beside the rows.

    ``columns``: features of all models. ``amplitude``: the column of the baseline
    scorer. ``truth``: severity of a row. ``protected``: the class whose recall is
    gated. ``forbidden``: columns that may not be among the most important ones.
    """

    registry: DataFrame
    columns: Sequence[str]
    amplitude: str
    classes: Sequence[str]
    protected: str
    digs_per_km: float
    tolerance: float = 15.0
    truth: str = "severity_smys"
    row_id: str = "row_id"
    contamination: float = 0.05
    trees: int = 50
    calibration: float = 0.3
    alpha: float = 0.1
    min_classes: int = 3
    forbidden: Sequence[str] = ("chainage_m", "chainage_peak_m", "chainage_start_m", "chainage_end_m", "sample_idx")
    resamples: int = 500
    seed: int = 42

    def severity_model(self) -> SeverityModel:
        return SeverityModel([*self.columns, "extent_m"], self.alpha, self.trees, self.seed)

    def class_model(self) -> ClassModel:
        return ClassModel([*self.columns, "extent_m"], self.classes, self.trees, self.seed)


@dataclass(frozen=True)
class Evaluation:
    """``report``: (scoring, metric, value_point, value_lo, value_hi, passed), ``passed`` only on gates; the others are None without enough matches."""

    report: DataFrame
    severity: DataFrame | None
    classes: DataFrame | None
    error_by_decile: DataFrame | None
    reliability: DataFrame | None


def evaluate(rows: DataFrame, folds: int, is_defect: Column, plan: EvaluationPlan) -> Evaluation:
    """Every metric and gate from predictions for held-out folds.

    ``rows``: survey_id, line_id, sample_idx, chainage_m, ``fold``, the features, the
    truth and ``plan.row_id``. Detectors, severities and classes are each fitted on
    the other folds; calibration groups are whole sources of the training side.
    """
    parts = [(train, held) for _, train, held in fold_parts(rows, "fold", folds)]
    scored, limit = _scored(parts, plan)
    severity, classes = _matched_frames(scored, plan)

    def crossed(frame: DataFrame, predict) -> DataFrame | None:
        got = [predict(dev, test, plan.seed + k) for k, dev, test in fold_parts(frame, "fold", folds) if not dev.isEmpty()]
        return cut(reduce(DataFrame.unionByName, got)) if got else None

    by_severity = crossed(severity, lambda dev, test, seed: _severities(dev, test, plan, seed)) if _enough(severity, 4, "matched_source_id", 2) else None
    by_class = crossed(classes, lambda dev, test, seed: _classes(dev, test, plan, seed)) if _enough(classes, 8, "defect_type", plan.min_classes) else None
    return _evaluation(scored, limit, is_defect, plan, by_severity, by_class, classes)


def holdout(rows: DataFrame, run: str, train_runs: Sequence[int], test_runs: Sequence[int], is_defect: Column, plan: EvaluationPlan) -> Evaluation:
    """The same metrics and gates for later runs, from models that saw the earlier ones only."""
    train, test = metrics.temporal_holdout(rows.withColumn("fold", F.lit(0)), run, train_runs, test_runs)
    # the models of severities and classes learn from what the detector finds in its own training rows
    scored, limit = _scored([(train, train.unionByName(test))], plan)
    severity, classes = _matched_frames(scored, plan)
    runs = scored.select("survey_id", F.col(run).isin(list(test_runs)).alias("later")).distinct()

    def split(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
        marked = cut(frame.join(runs, "survey_id"))
        return marked.filter("not later").drop("later"), marked.filter("later").drop("later")

    (dev, held), (class_dev, class_held) = split(severity), split(classes)
    fits = _enough(dev, 4, "matched_source_id", 2) and not held.isEmpty()
    by_severity = cut(_severities(dev, held, plan, plan.seed)) if fits else None
    fits = _enough(class_dev, 8, "defect_type", plan.min_classes) and not class_held.isEmpty()
    by_class = cut(_classes(class_dev, class_held, plan, plan.seed)) if fits else None
    later = scored.filter(F.col(run).isin(list(test_runs)))
    return _evaluation(later, limit, is_defect, plan, by_severity, by_class, class_dev)


def _scored(parts: Sequence[tuple[DataFrame, DataFrame]], plan: EvaluationPlan) -> tuple[DataFrame, float]:
    """Held-out rows with both scores, and the baseline's mean threshold over the training sides."""
    out, limits = [], []
    for train, held in parts:
        base = MadModel(plan.amplitude, plan.contamination).fit(train)
        forest = IsolationForest(tuple(plan.columns), trees=plan.trees, contamination=plan.contamination).fit(train, plan.row_id)
        out.append(forest.score(base.score(held, "score_mad"), "score_if"))
        limits.append(base.threshold)
    return cut(reduce(DataFrame.unionByName, out)), sum(limits) / len(limits)


def _matched_frames(scored: DataFrame, plan: EvaluationPlan) -> tuple[DataFrame, DataFrame]:
    """Everything the forest found, with the features of its peak: those at defects with their severity, those at any source with its class."""
    series = indexed(scored, ["survey_id"], "sample_idx")
    found = cut(cluster_indications(series, "score_if", 0.0, "eval", carry=("line_id", "fold"), rank=False))
    matched = match_surveys(found, plan.registry, scored.select("line_id", "survey_id").distinct(), plan.tolerance)
    shown = cut(attach_peak_rows(matched.filter("matched_source_id is not null"), scored, list(plan.columns)))
    # a peak beside its source's labelled rows has no severity
    severity, _ = attach_truth(shown.filter("matched_kind = 'defect'"), scored, plan.truth)
    kinds = plan.registry.select(F.col("source_id").alias("matched_source_id"), "defect_type")
    return cut(severity), cut(shown.filter("matched_kind in ('defect', 'interference')").join(kinds, "matched_source_id"))


def _enough(frame: DataFrame, rows: int, column: str, distinct: int) -> bool:
    got = frame.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(column).alias("d")).first()
    return got["n"] >= rows and got["d"] >= distinct


def _severities(dev: DataFrame, test: DataFrame, plan: EvaluationPlan, seed: int) -> DataFrame:
    return predict_severity(dev, test, "matched_source_id", plan.truth, "indication_id", plan.severity_model(), plan.calibration, seed)


def _classes(dev: DataFrame, test: DataFrame, plan: EvaluationPlan, seed: int) -> DataFrame:
    return predict_classes(dev, test, "matched_source_id", "defect_type", plan.class_model(), plan.calibration, seed)


def severity_units(predicted: DataFrame, y: str, unit: str = "matched_source_id") -> DataFrame:
    """(metric, unit, value): coverage, error and width of each source's intervals."""
    per = metrics.group_interval_metrics(predicted, unit, y, "sev_pred", "sev_lo", "sev_hi")
    return _long(per, unit, ["coverage", "mae", "interval_width"])


def class_units(predicted: DataFrame, classes: Sequence[str], unit: str = "matched_source_id") -> DataFrame:
    """(metric, unit, value): recall of each source's class, precision of interference, Brier score."""
    recall = metrics.class_recall_units(predicted, unit, "indication_id", "defect_type", "pred_type")
    recall = recall.select(F.concat(F.lit("recall_"), "true_class").alias("metric"), F.col(unit).alias("unit"), F.col("recall").alias("value"))
    precision = metrics.class_precision_units(predicted, unit, "defect_type", "pred_type", "interference").withColumnRenamed("precision", "interference_precision")
    brier = metrics.brier(predicted, [unit], "defect_type", "probabilities", classes)
    return recall.unionByName(_long(precision, unit, ["interference_precision"])).unionByName(_long(brier, unit, ["brier"]))


def _long(per: DataFrame, unit: str, names: Sequence[str]) -> DataFrame:
    items = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("i")
    return per.select(F.col(unit).alias("unit"), items).select("i.metric", "unit", "i.value")


def _evaluation(
    scored: DataFrame, limit: float, is_defect: Column, plan: EvaluationPlan, severity: DataFrame | None, classes: DataFrame | None, class_frame: DataFrame,
) -> Evaluation:
    """All units of all metrics in one table, resampled in one pass; a gap is resampled over units that both scorings share."""
    scorings = [Scoring("mad", "score_mad", limit), Scoring("forest", "score_if", 0.0)]
    found = {s.name: cut(detection_units(cut(detect(scored, s, plan.registry, plan.digs_per_km, plan.tolerance)), plan.registry, scored)) for s in scorings}

    def gap(metric: str, name: str, a: str, b: str) -> DataFrame:
        sides = [found[s].filter(F.col("metric") == metric).select("unit", "value") for s in (a, b)]
        return pair_values(*sides, "unit").select(F.lit("gap").alias("scoring"), F.lit(name).alias("metric"), "unit", (F.col("a") - F.col("b")).alias("value"))

    parts = [u.withColumn("scoring", F.lit(name)) for name, u in found.items()]
    parts += [gap("recall", "recall_gap", "forest", "mad"), gap("interference_fraction", "interference_gap", "mad", "forest")]
    deciles = reliability = None
    if severity is not None:
        parts += [severity_units(severity.filter(F.col("method") == m), plan.truth).withColumn("scoring", F.lit(f"severity_{m}")) for m in ("model", "baseline")]
        deciles = metrics.error_by_quantile(severity.filter("method = 'model'"), plan.truth, "sev_pred")
    if classes is not None:
        parts += [class_units(classes.filter(F.col("method") == m), plan.classes).withColumn("scoring", F.lit(f"classes_{m}")) for m in ("model", "baseline")]
        right = classes.filter("method = 'model'").withColumn("correct", F.col("pred_type") == F.col("defect_type"))
        reliability = metrics.reliability(right, "pred_type_conf", "correct")
    units = cut(reduce(DataFrame.unionByName, parts))
    report = metrics.bootstrap(units, ["scoring", "metric"], "unit", ["value"], plan.resamples, 0.95, plan.seed)
    both = reduce(DataFrame.unionByName, [scored.select(F.lit(s.name).alias("scoring"), is_defect.alias("__y"), F.col(s.column).alias("__s")) for s in scorings])
    area = metrics.average_precision(both, ["scoring"], F.col("__y"), "__s")
    report = report.unionByName(area.select("scoring", F.lit("pr_auc").alias("metric"), F.col("average_precision").alias("value_point")), allowMissingColumns=True)
    if classes is not None:
        train, calibration = split_for_calibration(class_frame, "matched_source_id", plan.calibration, plan.seed, by=["defect_type"])
        importance = plan.class_model().fit(train, calibration, "defect_type").importance(scored.sparkSession)
        named = metrics.top_features_allowed(importance, "feature", "importance", plan.forbidden)
        named = named.select(F.lit("classes_model").alias("scoring"), F.lit("forbidden_features").alias("metric"), F.size("offenders").cast("double").alias("value_point"))
        report = report.unionByName(named, allowMissingColumns=True)
    return Evaluation(cut(_gated(report, plan.protected)), severity, classes, deciles, reliability)


def _gated(report: DataFrame, protected: str) -> DataFrame:
    """Adds ``passed`` to the rows that a release depends on; intervals are judged at their lower end."""
    at = lambda scoring, metric: (F.col("scoring") == scoring) & (F.col("metric") == metric)
    passed = (
        F.when(at("gap", "recall_gap"), F.col("value_lo") >= RECALL_GAP_MIN)
        .when(at("gap", "interference_gap"), F.col("value_lo") > 0)
        .when(at("severity_model", "coverage"), F.col("value_point").between(*COVERAGE_BAND))
        .when(at("classes_model", f"recall_{protected}"), F.col("value_lo") >= CLASS_RECALL_MIN)
        .when(at("classes_model", "forbidden_features"), F.col("value_point") == 0)
    )
    return report.withColumn("passed", passed)


def severity_gate(coverage: DataFrame) -> DataFrame:
    return metrics.gate_between(coverage, "empirical", *COVERAGE_BAND)
