"""End-to-end jobs: ingest a batch of surveys, build features, predict, forecast."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import consequence
from ..operators import feedback, growth, quality
from ..operators.features import FeatureConfig, feature_frame, pinned_columns
from ..operators.guards import GuardError, assert_columns
from ..operators.identity import content_hashes, register
from ..operators.islands import cluster_indications
from ..operators.learn import ClassModel, IsolationForestModel, MadModel, SeverityModel, isotonic_value, risk
from ..operators.matching import attach_peak_rows, match_all, per_survey_sources
from ..operators.ordered import indexed, order_rows
from ..operators.registration import RegistrationConfig, register as register_positions
from ..session import cut
from ..sources import surveys as io

# fixed values: weight of each class in the risk score
CONSEQUENCE = {"scc": 1.0, "weld": 0.8, "dent": 0.7, "corrosion": 0.6, "interference": 0.0, "none": 0.0}


@dataclass(frozen=True)
class QualityLimits:
    saturation_run: int = 5
    step_m: float = 0.5
    max_gap_m: float = 2.0
    max_jump_m: float = 5.0
    noise: tuple[float, float] = (1.0, 15.0)
    overlap_r: float = 0.9
    min_coverage: float = 0.95


def quality_checks(
    rows: DataFrame, meta: DataFrame, hashes: DataFrame, limits: QualityLimits = QualityLimits(), expected: DataFrame | None = None,
    history: DataFrame | None = None, history_meta: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All fourteen checks over a batch of raw surveys; positions in the file give the file order.

    ``history`` holds readings of surveys accepted earlier and ``history_meta``
    their registry rows. The batch is compared with them and with itself; two
    surveys of the history are not compared again.
    """
    heads, survey = list(quality.HEADS), "survey_id"
    longest = int(meta.agg(F.max("n_samples")).first()[0] or 0)
    # a survey is one or more files, and a row has its own place in its file
    in_file = indexed(rows, [survey, "source_uri"], "file_pos", longest)
    by_idx = indexed(rows, [survey], "sample_idx")
    batch, sizes = meta.select(survey), ["line_id", survey, "start_m", "end_m", "step_m"]
    signals = ["line_id", survey, "sample_idx", *heads]
    around, spans, known = rows.select(*signals), meta.select(*sizes), hashes.select(survey, "content_sha256")
    if history is not None:
        around = around.unionByName(history.select(*signals))
        spans = spans.unionByName(history_meta.select(*sizes))
        known = known.unionByName(history_meta.select(survey, "content_sha256"))
    new_only = lambda df: df.join(batch, survey, "left_semi")
    corr = quality.overlap_correlation(around, spans, "line_id", survey, "sample_idx", "b_mid_nt", fresh=batch)
    expected = expected if expected is not None else meta.select(survey, F.lit(None).cast("double").alias("expected_length_m"))
    return {
        "schema": quality.contract(rows, survey, quality.reading_rules()),
        "range": quality.value_range(rows, survey, heads, *quality.FIELD_RANGE_NT),
        "saturation": quality.saturation(in_file, survey, heads, limits.saturation_run),
        "sample_idx_monotonic": quality.monotonic(in_file, survey, "sample_idx"),
        "sample_idx_gap": quality.index_gaps(by_idx, survey, limits.step_m, limits.max_gap_m),
        "duplicate_sample_idx": quality.duplicate_index(rows, survey, ["sample_idx"]),
        "duplicate_content": new_only(quality.duplicate_content(known, survey, "content_sha256")),
        "survey_overlap": quality.overlap_check(corr, meta, survey, limits.overlap_r),
        "gps_jump": quality.jump_distance(in_file, survey, "lat", "lon", limits.max_jump_m),
        "gps_chainage_consistency": quality.path_vs_span(in_file, survey, "lat", "lon", "chainage_true_m"),
        "noise_floor": quality.noise_floor(in_file, survey, heads, *limits.noise),
        "background_regime": new_only(quality.regime_shift(around, "line_id", survey, heads)),
        "interference_density": quality.outlier_density(rows, survey, "b_mid_nt", longest=longest),
        "coverage": quality.coverage(rows, expected, survey, "chainage_true_m", limits.min_coverage),
    }


@dataclass(frozen=True)
class Ingested:
    meta: DataFrame
    dq: DataFrame
    verdicts: DataFrame
    registry: DataFrame


def hash_columns() -> list[str]:
    return [f.name for f in quality.READING_SCHEMA.fields if f.name not in ("line_id", "run_id")]


def ingest(
    rows: DataFrame, registry: DataFrame | None = None, limits: QualityLimits = QualityLimits(), history: DataFrame | None = None, refused: DataFrame | None = None,
) -> Ingested:
    """Hash, register and check a batch; conflicts and failed surveys get a status, the batch goes on.

    ``history``: readings of accepted surveys of the registry. ``refused``: surveys
    whose files could not be read as readings; each fails its schema check.
    """
    hashes = cut(content_hashes(rows, "survey_id", hash_columns()))
    meta = cut(io.survey_metadata(rows).join(hashes, "survey_id"))
    named = lambda df: df.withColumn("outcome", F.lit("accepted")) if registry is None else register(df, registry)
    outcome = cut(named(meta))
    # nothing registered before is checked or loaded again
    fresh = rows.join(outcome.filter("outcome = 'accepted'").select("survey_id"), "survey_id", "left_semi")
    checked = cut(outcome.filter("outcome = 'accepted'").drop("outcome"))
    old = None if history is None else registry.filter("status = 'accepted'")
    dq = quality.report(quality_checks(fresh, checked, checked, limits, None, history, old), "survey_id")
    if refused is not None:
        stopped = cut(named(refused))
        new = stopped.filter("outcome = 'accepted'")
        dq = dq.unionByName(new.select("survey_id", F.lit("schema").alias("check_name"), F.lit(quality.GATES["schema"]).alias("status"), "n_affected", "detail"))
        outcome = outcome.unionByName(stopped.drop("n_affected", "detail"), allowMissingColumns=True)
    dq = cut(dq)
    verdicts = quality.gate(dq, "survey_id")
    status = F.when(F.col("outcome") != "accepted", F.col("outcome")).otherwise(F.coalesce("verdict", F.lit("accepted")))
    out = outcome.join(verdicts.select("survey_id", "verdict"), "survey_id", "left").withColumn("status", status).drop("verdict")
    return Ingested(meta, dq, verdicts, cut(out))


def build_features(rows: DataFrame, reg_cfg: RegistrationConfig = RegistrationConfig(), cfg: FeatureConfig = FeatureConfig()) -> tuple[DataFrame, DataFrame]:
    """Registered positions and features of accepted surveys; also the registration quality."""
    longest = int(rows.groupBy("survey_id").count().agg(F.max("count")).first()[0] or 0)
    # windows and peaks count rows; an index with holes stays as the rows' label
    series = order_rows(rows.withColumnRenamed("sample_idx", "__label"), ["survey_id"], ["__label"], "sample_idx", longest)
    placed, info = register_positions(series, reg_cfg)
    frame = feature_frame(replace(series, df=cut(placed)), cfg, label="__label")
    return frame, info


def full_run(spark: SparkSession, root: str, store: str, reg_cfg: RegistrationConfig = RegistrationConfig(), cfg: FeatureConfig = FeatureConfig(), limits: QualityLimits = QualityLimits(), paths: Sequence[str] | None = None) -> DataFrame:
    """Raw files to feature store: register, check, quarantine, compute what is missing, write. Returns the registry rows.

    ``paths``: files or folders below ``root`` to take in place of all of it.
    """
    rows, refused = io.scan_surveys(spark, root, paths=paths)
    known = _read_or_none(spark, f"{store}/registry")
    loaded = None if known is None else _read_or_none(spark, f"{store}/readings")
    if loaded is not None:
        lines = rows.select("line_id").distinct()
        loaded = loaded.join(lines, "line_id", "left_semi")
    done = ingest(rows, known, limits, loaded, refused)
    io.quarantine(rows, done.dq, done.verdicts, f"{store}/quarantine")
    new = done.registry.filter(F.col("outcome") == "accepted")
    todo = io.pending(
        new.filter("status = 'accepted'").select("survey_id", "content_sha256", F.lit(cfg.version).cast("long").alias("feature_version")), spark, store
    )
    todo = cut(todo)
    if not todo.isEmpty():
        chosen = rows.join(todo.select("survey_id"), "survey_id", "left_semi")
        frame, _ = build_features(chosen, reg_cfg, cfg)
        assert_columns(frame.columns[-len(pinned_columns(cfg)) :], pinned_columns(cfg))
        io.write_features(frame, todo, store)
    io.load_readings(rows, new, f"{store}/readings")
    # the report has a partition of its own for the batch, which a repeated run replaces
    batch = new.agg(F.sum(F.xxhash64("survey_id", "content_sha256").cast("decimal(38,0)"))).first()[0]
    if batch is not None:
        report = done.dq.withColumn("batch", F.lit(str(batch)))
        report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{store}/dq_report")
    # the registry is written last: a run that is killed before repeats the same work
    new.write.mode("append").parquet(f"{store}/registry")
    return done.registry


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return io.read_keyed(spark, path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return None


def predict(
    features: DataFrame, positions: DataFrame, anomaly: IsolationForestModel | MadModel, version: str, columns: list[str],
    severity: SeverityModel | None = None, classes: ClassModel | None = None, calibrator=None, nominal: float = 0.9, threshold: float = 0.0,
) -> DataFrame:
    """Indications of all surveys of a feature frame: score, cluster, severity, class, risk. ``anomaly``: any scorer with ``score(df, out)``."""
    rows = features.join(positions.select("survey_id", "sample_idx", "lat", "lon"), ["survey_id", "sample_idx"], "left")
    scored = cut(anomaly.score(rows, "score"))
    series = indexed(scored, ["survey_id"], "sample_idx")
    found = cluster_indications(series, "score", threshold, version, carry=("lat", "lon"), edge=F.col("dq_flag") == "edge")
    found = cut(attach_peak_rows(found, features, columns))
    if severity is not None:
        found = severity.predict(found, "indication_id").withColumn("interval_nominal", F.lit(nominal))
    else:
        found = found.select("*", *[F.lit(None).cast("double").alias(c) for c in ("sev_pred", "sev_lo", "sev_hi", "interval_nominal")])
    if classes is not None:
        found = classes.predict(found).drop("probabilities")
        if calibrator is not None:
            found = found.withColumn("p_defect_cal", isotonic_value(calibrator, F.col("anomaly_score")))
        found = risk(found, consequence(F.col("pred_type"), CONSEQUENCE))
    return found.withColumn("created_at", F.current_timestamp())


def add_release(spark: SparkSession, store: str, release: str, released_at, **models: str) -> None:
    """Registers a release and the names of its models; one that is there stays as it is."""
    row = spark.createDataFrame([(release, released_at, models)], "release string, released_at timestamp, models map<string, string>")
    known = _read_or_none(spark, f"{store}/releases")
    new = row if known is None else row.join(cut(known), "release", "left_anti")
    if not new.isEmpty():
        new.write.mode("append").parquet(f"{store}/releases")


def latest_release(spark: SparkSession, store: str):
    """The newest release, of two at one time the one named last; a store without any is an error."""
    known = _read_or_none(spark, f"{store}/releases")
    row = None if known is None else io.latest_by(known.select("release", "released_at", F.to_json("models").alias("models")), [], "released_at").first()
    if row is None or row["release"] is None:
        raise GuardError("the store has no release")
    return row


def accepted_surveys(spark: SparkSession, store: str) -> DataFrame:
    """Registry rows of the surveys whose newest status is accepted."""
    known = io.read_keyed(spark, f"{store}/registry").select("survey_id", "line_id", "run_id", "status", "surveyed_at")
    return io.latest_by(known, ["survey_id"], "surveyed_at").filter("status = 'accepted'")


def predict_store(
    spark: SparkSession, store: str, surveys: Sequence[str], anomaly: IsolationForestModel, release: str | None, columns: list[str],
    cfg: FeatureConfig = FeatureConfig(), severity: SeverityModel | None = None, classes: ClassModel | None = None, calibrator=None,
) -> int:
    """Predict stored surveys with a release, the newest if none is named; store new indications, export them, return how many were new.

    A survey that is not registered, or whose newest status is not accepted, stops the job before anything is written.
    """
    release = release or latest_release(spark, store)["release"]
    asked = spark.createDataFrame([(s,) for s in surveys], "survey_id string").distinct()
    refused = asked.join(accepted_surveys(spark, store), "survey_id", "left_anti").orderBy("survey_id").limit(5).collect()
    if refused:
        raise GuardError(f"surveys that may not be predicted: {[r['survey_id'] for r in refused]}")
    features = io.read_keyed(spark, f"{store}/features").filter(F.col("fv") == cfg.version).drop("fv").join(asked, "survey_id", "left_semi")
    positions = io.read_keyed(spark, f"{store}/readings").join(asked, "survey_id", "left_semi")
    found = cut(predict(features, positions, anomaly, release, columns, severity, classes, calibrator))
    new = io.write_indications(spark, found, f"{store}/indications")
    shown = io.geojson(found, ["indication_id", "survey_id", "anomaly_score", "chainage_peak_m"])
    shown.write.mode("overwrite").text(f"{store}/geojson/{release}")
    return new


def match_surveys(indications: DataFrame, registry: DataFrame, surveys: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """Indications of every survey against its own line's sources, each source once per survey."""
    sources = per_survey_sources(registry, surveys, "line_id", "survey_id").withColumnRenamed("kind", "matched_kind")
    out = match_all(indications, sources, ["survey_id"], "chainage_peak_m", "chainage_m", "indication_id", "source_id", tolerance, ["matched_kind"])
    return out.withColumnRenamed("source_id", "matched_source_id")


def forecast(matched: DataFrame, rows: DataFrame, runs: DataFrame, latest: DataFrame, limit: float, min_obs: int = 2) -> DataFrame:
    """Remaining life of every matched object from its pooled rate and its latest severity interval."""
    frame = growth.growth_frame(matched, rows, runs)
    rates = growth.fit_rates(frame, "matched_source_id", "run_id", "y_true", min_obs)
    present = growth.latest_run(latest.select("matched_source_id", "run_id", "sev_lo", "sev_pred", "sev_hi"), "matched_source_id", "run_id")
    return growth.remaining_life(present.join(rates, "matched_source_id"), "sev_lo", "sev_pred", "sev_hi", "shrunk_rate", limit)


def forecast_store(
    spark: SparkSession, store: str, sources: DataFrame, limit: float, release: str | None = None, as_of=None, cfg: FeatureConfig = FeatureConfig(), min_obs: int = 2,
) -> DataFrame:
    """Remaining life from the stored indications of a release, as it was known at ``as_of`` (inclusive; all surveys without it).

    Only surveys with features of the configured version count. ``sources``: the truth registry.
    """
    release = release or latest_release(spark, store)["release"]
    surveys = cut(accepted_surveys(spark, store))
    as_of = as_of or surveys.agg(F.max("surveyed_at")).first()[0]
    corpus = io.read_features(spark, store, cfg.version, surveys.select("survey_id", "surveyed_at"), as_of)
    known = surveys.join(corpus.select("survey_id").distinct(), "survey_id", "left_semi").select("survey_id", "line_id", "run_id")
    known = cut(known)
    found = spark.read.parquet(f"{store}/indications").filter(F.col("pipeline_version") == release)
    found = found.select("indication_id", "survey_id", "peak_sample_idx", "chainage_peak_m", "sev_lo", "sev_pred", "sev_hi").join(known, "survey_id", "left_semi")
    matched = cut(match_surveys(found, sources, known.select("line_id", "survey_id")))
    rows = io.read_keyed(spark, f"{store}/readings").select("survey_id", "sample_idx", "severity_smys").join(known, "survey_id", "left_semi")
    latest = matched.filter("matched_kind = 'defect'").join(known.select("survey_id", "run_id"), "survey_id")
    return forecast(matched, rows, known.select("survey_id", "run_id"), latest, limit, min_obs)


def verify(verifications: DataFrame, indications: DataFrame, surveys: DataFrame, truth: DataFrame, tolerance: float = feedback.TOLERANCE_M):
    """Excavation results into a new version of the truth table, and the observation of each."""
    placed = feedback.locate(verifications, indications, surveys)
    table, routed = feedback.record_excavations(placed, truth, tolerance)
    observed = placed.join(routed, "verification_id").select("defect_id", "survey_id", "severity_smys")
    return table, observed


def verify_store(spark: SparkSession, store: str, verifications: DataFrame, tolerance: float = feedback.TOLERANCE_M) -> DataFrame:
    """Excavation results into the stored truth and observations; returns the observations of this batch.

    ``verifications``: (verification_id, indication_id, defect_type, severity_smys,
    verified_at). Both tables are kept by line, and only the folders of the batch's
    lines are read and written. The truth is written last and names the verification
    of each revision, so a batch that was killed can be given again: what is there is left out.
    """
    surveys = io.read_keyed(spark, f"{store}/registry").select("survey_id", "line_id").distinct()
    indications = spark.read.parquet(f"{store}/indications")
    placed = cut(feedback.locate(verifications, indications, surveys))
    lines = [r["line_id"] for r in placed.select("line_id").distinct().collect()]  # those of one batch of excavations
    truth = _lines_of(spark, f"{store}/truth", lines, STORED_TRUTH)
    fresh = placed.join(truth.select("verification_id"), "verification_id", "left_anti")
    table, routed = feedback.record_excavations(fresh, truth, tolerance)
    new = fresh.join(routed, "verification_id")
    # of several verifications of an object in one survey the last one counts
    told = io.latest_by(new.select("defect_id", "survey_id", "line_id", "severity_smys", "verified_at", "verification_id"), ["defect_id", "survey_id"], "verified_at")
    told = cut(told.select("defect_id", "survey_id", "severity_smys", "line_id"))
    observed = feedback.upsert_observations(_lines_of(spark, f"{store}/observations", lines, STORED_OBSERVATIONS), told)
    _replace_lines(observed, f"{store}/observations")
    _replace_lines(table, f"{store}/truth")
    return told


# columns of the stored tables, the line last as it is the folder
STORED_TRUTH = (
    "defect_id string, revision int, chainage_m double, defect_type string, source string, verified_at timestamp, "
    "valid_from timestamp, valid_to timestamp, verification_id string, line_id string"
)
STORED_OBSERVATIONS = "defect_id string, survey_id string, severity_smys double, line_id string"


def _lines_of(spark: SparkSession, path: str, lines: Sequence[str], schema: str) -> DataFrame:
    known = _read_or_none(spark, path)
    return spark.createDataFrame([], schema) if known is None else cut(known.filter(F.col("line_id").isin(list(lines))))


def _replace_lines(rows: DataFrame, path: str) -> None:
    # the rows are cut off the folder they replace
    cut(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("line_id").parquet(path)
