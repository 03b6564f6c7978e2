"""Reading and writing surveys, features, indications and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import nan_to_null
from ..operators.guards import assert_point_in_time
from ..operators.identity import insert_new, multiset_hash, todo
from ..operators.quality import READING_SCHEMA
from ..session import cut
from . import files


def survey_id(line, run):
    return F.concat_ws("_R", line, run.cast("string"))


def split_survey_id(survey):
    """(line_id, run_id) of an id; the last ``_R`` separates them."""
    return F.regexp_extract(survey, r"^(.*)_R(\d+)$", 1), F.regexp_extract(survey, r"^(.*)_R(\d+)$", 2).cast("long")


def read_surveys(spark: SparkSession, root: str, schema: T.StructType = READING_SCHEMA, paths: Sequence[str] | None = None) -> DataFrame:
    """All ``line_id=*/run_id=*`` files, or those at ``paths`` below ``root``, with the survey id, the file and the row position in it."""
    df = spark.read.schema(schema).option("basePath", root).parquet(*([root] if paths is None else paths))
    df = df.select(
        "*", F.col("_metadata.row_index").alias("file_pos"), F.col("_metadata.file_path").alias("source_uri"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    )
    return nan_to_null(df).withColumn("survey_id", survey_id(F.col("line_id"), F.col("run_id")))


def path_keys(path: Column) -> list[Column]:
    """line_id and run_id of a file's path; the run is null where the path has none."""
    part = lambda name, kind: F.regexp_extract(path, f"/{name}=({kind})(?:/|$)", 1)
    # a partition's folder has its value with % and two digits for what a folder's name can't hold
    line = F.regexp_replace(F.replace(part("line_id", "[^/]*"), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    line = F.try_url_decode(line)
    line = F.nullif(line, F.lit(""))
    return [line.alias("line_id"), F.nullif(part("run_id", "[0-9]+"), F.lit("")).try_cast("long").alias("run_id")]


def scan_surveys(spark: SparkSession, root: str, schema: T.StructType = READING_SCHEMA, paths: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of the surveys whose files all have the columns and types of ``schema``, and one row per survey of the others.

    Footers are read in the tasks before any row is, so a wrong file stops nothing.
    A refused survey has its files' hash as its content, so that it is registered
    once; the number of wrong columns, or 1 for each file without a readable footer
    or a run in its path; and as ``detail`` what is wrong with each file. Where a file
    is refused, the driver passes the names of the others on, as many as it lists
    for any scan.
    """
    keys = {"line_id", "run_id"}
    inside = T.StructType([f for f in schema.fields if f.name not in keys])
    where = root if paths is None else list(paths)
    found = cut(files.schema_problems(spark, where, inside).withColumns(dict(zip(["line_id", "run_id"], path_keys(F.col("path"))))))
    found = found.filter(F.col("path").endswith(".parquet")).withColumn(
        "unreadable", F.coalesce("unreadable", F.when(F.col("run_id").isNull() | F.col("line_id").isNull(), "no line and run in the path"))
    )
    broken = cut(files.broken(found))
    if broken.isEmpty():
        return read_surveys(spark, root, schema, paths), _refused(broken)
    good = found.join(*_same_survey(broken), "left_anti")
    names = [r["path"] for r in good.select("path").collect()]
    rows = read_surveys(spark, root, schema, names) if names else read_surveys(spark, root, schema, paths).filter(F.lit(False))
    # all files of a refused survey, hashed by streams
    whole = cut(found.join(*_same_survey(broken), "left_semi"))
    hashed = files.file_hashes(spark, [r["path"] for r in whole.select("path").collect()])
    return rows, _refused(whole.join(hashed.select("path", "file_sha256"), "path"))


def _same_survey(rows: DataFrame) -> tuple[DataFrame, Column]:
    """The surveys of ``rows`` and the condition that joins other rows with them, also those without a line or run."""
    named = rows.select(F.col("line_id").alias("__line"), F.col("run_id").alias("__run")).distinct()
    return named, F.col("line_id").eqNullSafe(F.col("__line")) & F.col("run_id").eqNullSafe(F.col("__run"))


def _refused(whole: DataFrame) -> DataFrame:
    """One row per survey of files that have problems, with their hashes."""
    if "file_sha256" not in whole.columns:
        whole = whole.withColumn("file_sha256", F.lit(None).cast("string"))
    wrong = F.size("missing") + F.size("wrong_type") + F.when(F.col("unreadable").isNotNull(), 1).otherwise(0)
    placed = F.col("line_id").isNotNull() & F.col("run_id").isNotNull()
    named = whole.withColumn("survey_id", F.when(placed, survey_id(F.col("line_id"), F.col("run_id"))).otherwise(F.col("path")))
    keys = ["survey_id", "line_id", "run_id"]
    hashes = multiset_hash(named, keys, "file_sha256", "content_sha256").withColumnsRenamed({k: f"__{k}" for k in keys})
    told = F.struct("path", "missing", "wrong_type", "unreadable")
    per = named.groupBy(*keys).agg(
        F.min("path").alias("source_uri"), F.sum(wrong).cast("long").alias("n_affected"),
        F.to_json(F.struct(F.sort_array(F.collect_list(F.when(wrong > 0, told))).alias("files"))).alias("detail"),
    )
    return per.join(hashes, per["survey_id"] == hashes["__survey_id"]).select(*keys, "source_uri", "content_sha256", "n_affected", "detail")


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """A table written by line and run, with the keys in their own types: line ids that look like numbers stay strings."""
    own = {"line_id": T.StringType(), "survey_id": T.StringType(), "run_id": T.LongType(), "fv": T.LongType()}
    found = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, own.get(f.name, f.dataType)) for f in found.fields])).parquet(path)


def survey_metadata(rows: DataFrame, chainage: str = "chainage_true_m", time: str = "file_time") -> DataFrame:
    """One registry row per survey: size, extent, mean step and time."""
    n = F.count(F.lit(1))
    span = F.max(chainage) - F.min(chainage)
    return rows.groupBy("survey_id", "line_id", "run_id").agg(
        n.alias("n_samples"), F.min(chainage).alias("start_m"), F.max(chainage).alias("end_m"),
        (span / F.greatest(F.lit(1), n - 1)).alias("step_m"), F.max(time).alias("surveyed_at"),
        F.min("source_uri").alias("source_uri"),
    )


def read_files(spark: SparkSession, paths: Sequence[str], registry: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Selected columns of many files, keyed through the registry's ``source_uri``.

    The registry holds one row per survey; Spark broadcasts it only if it is small.
    """
    df = spark.read.parquet(*paths).select(*columns, F.col("_metadata.file_path").alias("source_uri"))
    return nan_to_null(df).join(registry.select("source_uri", "survey_id"), "source_uri").drop("source_uri")


def accepted(rows: DataFrame, registry: DataFrame) -> DataFrame:
    return rows.join(registry.filter("status = 'accepted'").select("survey_id"), "survey_id", "left_semi")


def load_readings(rows: DataFrame, registry: DataFrame, path: str) -> None:
    """Readings of accepted surveys, one folder per survey: loading one again replaces it."""
    parts = accepted(rows, registry).repartition("line_id", "run_id", F.expr("sample_idx div 1000000"))
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("line_id", "run_id").parquet(path)


def write_features(features: DataFrame, meta: DataFrame, root: str, rows_per_file: int = 1_000_000) -> None:
    """Feature store: version, line and run in the path, rows in order, one ``meta`` row per survey.

    A long survey is split over several files by position, so no task writes a whole survey.
    """
    out = features.withColumn("fv", F.col("feature_version"))
    parts = out.repartition("fv", "line_id", "run_id", F.expr(f"sample_idx div {rows_per_file}"))
    (
        parts.sortWithinPartitions("fv", "line_id", "run_id", "sample_idx")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        .partitionBy("fv", "line_id", "run_id").parquet(f"{root}/features")
    )
    meta.write.mode("append").parquet(f"{root}/feature_meta")


def latest_by(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """The newest row per key, or of the table when there is no key."""
    cols = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in (time, *[c for c in cols if c != time])])).alias("__r"))
    return top.select(*keys, "__r.*")


def known_rows(rows: DataFrame, surveys: DataFrame, as_of, lines: Sequence[str] | None = None, time: str = "surveyed_at") -> DataFrame:
    """Rows of the surveys made up to ``as_of`` (inclusive), with their time; a survey without a time is not known."""
    known = surveys.filter(F.col(time) <= F.lit(as_of)).select("survey_id", time)
    if lines is not None:
        rows = rows.filter(F.col("line_id").isin(list(lines)))
    assert_point_in_time(known, as_of, time, "survey_id", "feature corpus")
    return rows.join(known, "survey_id")


def read_features(
    spark: SparkSession, root: str, version: int, surveys: DataFrame, as_of, lines: Sequence[str] | None = None, time: str = "surveyed_at"
) -> DataFrame:
    """The feature corpus of one version as it was known at ``as_of`` (inclusive).

    Version and lines are partition columns, so other directories are not opened.
    """
    df = read_keyed(spark, f"{root}/features").filter(F.col("fv") == version).drop("fv")
    return known_rows(df, surveys, as_of, lines, time)


def pending(surveys: DataFrame, spark: SparkSession, root: str, force: bool = False) -> DataFrame:
    """Surveys the feature store does not hold yet; an unreadable store holds none."""
    try:
        done = spark.read.parquet(f"{root}/feature_meta")
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc) and "UNABLE_TO_INFER_SCHEMA" not in str(exc):
            raise
        return surveys
    return todo(surveys, done, force=force)


def write_indications(spark: SparkSession, indications: DataFrame, path: str) -> int:
    """Append indications that are not stored yet; returns how many were."""
    try:
        existing = spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        existing = None
    new = indications.dropDuplicates(["indication_id"]) if existing is None else insert_new(existing, indications, "indication_id")
    new = new.persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def quarantine(rows: DataFrame, dq: DataFrame, verdicts: DataFrame, root: str) -> None:
    """Raw rows and report of failed surveys, away from the accepted data."""
    failed = verdicts.filter("verdict = 'quarantined'").select("survey_id")
    rows.join(failed, "survey_id", "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("survey_id").parquet(f"{root}/rows")
    lines = dq.join(failed, "survey_id", "left_semi").select("survey_id", F.to_json(F.struct("survey_id", "check_name", "status", "n_affected", "detail")).alias("value"))
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("survey_id").text(f"{root}/reports")


def geojson(indications: DataFrame, properties: Sequence[str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One GeoJSON feature per located row; missing values are written as null."""
    located = nan_to_null(indications).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties"))
    return located.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def read_trace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").option("comment", "#").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def published_slice(indications: DataFrame, version: str) -> DataFrame:
    return indications.filter((F.col("pipeline_version") == version) & (F.col("is_shadow") == 0))
