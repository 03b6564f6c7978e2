"""New survey files as a stream: a survey waits until its files are all there, then the batch job takes it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import FeatureConfig
from ..operators.registration import RegistrationConfig
from ..plans.jobs import QualityLimits, full_run
from ..sources import files
from ..sources.surveys import path_keys

WAITING = "folder string, line_id string, run_id long"


def arriving(spark: SparkSession, root: str, files_per_batch: int = 64) -> DataFrame:
    """One row per new file: its folder and the survey in its path. No content is read."""
    named = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    return named.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), *path_keys(F.col("path")))


class Waiting:
    """The surveys whose files have not been taken yet: a table of one small version per change.

    A version counts once its job has finished, so a run that is killed goes on from
    the one before. Versions before the last two are removed.
    """

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.root = spark, f"{store}/waiting"

    def read(self) -> DataFrame:
        done = files.committed(self.spark, self.root)
        return self.spark.read.schema(WAITING).parquet(f"{self.root}/{done[-1]}") if done else self.spark.createDataFrame([], WAITING)

    def write(self, rows: DataFrame) -> None:
        done = files.committed(self.spark, self.root)
        following = int(done[-1]) + 1 if done else 0
        rows.write.mode("overwrite").parquet(f"{self.root}/{following:012d}")
        for old in done[:-1]:
            files.remove(self.spark, f"{self.root}/{old}")


def complete(spark: SparkSession, waiting: DataFrame, manifest: str | None, quiet_seconds: float, now: float) -> DataFrame:
    """The waiting surveys whose files are all there.

    ``manifest`` is a folder of JSON lines (line_id, run_id, n_files) that whoever
    delivers the files adds to; a survey in it is complete with that many files, the
    most if it is named more than once. Any other is once none of its files is newer
    than ``quiet_seconds`` before ``now``.
    """
    folders = [r["folder"] for r in waiting.select("folder").distinct().collect()]
    if not folders:
        return waiting
    there = files.listed(spark, folders).filter(F.col("path").endswith(".parquet")).groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    there = there.agg(F.count(F.lit(1)).alias("n_files"), F.max("modificationTime").alias("newest"))
    found = waiting.join(there, "folder")
    if manifest is not None:
        told = spark.read.schema("line_id string, run_id long, n_files long").json(manifest).groupBy("line_id", "run_id").agg(F.max("n_files").alias("expected"))
        found = found.join(told, ["line_id", "run_id"], "left")
    else:
        found = found.withColumn("expected", F.lit(None).cast("long"))
    quiet = F.unix_micros("newest") <= F.lit(int((now - quiet_seconds) * 1e6))
    return found.filter(F.when(F.col("expected").isNotNull(), F.col("n_files") >= F.col("expected")).otherwise(quiet)).select(waiting.columns)


def release(
    spark: SparkSession, root: str, store: str, reg_cfg: RegistrationConfig = RegistrationConfig(), cfg: FeatureConfig = FeatureConfig(),
    limits: QualityLimits = QualityLimits(), manifest: str | None = None, quiet_seconds: float = 0.0, surveys_per_run: int = 64,
) -> None:
    """Run the batch job on the complete surveys, at most ``surveys_per_run`` folders at once.

    A survey leaves the table after its job. A job that is repeated because the run
    was killed between the two finds the same content registered and does nothing.
    """
    table = Waiting(spark, store)
    while True:
        waiting = table.read()
        ready = complete(spark, waiting, manifest, quiet_seconds, time.time()).select("folder").distinct().orderBy("folder").limit(surveys_per_run)
        folders = [r["folder"] for r in ready.collect()]
        if not folders:
            return
        full_run(spark, root, store, reg_cfg, cfg, limits, paths=folders)
        table.write(waiting.filter(~F.col("folder").isin(folders)))


def run(
    spark: SparkSession, root: str, store: str, checkpoint: str, reg_cfg: RegistrationConfig = RegistrationConfig(),
    cfg: FeatureConfig = FeatureConfig(), limits: QualityLimits = QualityLimits(), files_per_batch: int = 64,
    manifest: str | None = None, quiet_seconds: float = 0.0,
):
    """Process everything that has arrived and is complete, then stop; the checkpoint lets the next call go on from there.

    A survey is one or more files, which batches and calls may split. A batch only
    adds its surveys to the waiting table; the complete ones among all that wait are
    then read with all their files, whichever batch named them. A survey that got
    complete without a new file, by its manifest or by lying quiet, is taken at the
    next call. A file that arrives for a survey already taken makes it wait again,
    and the batch job reports the conflict.

    A batch that was cut short is repeated: registration skips surveys that were
    registered with the same content, and features overwrite their own partition.
    """
    options = dict(reg_cfg=reg_cfg, cfg=cfg, limits=limits, manifest=manifest, quiet_seconds=quiet_seconds, surveys_per_run=files_per_batch)

    def one_batch(batch: DataFrame, _: int) -> None:
        table = Waiting(batch.sparkSession, store)
        table.write(table.read().unionByName(batch.distinct()).distinct())
        release(batch.sparkSession, root, store, **options)

    stream = arriving(spark, root, files_per_batch)
    query = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    release(spark, root, store, **options)
    return query
