"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.session import _ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Only A-Z change, so no other character turns into another word."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def scratch(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write the rows as a Parquet table in the shared folder and go on from it, compressed by `codec` or the session's.

    Used instead of cut() where rows are wide: the columns are compressed, later
    steps read only those they need, and Catalyst knows the size.
    """
    path = shared_folder(df.sparkSession)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as literals, which need no Python worker."""
    if not rows:
        return spark.createDataFrame([], schema)
    names = [part.split()[0] for part in schema.split(",")]
    types = [part.split(None, 1)[1] for part in schema.split(",")]
    parts = [F.struct(*[F.lit(v).cast(t).alias(n) for v, n, t in zip(row, names, types)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*parts)))


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """Whole texts go to Python at most `rows` at once; the session's setting is lowered where it is higher.

    A batch is held several times, in the JVM's own memory and in the worker.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
