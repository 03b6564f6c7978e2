"""The given tables seen as survey tables.

Readings: ``events`` as walks. A line is a user, a run is a third of a month, the
axis is hours since the run began, the signal is ``value``.
Items: ``lineitem`` as one long series per supplier, ordered by ship date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.islands import cluster_indications, extents, reference_rows, truth_registry
from ..operators.ordered import Series, indexed, order_rows
from ..session import cut

THRESHOLD = 60.0
VERSION = "v1"
TOLERANCE = 15.0
ITEM_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero removes the sign of zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def reading_rows(spark: SparkSession, sf_dir: str, *also: Column) -> DataFrame:
    """The readings, and with them the columns ``also`` of their file."""
    e = table(spark, sf_dir, "events")
    run = ((F.dayofmonth("ts") - 1) / 10).cast("long")
    t = F.col("ts").cast("timestamp")
    hours = (F.unix_micros(t) - F.unix_micros(F.date_trunc("month", t))) / F.lit(3.6e9)
    e = e.select(
        "event_id", F.col("user_id").alias("line_id"), run.alias("run_id"), t.alias("ts"), "event_type", "value",
        F.concat_ws("_R", F.col("user_id").cast("string"), run.cast("string")).alias("survey_id"), hours.alias("__h"), *also,
    )
    return e.withColumn("chainage_m", F.col("__h") - F.col("run_id") * F.lit(240.0)).drop("__h")


def readings(spark: SparkSession, sf_dir: str) -> Series:
    return order_rows(reading_rows(spark, sf_dir), ["survey_id"], ["ts", "event_id"])


def fixes(series: Series) -> Series:
    """Readings with a position except on views."""
    seen = F.col("event_type") != "view"
    lat = F.lit(46.958) + F.col("chainage_m") * 1e-5 + F.col("value") * 1e-6
    lon = F.lit(8.365) + F.col("chainage_m") * 1e-5
    return series.with_df(series.df.withColumn("lat", F.when(seen, lat)).withColumn("lon", F.when(seen, lon)))


def heads(df: DataFrame) -> DataFrame:
    return df.select(
        "*", F.col("value").alias("b_lo"), (F.col("value") + F.col("chainage_m") * 0.05).alias("b_mid"),
        (F.col("value") * 0.5 + F.col("chainage_m") * 0.1).alias("b_hi"),
    )


def found(spark: SparkSession, sf_dir: str, rank: bool = False) -> DataFrame:
    """Indications of the readings."""
    return cluster_indications(
        readings(spark, sf_dir), "value", THRESHOLD, VERSION, carry=("ts", "line_id", "run_id"), edge=F.col("event_type") == "error", rank=rank
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label runs of each line's first survey."""
    series = readings(spark, sf_dir)
    rows = series.with_df(reference_rows(series.df, "line_id", "survey_id"))
    flags = {"defect": F.col("event_type") == "error", "interference": F.col("event_type") == "signup"}
    return truth_registry(rows, "line_id", "chainage_m", flags, F.col("event_type"))


def survey_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extents(reading_rows(spark, sf_dir), ["survey_id"], "chainage_m")


def items(spark: SparkSession, sf_dir: str) -> Series:
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", *ITEM_ORDER, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    s = order_rows(rows, ["l_suppkey"], ITEM_ORDER)
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01"))
    return s.with_df(s.df.withColumn("x", days + F.col("sample_idx") * F.lit(0.001)).withColumn("y", F.col("l_extendedprice") / 1000.0))


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score between 0 and 1 read from their length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    score = F.col("n_chars") / (F.col("n_chars") + 2000.0)
    return table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("score", score)


def yearly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_suppkey", (F.year("l_shipdate") - 1995).cast("long").alias("run_id")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y_true")
    )
