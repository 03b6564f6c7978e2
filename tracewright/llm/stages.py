"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> rows. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, ngram_join, packing, toxicity
from .common import read, scratch, small_batches, vocabulary


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't take for toxic; it learns from the labels that aren't held out."""
    small_batches(docs)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < 0.5)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their site's boilerplate lines; n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs)
    n_chars = F.when(F.col("_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component; documents without words all stay.

    Of rows that repeat an id one stays. A row without an id can't be named and
    stays. Only the ids that go are joined with the texts.
    """
    found = scratch(ngram_join.ngram_components(docs, words=5, percent=80))
    gone = scratch(found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())
    twice = scratch(found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    small = lambda ids: F.broadcast(ids) if ids.count() <= ngram_join.BROADCAST_KEYS else ids
    kept = docs.join(small(gone), "doc_id", "left_anti")
    if not twice.isEmpty():
        again = kept.join(small(twice), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(small(twice), "doc_id", "left_anti").unionByName(again)
    return kept.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)
