"""Stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm.common import read, scratch
from tracewright.llm.stages import line_dedup_stage, near_dup_stage, packing_stage, toxicity_stage

STAGES = [("toxicity", toxicity_stage), ("line_dedup", line_dedup_stage), ("near_dup", near_dup_stage), ("packing", packing_stage)]
#: A trained score decides, which SQL cannot express; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch(docs)
    return docs
