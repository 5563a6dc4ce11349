"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.decontamination import decontaminate_stage
from millrace.llm.jaccard_join import jaccard_stage
from millrace.llm.pii import pii_stage
from millrace.llm.quality_rules import quality_stage
from millrace.llm.sentencepieces import encode_stage
from millrace.session import Scratch

STAGES = [
    ("quality_rules", quality_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontaminate_stage),
    ("pii", pii_stage),
    ("sentencepieces", encode_stage),
]

#: Robust estimates, boosted trees and tokenization aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of the documents that all stages keep."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
