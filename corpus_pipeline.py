"""The corpus pipeline: five stages, each written as Parquet and read again
as the next one's input."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from strata.llm import stages
from strata.session import scratch, stage_path

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("mixing", stages.mixing_stage),
    ("packing", stages.packing_stage),
]

#: Tokens, automata and fingerprints have no SQL form; tests/llm compares each
#: stage with a brute-force version on what the stage before it left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        path = stage_path(spark, f"pipeline-{name}")
        with scratch(spark):  # a stage's own tables are deleted once its output is written
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
