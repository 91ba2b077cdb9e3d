"""Artifact sinks and scans (SC-07, SC-09, SC-11..SC-13, SC-15, SC-18).

Rule tables, profiles, lists of values, quality reports, traces and answers
are small DataFrames (one row per column, table or run) written with the
DataFrame writer; readers give back the same schema, and a missing artifact
reads as an empty frame of that schema.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.rules import RULE_COLUMNS, canonical_headers


def write_rules(rules: DataFrame, path: str, in_order: bool = False) -> str:
    """SC-09: the eight rule columns in fixed order (missing -> ""), CSV with
    header, rows in rule order (``in_order``: as they come), one file (the
    table is schema-sized)."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rules.columns else F.lit("").alias(c)
            for c in RULE_COLUMNS]
    ordered = rules.orderBy("rule_no") if "rule_no" in rules.columns and not in_order else rules
    ordered.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """SC-07/SC-08: rule CSV as text, header spellings canonicalised, null ->
    "", plus ``rule_no`` = file order."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    ordinal = F.struct(F.col("_metadata.file_name"), F.monotonically_increasing_id())
    df = canonical_headers(raw.withColumn("_ord", ordinal))
    from ..operators.keys import add_surrogate_key
    return add_surrogate_key(df, "rule_no", ["_ord"], start=0).drop("_ord")


def rules_valid(rules: DataFrame | None) -> bool:
    """SC-10: a rule table exists and has at least one row."""
    return rules is not None and len(rules.take(1)) == 1


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """SC-11 / SC-12 / SC-13 / SC-18: JSON lines."""
    df.coalesce(1).write.mode(mode).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan an artifact with a known schema; missing -> empty frame."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_trace(traces: DataFrame, path: str) -> str:
    """SC-15: append trace records (as many files as the frame has parts)."""
    traces.write.mode("append").json(path)
    return path


def answer_frame(spark: SparkSession, run_id: str, question: str, answer: str, why: str, approach: str,
                 charts: list[dict], detailed: str) -> DataFrame:
    """SC-18: the one-row answer record (direct answer struct, chart specs, text)."""
    schema = ("run_id string, direct_answer struct<question:string, answer:string, why:string, approach:string>, "
              "charts array<struct<type:string, title:string, x_column:string, y_column:string, "
              "labels_column:string, values_column:string>>, detailed_analysis string")
    keys = ["type", "title", "x_column", "y_column", "labels_column", "values_column"]
    ch = [tuple(c.get(k) for k in keys) for c in charts]
    return spark.createDataFrame([(run_id, (question, answer, why, approach), ch, detailed)], schema)


def quality_paths(root: str, run_id: str) -> dict[str, str]:
    """SC-13: report location per layer of a run."""
    return {layer: os.path.join(root, "quality", run_id, layer) for layer in ("bronze", "silver", "gold")}


def read_reports(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """SC-13: the reports of a run's layers as one frame; a layer without a
    report adds no row."""
    from ..operators.quality import FILE_SCHEMA
    out = spark.createDataFrame([], FILE_SCHEMA)
    for path in quality_paths(root, run_id).values():
        out = out.unionByName(read_json(spark, path, FILE_SCHEMA))
    return out


def ensure_report(spark: SparkSession, root: str, run_id: str, layer: str, tables) -> bool:
    """QL-05: write the layer's report where it is missing; True if it was."""
    from ..operators.quality import validate_layer
    path = quality_paths(root, run_id)[layer]
    if _exists(spark, path):
        return False
    write_json(validate_layer(spark, layer, tables, run_id)[0], path)
    return True


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return bool(jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath))  # noqa: SLF001
