"""Deterministic rule generation (RG-01 bronze, RG-02 silver, RG-03 gold) and
rule coverage (QL-06).

Rules are derived with DataFrame expressions over the profile / catalog
frames (one row per column), so the result is itself a reviewable table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import is_numeric, is_temporal
from ..operators.keys import SOURCE_ROW
from .rules import RULE_COLUMNS

# Generated rule texts.
BRONZE_LOGIC_DEFAULT = "Direct pass-through from source to Bronze layer"
BRONZE_LOGIC_INT = "Direct pass-through; preserve integer type"
BRONZE_LOGIC_FLOAT = "Direct pass-through; preserve numeric type"
BRONZE_LOGIC_DATE = "Direct pass-through; preserve date/time value"
LOAD_TS_LOGIC = "Current UTC timestamp injected at load time"
SOURCE_FILE_LOGIC = "Source file path injected at load time"
KEY_LOGIC = "Auto-generated sequential surrogate primary key starting from 1"
SILVER_ID_INT = "Type cast to integer for id column"
SILVER_ID_TEXT = "Type cast to text for id column; strip whitespace"
SILVER_DATE_NULLS = "Fill null with mode; date standardisation to YYYY-MM-DD"
SILVER_DATE = "Date standardisation to YYYY-MM-DD"
SILVER_NUM_NULLS = "Fill null with median; convert to float numeric"
SILVER_NUM = "Convert to float numeric"
SILVER_TEXT_NULLS = "Fill null default value; convert to text; lowercase; strip whitespace"
SILVER_TEXT = "Convert to text; strip whitespace"
GOLD_LOGIC = "Direct pass-through from Silver to Gold fallback view"

_SLOT = 100_000   # rule_no = table_no * _SLOT + position inside the table


def _rules(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in RULE_COLUMNS], F.col("rule_no").cast("long"))


def bronze_rules(prof: DataFrame) -> DataFrame:
    """RG-01: one Direct row per profiled column (logic by type) plus two
    lineage rows per table. ``prof`` needs dataset, dataset_no, column_no,
    column, dtype."""
    d = F.lower(F.col("dtype"))
    logic = (F.when(d.contains("int"), BRONZE_LOGIC_INT)
             .when(d.contains("float") | d.contains("double") | d.contains("decimal"), BRONZE_LOGIC_FLOAT)
             .when(d.contains("date") | d.contains("time"), BRONZE_LOGIC_DATE)
             .otherwise(BRONZE_LOGIC_DEFAULT))
    tgt = F.concat(F.col("dataset"), F.lit("_bronze"))
    cols = prof.select(F.lit("raw").alias("source_schema"), F.col("dataset").alias("source_table"),
                       F.col("column").alias("source_column"), F.lit("bronze").alias("target_schema"),
                       tgt.alias("target_table"), F.col("column").alias("target_column"),
                       F.lit("Direct").alias("transformation_type"), logic.alias("transformation_logic"),
                       (F.col("dataset_no") * _SLOT + F.col("column_no")).alias("rule_no"))
    tables = prof.select("dataset", "dataset_no").distinct()
    lineage = []
    for i, (name, text) in enumerate([("_load_timestamp", LOAD_TS_LOGIC), ("_source_file", SOURCE_FILE_LOGIC)]):
        lineage.append(tables.select(
            F.lit("raw").alias("source_schema"), F.col("dataset").alias("source_table"),
            F.lit("").alias("source_column"), F.lit("bronze").alias("target_schema"),
            F.concat(F.col("dataset"), F.lit("_bronze")).alias("target_table"),
            F.lit(name).alias("target_column"), F.lit("Indirect").alias("transformation_type"),
            F.lit(text).alias("transformation_logic"),
            (F.col("dataset_no") * _SLOT + F.lit(_SLOT - 2 + i)).alias("rule_no")))
    return _rules(cols.unionByName(lineage[0]).unionByName(lineage[1]))


def silver_logic(name: Column, is_int: Column, is_num: Column, is_time: Column, has_nulls: Column) -> Column:
    """RG-02 logic per column from name x type x has-nulls."""
    n = F.lower(name)
    is_id = (n == "id") | n.endswith("_id") | n.startswith("id_")
    is_date = n.contains("date") | n.contains("time") | is_time
    return (F.when(is_id & is_int, SILVER_ID_INT)
            .when(is_id, SILVER_ID_TEXT)
            .when(is_date & has_nulls, SILVER_DATE_NULLS)
            .when(is_date, SILVER_DATE)
            .when(is_num & has_nulls, SILVER_NUM_NULLS)
            .when(is_num, SILVER_NUM)
            .when(has_nulls, SILVER_TEXT_NULLS)
            .otherwise(SILVER_TEXT))


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame], with_nulls: bool = True,
                   null_counts: Mapping[str, Mapping[str, int]] | None = None) -> DataFrame:
    """(table, table_no, column_no, column, dtype, is_int, is_num, is_time,
    has_nulls); ``has_nulls`` comes from ``null_counts`` where a report
    already holds them, and costs ONE job for all other tables (a branch per
    table, each an array of per-column null flags, unioned)."""
    known = null_counts or {}
    rows = []
    items = list(tables.items())
    colsets = [[c for c in df.columns if c != SOURCE_ROW] for _, df in items]
    flags: dict[int, list] = {}
    branches = [df.agg(F.lit(ti).alias("_t"), F.array(*[F.max(is_missing(df, c).cast("int")) for c in cols]).alias("_n"))
                for ti, ((name, df), cols) in enumerate(zip(items, colsets)) if with_nulls and cols and name not in known]
    if branches:
        out = branches[0]
        for b in branches[1:]:
            out = out.unionByName(b)
        flags = {int(r["_t"]): list(r["_n"]) for r in out.collect()}
    for ti, ((name, df), cols) in enumerate(zip(items, colsets)):
        nulls = {c: bool(flags[ti][i]) for i, c in enumerate(cols)} if ti in flags else {}
        if with_nulls and name in known:
            nulls = {c: known[name].get(c, 0) > 0 for c in cols}
        for ci, c in enumerate(cols):
            dt = df.schema[c].dataType
            rows.append((name, ti, ci, c, dt.simpleString(),
                         dt.typeName() in ("byte", "short", "integer", "long"), is_numeric(dt),
                         is_temporal(dt), nulls.get(c, False)))
    return spark.createDataFrame(rows, "table string, table_no int, column_no int, column string, dtype string, "
                                       "is_int boolean, is_num boolean, is_time boolean, has_nulls boolean")


def is_missing(df: DataFrame, c: str):
    """Null, or NaN in a floating-point column."""
    col = F.col(f"`{c}`")
    return col.isNull() | F.isnan(col) if df.schema[c].dataType.typeName() in ("float", "double") else col.isNull()


def silver_rules(catalog: DataFrame) -> DataFrame:
    """RG-02: per bronze table a key row, then one Direct row per column."""
    fname = F.concat(F.col("table"), F.lit(".parquet"))
    tgt = F.regexp_replace(F.col("table"), "_bronze", "_silver")
    cols = catalog.select(
        F.lit("bronze").alias("source_schema"), fname.alias("source_table"),
        F.col("column").alias("source_column"), F.lit("silver").alias("target_schema"),
        tgt.alias("target_table"), F.col("column").alias("target_column"),
        F.lit("Direct").alias("transformation_type"),
        silver_logic(F.col("column"), F.col("is_int"), F.col("is_num"), F.col("is_time"),
                     F.col("has_nulls")).alias("transformation_logic"),
        (F.col("table_no") * _SLOT + F.col("column_no") + 1).alias("rule_no"))
    keys = catalog.select("table", "table_no").distinct().select(
        F.lit("bronze").alias("source_schema"), F.concat(F.col("table"), F.lit(".parquet")).alias("source_table"),
        F.lit("").alias("source_column"), F.lit("silver").alias("target_schema"),
        F.regexp_replace(F.col("table"), "_bronze", "_silver").alias("target_table"),
        F.concat(F.lit("pk_"), F.col("table"), F.lit("_silver_id")).alias("target_column"),
        F.lit("Indirect").alias("transformation_type"), F.lit(KEY_LOGIC).alias("transformation_logic"),
        (F.col("table_no") * _SLOT).alias("rule_no"))
    return _rules(keys.unionByName(cols))


def gold_rules(catalog: DataFrame) -> DataFrame:
    """RG-03: a leading ``gold_fallback`` key row (blank source: never built),
    then a pass-through row per silver column."""
    spark = catalog.sparkSession
    cols = catalog.select(
        F.lit("silver").alias("source_schema"), F.col("table").alias("source_table"),
        F.col("column").alias("source_column"), F.lit("gold").alias("target_schema"),
        F.regexp_replace(F.col("table"), "_silver", "_gold").alias("target_table"),
        F.col("column").alias("target_column"), F.lit("Direct").alias("transformation_type"),
        F.lit(GOLD_LOGIC).alias("transformation_logic"),
        ((F.col("table_no") + 1) * _SLOT + F.col("column_no")).alias("rule_no"))
    head = spark.createDataFrame(
        [("silver", "", "", "gold", "gold_fallback", "pk_gold_id", "Indirect", KEY_LOGIC, 0)],
        ", ".join(f"{c} string" for c in RULE_COLUMNS) + ", rule_no long")
    return _rules(head.unionByName(cols))


def uncovered_rules(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """QL-06: rules whose (table, column) matches no catalog entry (a
    left-anti join; blank source columns are lineage/key rows and skipped)."""
    stem = F.regexp_replace(F.regexp_replace(F.col("source_table"), "\\.(csv|parquet)$", ""), "_silver$", "")
    r = rules.where(F.col("source_column") != "").withColumn("_stem", stem)
    cat = catalog.select(F.regexp_replace(F.col("table"), "_silver$", "").alias("_t"), F.col("column").alias("_c"))
    named = r.where(F.col("source_table") != "").join(
        cat, (F.col("_stem") == F.col("_t")) & (F.col("source_column") == F.col("_c")), "left_anti")
    blank = r.where(F.col("source_table") == "").join(
        cat.select("_c").distinct(), F.col("source_column") == F.col("_c"), "left_anti")
    return named.unionByName(blank).drop("_stem")
