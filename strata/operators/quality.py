"""Layer quality report (QL-01..QL-06, AG-08..AG-11, SO-03).

Per table: ONE aggregate job for row count and per-column null counts, and
an exact duplicate-row count that shuffles two 64-bit hashes per row instead
of whole rows: rows are grouped by (xxhash64, salted xxhash64); only rows in
hash groups of size > 1 (candidates) are compared whole, and without a
candidate the count ends there. Hash equality is necessary for row equality,
so the count is exact; collisions only add candidates to verify. The report
never blocks the pipeline.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import map_jobs, stage_table
from .keys import SOURCE_ROW

FILE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("layer_name", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("column_count", T.LongType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("dtypes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("null_pct_by_column", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("duplicate_row_count", T.LongType()),
    T.StructField("is_empty", T.BooleanType()),
    T.StructField("missing_expected_columns", T.ArrayType(T.StringType())),
    T.StructField("unexpected_columns", T.ArrayType(T.StringType())),
    T.StructField("warnings", T.ArrayType(T.StringType())),
])


def duplicate_check_columns(df: DataFrame) -> list[str]:
    """Columns that define a duplicate: generated keys and the scan ordinal
    are excluded, else every row would be unique (D27)."""
    return [c for c in df.columns if not c.startswith("pk_") and c != SOURCE_ROW]


#: Candidate hashes are broadcast up to this many (16 bytes each); beyond it
#: both sides are shuffled by hash.
MAX_BROADCAST_HASHES = 500_000


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> int:
    """AG-09: rows beyond the first of each identical group (exact)."""
    cols = list(cols) if cols is not None else duplicate_check_columns(df)
    if not cols:
        return 0
    refs = [F.col(f"`{c}`") for c in cols]
    hashed = df.select(F.xxhash64(*refs).alias("_h1"), F.xxhash64(F.lit("strata"), *refs).alias("_h2"), *refs)
    cand = stage_table(hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
                       .where(F.col("_n") > 1).select("_h1", "_h2"), "repeated-hashes")
    n = cand.count()
    if n == 0:
        return 0
    # the join drops every other row where it is read; equal rows then meet
    # in the partial aggregate before anything is shuffled
    cand = F.broadcast(cand) if n <= MAX_BROADCAST_HASHES else cand
    suspects = hashed.join(cand, ["_h1", "_h2"], "left_semi").select(*refs)
    row = (suspects.groupBy(*refs).agg(F.count(F.lit(1)).alias("_n"))
           .agg(F.sum(F.col("_n") - 1).alias("d")).first())
    return int(row["d"] or 0)


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """(row count, nulls per column; NaN counts as null), one aggregate."""
    exprs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        col = F.col(f"`{c}`")
        isn = col.isNull()
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            isn = isn | F.isnan(col)
        exprs.append(F.count(F.when(isn, 1)).alias(f"n{i}"))
    row = df.agg(*exprs).first()
    rows = int(row["_rows"])
    return rows, {c: int(row[f"n{i}"]) for i, c in enumerate(df.columns)}


def null_percent(rows: int, nulls: Mapping[str, int]) -> dict[str, float]:
    return {c: (round(n * 100.0 / rows, 2) if rows else 0.0) for c, n in nulls.items()}


def null_pct_by_column(df: DataFrame) -> tuple[int, dict[str, float]]:
    """AG-08: (row count, null % per column rounded to 2 dp; empty -> 0.0)."""
    rows, nulls = null_counts(df)
    return rows, null_percent(rows, nulls)


def compare_columns(actual: Sequence[str], expected: Sequence[str] | None) -> tuple[list[str], list[str]]:
    """SO-03: (missing = expected - actual, unexpected = actual - expected
    when an expectation is given), sorted."""
    exp = set(expected or [])
    act = set(actual)
    return sorted(exp - act), (sorted(act - exp) if exp else [])


def file_summary(name: str, df: DataFrame, expected: Sequence[str] | None = None) -> dict:
    """QL-01/QL-02 for one table (AG-10 summary: rows, columns, dtypes, empty
    flag); a failure becomes a warning, never an error."""
    out = {"file_path": name, "warnings": []}
    try:
        rows, nulls = null_counts(df)
        dups = duplicate_count(df) if rows else 0
        missing, unexpected = compare_columns(df.columns, expected)
        out.update({
            "row_count": rows, "column_count": len(df.columns), "columns": list(df.columns),
            "dtypes": {f.name: f.dataType.simpleString() for f in df.schema.fields},
            "null_pct_by_column": null_percent(rows, nulls), "null_counts": nulls, "duplicate_row_count": dups, "is_empty": rows == 0,
            "missing_expected_columns": missing, "unexpected_columns": unexpected,
        })
        if rows == 0:
            out["warnings"].append("Output File is Empty.")
        if len(df.columns) == 0:
            out["warnings"].append("Output File has zero Columns")
        if missing:
            out["warnings"].append("Missing Expected Columns detected.")
        if dups > 0:
            out["warnings"].append(f"Duplicate rows detected : {dups}")
    except Exception as exc:  # noqa: BLE001 - the report must not block
        out["warnings"].append(f"Validation Failed : {str(exc)[:300]}")
    return out


def layer_report(spark: SparkSession, layer: str, files: Sequence[dict], run_id: str = "") -> tuple[DataFrame, dict]:
    """QL-03: the per-table rows and the layer summary (AG-11) of summaries
    made now or kept from an earlier run."""
    files = list(files) or [{"file_path": "", "warnings": ["No Output File were provided for validation."]}]
    names = [f.name for f in FILE_SCHEMA.fields if f.name not in ("run_id", "layer_name")]
    frame = spark.createDataFrame([(run_id, layer, *[f.get(n) for n in names]) for f in files], FILE_SCHEMA)
    with_w = sum(1 for f in files if f["warnings"])
    total_w = sum(len(f["warnings"]) for f in files)
    summary = {
        "run_id": run_id, "layer_name": layer,
        "validated_at": _dt.datetime.now(_dt.timezone.utc).isoformat(),
        "warn_only": True, "status": "warning" if total_w else "passed",
        "summary": {"file_count": sum(1 for f in files if f["file_path"]), "files_with_warnings": with_w, "total_warnings": total_w},
        # exact counts, for steps that would scan the tables for them again
        "null_counts": {f["file_path"]: f["null_counts"] for f in files if "null_counts" in f},
    }
    return frame, summary


def validate_layer(spark: SparkSession, layer: str, tables: Mapping[str, DataFrame], run_id: str = "",
                   expected: Mapping[str, Sequence[str]] | None = None,
                   parallel: int = 4) -> tuple[DataFrame, dict]:
    """QL-01/QL-03: per-table rows (QL-04 flattened) and the layer summary (AG-11).
    The per-table jobs are independent and submitted ``parallel`` at a time."""
    expected = expected or {}
    files = map_jobs(spark, lambda it: file_summary(it[0], it[1], expected.get(it[0])), tables.items(), parallel) if tables else []
    return layer_report(spark, layer, files, run_id)


def rollup(files: DataFrame) -> DataFrame:
    """AG-11: file count, files with warnings, total warnings, status per layer."""
    nw = F.size(F.coalesce(F.col("warnings"), F.array().cast("array<string>")))
    return (files.groupBy("run_id", "layer_name")
            .agg(F.count(F.col("file_path")).alias("file_count"),
                 F.count(F.when(nw > 0, 1)).alias("files_with_warnings"),
                 F.sum(nw).cast("long").alias("total_warnings"))
            .withColumn("status", F.when(F.col("total_warnings") > 0, "warning").otherwise("passed")))


def flatten(files: DataFrame) -> DataFrame:
    """QL-04: one row per table with the warnings as one text."""
    return files.select("layer_name", F.col("file_path").alias("table"), "row_count", "column_count",
                        "duplicate_row_count", F.concat_ws("; ", "warnings").alias("warnings"))
