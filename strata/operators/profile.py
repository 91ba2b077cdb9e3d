"""Column profile, compact profile, lists of values, semantic classes, quality
notes and join-key candidates (AG-02..AG-04, FN-12, FN-13, JN-04, PR-15).

Cost per table: a row count, then ONE job of per-column aggregate branches
(non-null count, exact distinct count, min/max/mean, first non-null sample
in file order) unioned together: each branch reads only its column
(columnar pruning) and aggregates map-side on the native type. Distinct
counts are exact at any size; ``estimate_distinct=True`` asks for HyperLogLog
estimates instead (flagged ``unique_exact=false``). Only text columns with
fewer than ``lov_max`` distinct values are grouped by (column, value) for
their value lists - a tiny shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import is_numeric, is_string
from ..session import map_jobs
from .keys import ORDINAL_COLUMNS, ordinal_columns

PROFILE_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType(), False),
    T.StructField("column_no", T.IntegerType(), False),
    T.StructField("column", T.StringType(), False),
    T.StructField("dtype", T.StringType(), False),
    T.StructField("row_count", T.LongType(), False),
    T.StructField("null_count", T.LongType(), False),
    T.StructField("null_pct", T.DoubleType(), False),
    T.StructField("unique_count", T.LongType(), True),
    T.StructField("unique_exact", T.BooleanType(), False),
    T.StructField("min", T.DoubleType(), True),
    T.StructField("max", T.DoubleType(), True),
    T.StructField("mean", T.DoubleType(), True),
    T.StructField("sample_value", T.StringType(), True),
])

LOV_MAX_DISTINCT = 50


def _is_null(c: str, dt: T.DataType):
    col = F.col(f"`{c}`")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _data_columns(df: DataFrame, max_columns: int | None) -> list[str]:
    cols = [c for c in df.columns if c not in ORDINAL_COLUMNS]
    return cols[:max_columns] if max_columns else cols


_STATS_SCHEMA = "c string, nn long, u long, mn double, mx double, av double, s string"


#: Longer texts are told apart by their SHA-256, so that a distinct count
#: shuffles 32 bytes of a document and not the document.
HASHED_FROM = 64


def _identity(col, dt):
    """A value that is equal exactly where the column's values are."""
    if not isinstance(dt, (T.StringType, T.BinaryType)):
        return col
    raw = col.cast("binary")
    return F.when(F.octet_length(raw) <= HASHED_FROM, raw).otherwise(F.unhex(F.sha2(raw, 256)))


def _column_stats(df: DataFrame, cols: list[str], exact: set[str], order_key) -> dict[str, dict]:
    """Per-column statistics as ONE job: one aggregate branch per column,
    unioned. Each branch reads only its column (columnar pruning) and is
    aggregated map-side; exact distinct counts only for ``exact`` columns."""
    parts = []
    for c in cols:
        dt = df.schema[c].dataType
        col = F.col(f"`{c}`")
        nn = ~_is_null(c, dt)
        u = F.count_distinct(F.when(nn, _identity(col, dt))) if c in exact else F.lit(None).cast("long")
        if is_numeric(dt):
            v = F.when(nn, col.cast("double"))
            mn, mx, av, smp = F.min(v), F.max(v), F.avg(v), F.lit(None).cast("string")
        else:
            none = F.lit(None).cast("double")
            mn = mx = av = none
            sv = F.when(nn, col)
            # SL-05: first non-null sample in file order, made a text once
            smp = (F.min_by(sv, F.when(nn, order_key)) if order_key is not None else F.first(sv, ignorenulls=True)).cast("string")
        parts.append(df.agg(F.lit(c).alias("c"), F.count(F.when(nn, 1)).alias("nn"), u.cast("long").alias("u"),
                            mn.alias("mn"), mx.alias("mx"), av.alias("av"), smp.alias("s")))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return {r["c"]: r.asDict() for r in out.collect()}


def profile_table(name: str, df: DataFrame, max_columns: int | None = None,
                  estimate_distinct: bool = False, with_lov: bool = True,
                  lov_max: int = LOV_MAX_DISTINCT, distinct: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Profile one table -> (profile rows, list-of-values rows). Without
    ``distinct`` no distinct values are counted (null, not exact), which leaves
    one aggregate without a shuffle of values, and no lists of values."""
    spark = df.sparkSession
    cols = _data_columns(df, max_columns)
    ords = ordinal_columns(df)
    order_key = F.struct(*[F.col(o) for o in ords]) if ords else None
    rows_total = int(df.count())
    # exact at any size; an estimate only where the caller asks for one
    estimate: dict[str, int] = {}
    if estimate_distinct and cols:
        hll = df.agg(*[F.approx_count_distinct(F.when(~_is_null(c, df.schema[c].dataType), F.col(f"`{c}`")))
                       .alias(f"h{i}") for i, c in enumerate(cols)]).first()
        estimate = {c: int(hll[f"h{i}"] or 0) for i, c in enumerate(cols)}
    exact_cols = [c for c in cols if c not in estimate] if distinct else []
    stats = _column_stats(df, cols, set(exact_cols), order_key) if cols else {}
    out = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        st = stats[c]
        nulls = rows_total - int(st["nn"])
        exact = c in exact_cols
        u = int(st["u"] or 0) if exact else estimate.get(c)
        pct = round(nulls * 100.0 / rows_total, 2) if rows_total else 0.0
        out.append((name, i, c, dt.simpleString(), rows_total, nulls, float(pct), u, exact,
                    st["mn"], st["mx"], st["av"], st["s"]))
    prof = spark.createDataFrame(out, PROFILE_SCHEMA)
    lov = None
    lov_cols = [c for c in exact_cols if is_string(df.schema[c].dataType) and 0 < int(stats[c]["u"] or 0) < lov_max]
    if with_lov and lov_cols:
        # value lists only for text columns proven small: a tiny shuffle
        pairs = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in lov_cols]))
            .alias("p")).select("p.column", "p.value").where(F.col("value").isNotNull())
        lov = (pairs.groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))
               .select(F.lit(name).alias("dataset"), "column", "value", "freq"))
    return prof, lov


def profile(tables: Mapping[str, DataFrame], compact: bool = False, **kw) -> tuple[DataFrame, DataFrame | None]:
    """AG-02 / AG-03: profile of every table as one long frame (one row per
    (dataset, column)); AG-04: the lists of values. ``compact`` keeps the
    first 15 columns of each table."""
    profs, lovs = [], []
    with_lov = kw.pop("with_lov", not compact)
    parallel = max(1, int(kw.pop("parallel", 4)))
    items = list(tables.items())

    def one(item):
        n, df = item
        return profile_table(n, df, max_columns=15 if compact else None, with_lov=with_lov, **kw)

    # SC-05: the per-table jobs are independent; submitting a few at once
    # keeps the executors busy while a small table's job is being scheduled
    results = map_jobs(items[0][1].sparkSession, one, items, parallel) if items else []
    for p, l in results:
        profs.append(p)
        if l is not None:
            lovs.append(l)
    prof = profs[0]
    for p in profs[1:]:
        prof = prof.unionByName(p)
    lov = None
    if lovs:
        lov = lovs[0]
        for l in lovs[1:]:
            lov = lov.unionByName(l)
        uc = lov.groupBy("dataset", "column").agg(F.count(F.lit(1)).alias("unique_count"))
        lov = lov.join(uc, ["dataset", "column"]).select("dataset", "column", "unique_count", "value", "freq")
    return prof, lov


def semantic_class(column: F.Column, dtype: F.Column) -> F.Column:
    """FN-12: identifier, date/time, monetary, quantity, numeric, text (first hit)."""
    n = F.lower(column)
    d = F.lower(dtype)
    money = None
    for k in ("price", "amount", "cost", "revenue", "total"):
        t = n.contains(k)
        money = t if money is None else (money | t)
    return (F.when((n == "id") | n.endswith("_id"), "Identifier column")
            .when(n.contains("date") | n.contains("time"), "Date/time column")
            .when(money, "Monetary/numeric measure")
            .when(n.contains("qty") | n.contains("quantity"), "Quantity measure")
            .when(d.contains("int") | d.contains("float") | d.contains("double") | d.contains("decimal")
                  | d.contains("long") | d.contains("short") | d.contains("byte"), "Numeric attribute")
            .otherwise("Categorical/text attribute"))


def semantic_classes(prof: DataFrame) -> DataFrame:
    return prof.select("dataset", "column", semantic_class(F.col("column"), F.col("dtype")).alias("meaning"))


def quality_notes(prof: DataFrame, threshold: float = 20.0) -> DataFrame:
    """FN-13: one note per column with null_pct above ``threshold``; a single
    "no issues" note when there is none."""
    spark = prof.sparkSession
    notes = prof.where(F.col("null_pct") > threshold).select(
        F.format_string("%s.%s has high null percentage (%s%%).", "dataset", "column",
                        F.col("null_pct").cast("string")).alias("note"))
    if notes.take(1):
        return notes
    return spark.createDataFrame(
        [("No major deterministic quality issues detected in profiling fallback.",)], "note string")


def catalog_frame(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(dataset, dataset_no, column_no, column, dtype) from schemas only (no data read)."""
    rows = []
    for di, (n, df) in enumerate(tables.items()):
        for ci, c in enumerate(_data_columns(df, None)):
            rows.append((n, di, ci, c, df.schema[c].dataType.simpleString()))
    return spark.createDataFrame(rows, "dataset string, dataset_no int, column_no int, column string, dtype string")


def preview(name: str, df: DataFrame, max_columns: int = 12) -> DataFrame:
    """PR-15: shape, first ``max_columns`` columns, dtype, null count and the
    first non-null value in file order (one aggregate)."""
    cols = _data_columns(df, max_columns)
    ords = ordinal_columns(df)
    at = F.struct(*[F.col(o) for o in ords]) if ords else None
    exprs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        null = _is_null(c, df.schema[c].dataType)
        value = F.when(~null, F.col(f"`{c}`"))
        exprs += [F.count(F.when(null, 1)).alias(f"n{i}"),
                  (F.min_by(value, F.when(~null, at)) if ords else F.first(value, ignorenulls=True)).cast("string").alias(f"s{i}")]
    row = df.agg(*exprs).first()
    ncols = len(_data_columns(df, None))
    data = [(name, int(row["_rows"]), ncols, i, c, df.schema[c].dataType.simpleString(), int(row[f"n{i}"]), row[f"s{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        data, "dataset string, rows long, columns int, column_no int, column string, dtype string, null_count long, sample_value string")
