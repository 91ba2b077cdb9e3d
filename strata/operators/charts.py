"""Chart-ready frames (CH-01, CH-02; AG-14..AG-17, SL-02, SL-03, D10).

Only the data behind a chart is computed; drawing is left to the caller.
Every top-k is an ``orderBy(...).limit(k)`` with a unique tie-break, which
Spark runs as TakeOrderedAndProject (k rows per task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import is_numeric


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "x string, y double")


def bar_frame(df: DataFrame, x: str, y: str | None, top: int = 10) -> DataFrame:
    """AG-14: sum of ``y`` per ``x``, top ``top``; without ``y``: value counts
    of ``x`` (AG-15). Null groups are left out (D10)."""
    base = df.where(F.col(x).isNotNull())
    if y and y in df.columns:
        return (base.groupBy(x).agg(F.sum(y).alias(y))
                .orderBy(F.desc_nulls_last(y), F.asc(x)).limit(top))
    return value_counts(df, x, top)


def value_counts(df: DataFrame, x: str, top: int = 10, as_text: bool = False) -> DataFrame:
    """AG-15: the ``top`` most frequent values (count desc, value asc)."""
    c = F.col(x).cast("string") if as_text else F.col(x)
    return (df.where(F.col(x).isNotNull()).groupBy(c.alias(x)).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(x)).limit(top))


def pie_frame(df: DataFrame, labels: str, values: str) -> DataFrame:
    """AG-16: sum per label plus its share of the total (the total is one
    scalar aggregate, applied as a literal)."""
    g = df.where(F.col(labels).isNotNull()).groupBy(labels).agg(F.sum(values).alias(values))
    total = df.where(F.col(labels).isNotNull()).agg(F.sum(values).alias("t")).first()["t"]
    share = F.col(values) / F.lit(total) if total else F.lit(None).cast("double")
    return g.select(labels, values, share.alias("share"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """AG-17: least-squares line of ``y`` on ``x`` (one partial aggregate)."""
    return df.agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"),
                  F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"),
                  F.regr_count(F.col(y).cast("double"), F.col(x).cast("double")).alias("n"))


def chart_frame(df: DataFrame, spec: dict, order_by: Sequence[str] | None = None) -> DataFrame:
    """CH-01: the frame behind a bar / line / pie / scatter spec; an unknown
    type or a missing column yields an empty frame."""
    kind = str(spec.get("type", "bar")).lower()
    cols = set(df.columns)
    x, y = spec.get("x_column"), spec.get("y_column")
    if kind == "bar":
        if x not in cols:
            return _empty(df)
        return bar_frame(df, x, y if y in cols else None)
    if kind in ("line", "scatter"):
        if x not in cols or y not in cols:
            return _empty(df)
        out = df.select(x, y)
        return out.orderBy(*order_by) if order_by else out
    if kind == "pie":
        lab, val = spec.get("labels_column"), spec.get("values_column")
        if lab not in cols or val not in cols:
            return _empty(df)
        return pie_frame(df, lab, val)
    return _empty(df)


def auto_chart(df: DataFrame, order_by: Sequence[str]) -> tuple[str, DataFrame]:
    """CH-02: dimension + number -> bar of the first 20 rows; two numbers ->
    scatter of the first 200; one number -> bar of the first 20 rows with
    record labels; otherwise the top-20 values of the first column as text.
    "First" follows ``order_by`` (the frame's defined order)."""
    numeric = [c for c in df.columns if is_numeric(df.schema[c].dataType)]
    dims = [c for c in df.columns if c not in numeric]
    o = [F.col(c) for c in order_by]
    if numeric and dims:
        return "bar", df.orderBy(*o).limit(20).select(dims[0], numeric[0])
    if len(numeric) >= 2:
        return "scatter", df.orderBy(*o).limit(200).select(numeric[0], numeric[1])
    if len(numeric) == 1:
        head = df.orderBy(*o).limit(20)
        from pyspark.sql import Window
        w = Window.orderBy(*o)   # over at most 20 rows
        return "bar", head.select(F.concat(F.lit("row_"), F.row_number().over(w).cast("string")).alias("record"),
                                  numeric[0])
    first = df.columns[0]
    return "bar", value_counts(df, first, top=20, as_text=True)
