"""Grouped aggregates (AG-01, AG-12, AG-13; D9, D21).

All aggregates are algebraic (sum/avg/count/min/max), so Spark plans them
as a partial (map-side) hash aggregate before the shuffle and a final one
after it: a group holding a third of the rows arrives as one partial row
per task, never as raw rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import is_numeric

AGG_FUNCS = ("sum", "mean", "count", "max", "min")


def agg_expr(df: DataFrame, col: str, fn: str) -> Column:
    """One aggregate with the reference's empty-group results:
    sum of nothing = 0 (D9), count = non-null count."""
    c = F.col(f"`{col}`")
    if fn == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if fn in ("mean", "avg"):
        return F.avg(c)
    if fn == "count":
        return F.count(c)
    if fn == "max":
        return F.max(c)
    if fn == "min":
        return F.min(c)
    raise ValueError(f"unknown aggregate {fn}")


def group_aggregate(df: DataFrame, group: Sequence[str], aggs: Sequence[tuple[str, str, str]]
                    ) -> tuple[DataFrame, list[tuple[str, str]]]:
    """AG-01: ``groupBy(group).agg(...)`` keeping null groups.

    ``aggs`` = (column, func, output name). A sum/mean over a non-numeric
    column is rejected with an error entry instead of failing the job (D21).
    """
    errors: list[tuple[str, str]] = []
    exprs = []
    for col, fn, out in aggs:
        if fn in ("sum", "mean", "avg") and not is_numeric(df.schema[col].dataType):
            errors.append((col, f"aggregate '{fn}' rejected: column is not numeric"))
            continue
        exprs.append(agg_expr(df, col, fn).alias(out))
    if not exprs:
        return df, errors
    return df.groupBy(*[F.col(f"`{g}`") for g in group]).agg(*exprs), errors
