"""Joins of gold tables by order (JN-05, QS-01): as-of and range joins,
without a nested loop.

**As-of join.** Each left row gets the latest right row of its key at or
before its time. Time is cut in bins, so a hot key is many small groups: inside
a (key, bin) both sides are merged in time order, and what an earlier bin holds
comes from one row a (key, bin) that a window carries forward.

**Range join.** Each left value meets the right intervals that hold it.
An interval goes to the bins of the smallest power of two that is not
shorter than it, so it lies in two of them at most; a value looks in its bin of
each width that occurs. So neither side's copies depend on the intervals' lengths.
The pairs of each bin are counted first (one row a bin and key): they settle how
many tasks make them, and a bin of very many is shared by several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.clean import is_temporal
from ..session import stage_table
from . import joins

#: Bins that the time range of an as-of join is cut in.
BINS = 4096


def as_number(df: DataFrame, name: str) -> Column:
    """A value as a number that grows with it: whole numbers and times
    (microseconds) as longs, all others as doubles."""
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long") * 86_400_000_000
    if is_temporal(dtype):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("long") if isinstance(dtype, T.IntegralType) else c.cast("double")


def as_of_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
               prefix: str = "", bins: int = BINS) -> DataFrame:
    """Every left row with the columns of the latest right row of the same
    ``keys`` whose ``right_time`` is not after ``left_time`` (of several at one
    time the one with the largest values, in every run); null where there is
    none, where a key is null or the time is null. The right columns (but the
    keys) get ``prefix``; one that then names a left column is left out (D28)."""
    payload = [c for c in right.columns if c not in keys and prefix + c not in left.columns]
    span = left.agg(F.min(as_number(left, left_time)), F.max(as_number(left, left_time))).first()
    start, width = span[0] or 0.0, max(((span[1] or 0.0) - (span[0] or 0.0)) / bins, 1e-6)

    def bin_of(df, name):  # what lies before the first left row is one bin
        return F.greatest(F.floor((as_number(df, name) - start) / width), F.lit(-1)).cast("long")
    ks = [f"_k{i}" for i in range(len(keys))]
    known = [F.col(f"`{k}`").isNotNull() for k in keys]
    at = right.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks)], bin_of(right, right_time).alias("_bin"),
                      as_number(right, right_time).alias("_t"), F.struct(F.col(f"`{right_time}`").alias("_at"), *[
                          F.col(f"`{c}`") for c in payload]).alias("_r"), *[c.alias(f"_ok{i}") for i, c in enumerate(known)])
    at = at.where("_t IS NOT NULL" + "".join(f" AND _ok{i}" for i in range(len(keys)))).select(*ks, "_bin", "_t", "_r")
    whole = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    rows = left.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks)], bin_of(left, left_time).alias("_bin"),
                       as_number(left, left_time).alias("_t"), whole.alias("_l"))
    # inside a bin: both sides in time order, right rows first at equal times
    none_l, none_r = F.lit(None).cast(rows.schema["_l"].dataType), F.lit(None).cast(at.schema["_r"].dataType)
    both = rows.select(*ks, "_bin", "_t", F.lit(1).alias("_side"), "_l", none_r.alias("_r")).unionByName(
        at.select(*ks, "_bin", "_t", F.lit(0).alias("_side"), none_l.alias("_l"), "_r"))
    near = W.partitionBy(*ks, "_bin").orderBy("_t", "_side", "_r").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = both.withColumn("_near", F.when(F.col("_t").isNotNull(), F.last("_r", ignorenulls=True).over(near))).where("_side = 1")
    # from earlier bins: one row a (key, bin), carried forward
    last = at.groupBy(*ks, "_bin").agg(F.max(F.struct("_t", "_r")).alias("_m"))
    needed = rows.where(F.col("_t").isNotNull()).select(*ks, "_bin", F.lit(None).cast(last.schema["_m"].dataType).alias("_m")).distinct()
    steps = last.unionByName(needed).groupBy(*ks, "_bin").agg(F.max("_m").alias("_m"))
    before = W.partitionBy(*ks).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    carried = steps.select(*[F.col(k).alias(f"_c{k}") for k in ks], F.col("_bin").alias("_cbin"),
                           F.last("_m", ignorenulls=True).over(before)["_r"].alias("_far"))
    same = F.col("_bin") == F.col("_cbin")
    for k in ks:
        same = same & (F.col(k) == F.col(f"_c{k}"))
    found = merged.join(carried, same, "left").withColumn("_x", F.coalesce("_near", "_far"))
    return found.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns],
                        *[F.col("_x._at" if c == right_time else f"_x.`{c}`").alias(prefix + c) for c in payload])


def range_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, keys: Sequence[str] = (),
               how: str = "inner", closed: bool = False) -> DataFrame:
    """Left rows with every right row whose interval [``low``, ``high``) (with
    ``closed``: [low, high]) holds ``value`` and whose ``keys`` agree; ``how``
    is ``inner`` or ``left``. A null bound, value or key meets nothing, nor
    does an empty interval. Right columns that name a left one are left out."""
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if how == "left":
        # the row ids must be the same in both uses, so they are written
        numbered = stage_table(left.withColumn("_id", F.monotonically_increasing_id()), "range-left")
        rows, spans, cond = _range_sides(numbered, right, value, low, high, keys, closed)
        names = numbered.columns + [c for c in right.columns if c not in numbered.columns]
        inner = rows.join(spans, cond, "inner").select(*[F.col(f"`{c}`") for c in names])
        # whether a row is held needs one interval of a bin, not its pairs
        alone = numbered.join(rows.join(spans, cond, "left_semi").select("_id").distinct(), "_id", "left_anti")
        return inner.unionByName(alone, allowMissingColumns=True).drop("_id")
    rows, spans, cond = _range_sides(left, right, value, low, high, keys, closed)
    return rows.join(spans, cond, "inner").select(*[F.col(f"`{c}`") for c in (*left.columns, *[c for c in right.columns if c not in left.columns])])


def _range_sides(left: DataFrame, right: DataFrame, value: str, low: str, high: str, keys: Sequence[str],
                 closed: bool) -> tuple[DataFrame, DataFrame, Column]:
    """The left rows, one for each bin they look in, the intervals, one for
    each bin they lie in, and the condition that makes their pairs."""
    payload = [c for c in right.columns if c not in left.columns]
    lo, hi = as_number(right, low), as_number(right, high)
    level = F.ceil(F.log2(F.greatest(hi - lo, F.lit(2.0 ** -20)))).cast("int")
    spans = right.where(lo.isNotNull() & hi.isNotNull() & (lo <= hi)).select(
        *[F.col(f"`{k}`").alias(f"_rk{i}") for i, k in enumerate(keys)], F.col(f"`{low}`").alias("_low"), F.col(f"`{high}`").alias("_high"),
        level.alias("_level"), lo.alias("_a"), hi.alias("_b"), *[F.col(f"`{c}`") for c in payload])
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())  # powers of two: at most some hundred
    scale = F.pow(F.lit(2.0), F.col("_level"))
    spans = spans.withColumn("_rbin", F.explode(F.array_distinct(F.array(F.floor(F.col("_a") / scale), F.floor(F.col("_b") / scale))))).drop("_a", "_b")
    v = as_number(left, value)
    look = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(v / math.ldexp(1.0, n)).alias("bin")) for n in levels])
    rows = left.withColumn("_at", F.explode_outer(F.when(v.isNotNull(), look))) if levels else left.withColumn(
        "_at", F.lit(None).cast("struct<level:int,bin:bigint>"))
    rows = rows.select(*[F.col(f"`{c}`") for c in left.columns], F.col("_at.level").alias("_ll"), F.col("_at.bin").alias("_lb"))
    there = ["_level", "_rbin", *[f"_rk{i}" for i in range(len(keys))]]
    here = ["_ll", "_lb", *keys]
    held = (F.col(f"`{value}`") >= F.col("_low")) & (F.col(f"`{value}`") <= F.col("_high") if closed else F.col(f"`{value}`") < F.col("_high"))
    cond = held
    for a, b in zip(here, there):
        cond = cond & (F.col(f"`{a}`") == F.col(b))
    if not levels:
        return rows, spans, cond
    # how many pairs each bin has
    met = (rows.groupBy(*[F.col(f"`{a}`").alias(f"_c{i}") for i, a in enumerate(here)]).agg(F.count(F.lit(1)).alias("_n"))
           .join(spans.groupBy(*[F.col(b).alias(f"_d{i}") for i, b in enumerate(there)]).agg(F.count(F.lit(1)).alias("_m")),
                 [F.col(f"_c{i}") == F.col(f"_d{i}") for i in range(len(here))])
           .select(*[f"_c{i}" for i in range(len(here))], (F.col("_n") * F.col("_m")).alias("_pairs")))
    met = stage_table(met, "range-bins")
    most = joins.MOST_NULL_PAIRS
    total, full = met.agg(F.sum("_pairs"), F.count_if(F.col("_pairs") > most)).first()
    tasks = joins.pair_tasks(total or 0, left.sparkSession.sparkContext.defaultParallelism)
    if full:
        # at most total / most rows: the bins that several tasks share
        shared = F.broadcast(met.where(F.col("_pairs") > most).withColumn("_tasks", F.ceil(F.col("_pairs") / most).cast("int")).drop("_pairs"))

        def with_tasks(df, names):
            same = [F.col(f"`{c}`") == F.col(f"_c{i}") for i, c in enumerate(names)]
            return df.join(shared, same, "left").withColumn("_tasks", F.coalesce("_tasks", F.lit(1))).drop(*[f"_c{i}" for i in range(len(names))])
        rows = with_tasks(rows, here).withColumn("_ls", F.pmod(F.monotonically_increasing_id(), F.col("_tasks")).cast("int")).drop("_tasks")
        spans = with_tasks(spans, there).withColumn("_rs", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))).drop("_tasks")
        cond = cond & (F.col("_ls") == F.col("_rs"))
        here = [*here, "_ls"]
    if tasks > 1:
        # by number: few bytes may make many pairs; and neither side is broadcast,
        # for beside broadcast rows the intervals' few tasks would make the pairs.
        # Written, the intervals' level stays a key where it is the same for all
        rows = rows.repartition(tasks, *[F.col(f"`{a}`") for a in here])
        spans = stage_table(spans, "range-spans").hint("merge")
    return rows, spans, cond
