"""Whole-column statistics that decide a plan before it runs (AG-05..07, AG-18,
D2, D11): mean, exact median, mode, fractional flags and date-format votes.

Each is one distributed job whose result is a scalar on the driver. None of
them uses Spark's exact ``median``/``percentile``/``mode`` aggregates for a
global statistic: those keep a value->count map of the whole column in one
aggregation buffer, i.e. one task holds every distinct value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.clean import as_double, fractional_flag
from ..functions.dates import first_format_from_votes, format_vote_exprs
from ..session import ensure_checkpoint_dir, stage_table

def mean_value(df: DataFrame, c: str) -> float | None:
    """AG-05: mean of the numeric reading of ``c`` (partial + final agg)."""
    dtype = df.schema[c].dataType
    d = as_double(c, dtype)
    v = df.agg(F.avg(F.when(~F.isnan(d), d)).alias("m")).first()["m"]
    return None if v is None else float(v)


def weighted_quantiles(weighted: DataFrame, value: str, weight: str, fractions: list[float]) -> list[list]:
    """Values at the middle ranks of a multiset given as distinct ``value``
    rows with multiplicity ``weight``: for each fraction q, the values at
    0-based ranks floor(q*(n-1)) and ceil(q*(n-1)).

    The distinct values are sorted and written once (``sorted_table``); the
    per-part weight totals (one row per part) give n and locate the part
    holding each rank, and only that part's file is read and scanned with a
    running sum.
    """
    from pyspark.sql import Window
    from .keys import part_offsets, sorted_table
    spark = weighted.sparkSession
    tagged, path = sorted_table(weighted, [value], with_path=True)
    _, bounds = part_offsets(tagged, 0, weight)
    n = bounds[-1][2] if bounds else 0
    if n == 0:
        return [[None, None] for _ in fractions]
    cache: dict[int, object] = {}

    def at(k: int):
        if k in cache:
            return cache[k]
        for part, lo, hi in bounds:
            if lo <= k < hi:
                one = (spark.read.schema(weighted.schema).parquet(f"{path}/part-{part:05d}-*")
                       .select("*", F.col("_metadata.row_index").alias("_local")))
                w = Window.orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
                cum = one.withColumn("_cum", F.sum(weight).over(w) + F.lit(lo))
                cache[k] = cum.where((F.col("_cum") - F.col(weight) <= k) & (F.col("_cum") > k)).first()[value]
                return cache[k]
        raise IndexError(k)

    out = []
    for q in fractions:
        pos = q * (n - 1)
        lo_k, hi_k = int(pos // 1), int(-(-pos // 1))
        out.append([at(lo_k), at(hi_k)])
    return out


def exact_quantile(vals: DataFrame, v: str, q: float, limit: int = 200_000,
                   accuracy: int = 10_000, rounds: int = 8) -> tuple | None:
    """Values at the 0-based ranks floor(q*(n-1)) and ceil(q*(n-1)) of the
    (non-null, non-NaN) double column ``v``; None when it is empty.

    Exact selection without moving the rows: a ``percentile_approx`` sketch
    (bounded size, merged from partial aggregates) brackets the target ranks
    with a margin of twice its rank error; one counting pass checks that the
    bracket [lo, hi] holds them and how many values lie below it. The next
    round works inside the bracket only, so a round divides the candidates
    by about accuracy/4. Once at most ``limit`` values remain they are read
    and picked on the driver; when the bracket holds few distinct values
    (one value holding a third of the column) their (value, count) pairs
    are read instead. If no round makes progress the sort-based
    ``weighted_quantiles`` answers.
    """
    first = vals.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(v).alias("d")).first()
    n = int(first["n"])
    if n == 0:
        return None
    pos = q * (n - 1)
    ranks = (int(pos // 1), int(-(-pos // 1)))
    lo = hi = None
    below, inside, distinct = 0, n, int(first["d"])
    margin = 2.0 / accuracy
    sub = vals
    for _ in range(rounds):
        if inside <= limit:
            got = sorted(r[0] for r in sub.select(v).collect())
            return tuple(got[k - below] for k in ranks)
        if distinct <= limit // 2:
            pairs = sorted((r[0], int(r[1])) for r in sub.groupBy(v).agg(F.count(F.lit(1))).collect())
            out = []
            for k in ranks:
                end = below
                for val, cnt in pairs:
                    end += cnt
                    if k < end:
                        out.append(val)
                        break
            return tuple(out)
        f_lo = max(0.0, (ranks[0] - below) / inside - margin)
        f_hi = min(1.0, (ranks[1] - below) / inside + margin)
        b = sub.agg(F.percentile_approx(v, [f_lo, f_hi], accuracy).alias("b")).first()["b"]
        nlo, nhi = float(b[0]), float(b[1])
        cnt = vals.agg(F.count_if(F.col(v) < nlo).alias("below"),
                       F.count_if(F.col(v).between(nlo, nhi)).alias("inside"),
                       F.approx_count_distinct(F.when(F.col(v).between(nlo, nhi), F.col(v))).alias("d")).first()
        nb, ni = int(cnt["below"]), int(cnt["inside"])
        if not (nb <= ranks[0] and ranks[1] < nb + ni):
            margin *= 4          # the sketch missed: widen and try again
            continue
        if ni >= inside:
            break                # no progress
        lo, hi, below, inside, distinct = nlo, nhi, nb, ni, int(cnt["d"])
        sub = vals.where(F.col(v).between(lo, hi))
    weighted = vals.groupBy(v).agg(F.count(F.lit(1)).alias("_w"))
    a, b2 = weighted_quantiles(weighted, v, "_w", [q])[0]
    return a, b2


def median_value(df: DataFrame, c: str) -> float | None:
    """AG-06: exact interpolated median (pandas ``median``): the mean of the
    two middle values of the non-null numeric readings (``exact_quantile``:
    a few scans of the one column, no shuffle of its values)."""
    ensure_checkpoint_dir(df.sparkSession)
    dtype = df.schema[c].dataType
    d = as_double(c, dtype)
    vals = df.select(d.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    mid = exact_quantile(vals, "v", 0.5)
    if mid is None:
        return None
    return (float(mid[0]) + float(mid[1])) / 2.0


def fill_values(df: DataFrame, fills: dict[str, str], limit: int = 200_000, accuracy: int = 10_000) -> dict:
    """The fill statistic (``mean``, ``median`` or ``mode``) of every column
    in ``fills``, as few jobs as one column needs: one aggregate for all means
    and median sketches, one that counts inside all median brackets, one that
    groups the values of all brackets, one union of the modes. A median whose
    bracket holds more than ``limit`` values goes on alone (``median_value``).
    """
    out: dict = dict.fromkeys(fills)
    first: dict = {}
    number = {c: as_double(c, df.schema[c].dataType) for c, op in fills.items() if op in ("mean", "median")}
    number = {c: F.when(~F.isnan(d), d) for c, d in number.items()}
    medians = [c for c, op in fills.items() if op == "median"]
    if number:
        half, margin = 0.5, 2.0 / accuracy
        exprs = [F.avg(d).alias(f"m{i}") if fills[c] == "mean" else F.struct(
            F.count(d).alias("n"), F.percentile_approx(d, [half - margin, half + margin], accuracy).alias("b")).alias(f"m{i}")
            for i, (c, d) in enumerate(number.items())]
        row = df.agg(*exprs).first()
        first = {c: row[f"m{i}"] for i, c in enumerate(number)}
        out.update({c: None if first[c] is None else float(first[c]) for c in number if fills[c] == "mean"})
    medians = [c for c in medians if first[c]["n"]]
    if medians:
        inside = {c: number[c].between(*[F.lit(float(x)) for x in first[c]["b"]]) for c in medians}
        row = df.agg(*[F.struct(F.count_if(number[c] < F.lit(float(first[c]["b"][0]))).alias("below"),
                                F.count_if(inside[c]).alias("inside")).alias(f"c{i}") for i, c in enumerate(medians)]).first()
        counts = {c: row[f"c{i}"] for i, c in enumerate(medians)}
        ranks = {c: ((first[c]["n"] - 1) // 2, first[c]["n"] // 2) for c in medians}
        held = [c for c in medians if counts[c]["inside"] <= limit and counts[c]["below"] <= ranks[c][0]
                and ranks[c][1] < counts[c]["below"] + counts[c]["inside"]]
        if held:
            values = F.array(*[F.when(inside[c], F.struct(F.lit(i).alias("i"), number[c].alias("v"))) for i, c in enumerate(held)])
            pairs = df.select(F.explode(F.array_compact(values)).alias("p")).groupBy("p.i", "p.v").agg(F.count(F.lit(1)).alias("k"))
            ends = {c: counts[c]["below"] for c in held}
            picked: dict[str, list] = {c: [] for c in held}
            for r in sorted(pairs.collect(), key=lambda r: (r["i"], r["v"])):
                c = held[r["i"]]
                ends[c] += r["k"]
                picked[c] += [r["v"]] * sum(1 for k in ranks[c][len(picked[c]):] if k < ends[c])
            out.update({c: (float(a) + float(b)) / 2.0 for c, (a, b) in picked.items()})
        for c in medians:
            if c not in held:
                out[c] = median_value(df, c)
    modes = [c for c, op in fills.items() if op == "mode"]
    if modes:
        top = None
        for i, c in enumerate(modes):
            best = (df.where(F.col(f"`{c}`").isNotNull()).groupBy(F.col(f"`{c}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
                    .orderBy(F.desc("n"), F.asc("v")).limit(1))
            best = best.select(F.lit(i).alias("i"), *[F.col("v").alias(f"v{j}") if j == i else F.lit(None).cast(df.schema[x].dataType).alias(f"v{j}")
                                                      for j, x in enumerate(modes)])
            top = best if top is None else top.unionByName(best)
        out.update({modes[r["i"]]: r[f"v{r['i']}"] for r in top.collect()})
    return out


def mode_value(df: DataFrame, c: str):
    """AG-07: most frequent non-null value, smallest on a tie (D11); None when
    the column is all null. ``groupBy`` + top-1 keeps only one row per task."""
    row = (df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.desc("_n"), F.asc(c)).limit(1).first())
    return None if row is None else row[c]


def column_decisions(df: DataFrame, fractional_cols: list[str], vote_cols: list[str]) -> tuple[dict, dict]:
    """Batch of whole-column decisions in ONE aggregate job: for each column in
    ``fractional_cols`` whether a parsed value is fractional (D2), for each in
    ``vote_cols`` the winning date format (D4)."""
    exprs: list[Column] = []
    for i, c in enumerate(fractional_cols):
        exprs.append(fractional_flag(c, df.schema[c].dataType).alias(f"_frac{i}"))
    for i, c in enumerate(vote_cols):
        if isinstance(df.schema[c].dataType, T.StringType):
            exprs.extend(e.alias(f"_v{i}_{j}") for j, e in enumerate(format_vote_exprs(c)))
    if not exprs:
        return {}, {}
    row = df.agg(*exprs).first().asDict()
    fr = {c: bool(row[f"_frac{i}"]) for i, c in enumerate(fractional_cols)}
    votes = {}
    for i, c in enumerate(vote_cols):
        keys = sorted((k for k in row if k.startswith(f"_v{i}_")), key=lambda k: int(k.rsplit("_", 1)[1]))
        votes[c] = first_format_from_votes([row[k] for k in keys]) if keys else None
    return fr, votes


#: Values of a group that one window may hold when its median is picked, the
#: slices of a bracket that holds more, and the group rows that are broadcast.
BRACKET_VALUES, SLICES, GROUP_ROWS = 200_000, 1024, 100_000


def group_median(df: DataFrame, keys: list[str], value: str, name: str = "median", accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated median of ``value`` per group of ``keys``; null and
    NaN are no values, and a group without values has no row.

    Spark's ``median`` would keep a whole group in one buffer, a sort would
    move every row. Here a sketch brackets each group's middle (its rank error
    is below 1/``accuracy``), one pass counts what lies below and inside the
    brackets, and only the values inside are grouped and picked from. A
    bracket with more than ``BRACKET_VALUES`` values is cut in slices and
    narrowed to those with the middle ranks, so a hot group costs a further
    scan, not a task that holds it. The group rows, one a group, are joined with the values
    where these are read.
    """
    if not keys:
        raise ValueError("group_median needs grouping keys; use median_value for a global median")
    vals = df.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"`{value}`").cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    ks, margin = [f"_k{i}" for i in range(len(keys))], 2.0 / accuracy
    groups = stage_table(vals.groupBy(*ks).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], accuracy).alias("_q")).select(
        *ks, "_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi")), "medians")
    few = groups.count() <= GROUP_ROWS
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))

    def bracketed(state: DataFrame) -> DataFrame:
        side = state.select(*[F.col(k).alias(f"_g{k}") for k in ks], *[c for c in state.columns if c not in ks])
        side = F.broadcast(side) if few else side
        same = [F.col(k).eqNullSafe(F.col(f"_g{k}")) for k in ks]
        return vals.join(side, reduce(lambda a, b: a & b, same))

    while True:
        counted = stage_table(bracketed(groups).groupBy(*ks, "_n", "_lo", "_hi").agg(
            F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(inside).alias("_in")), "medians")
        wide = counted.where((F.col("_in") > BRACKET_VALUES) & (F.col("_lo") < F.col("_hi")))
        if wide.isEmpty():
            break
        # cut the bracket in SLICES; the slices with the middle ranks are the next one
        width = F.col("_hi") - F.col("_lo")
        cut = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.when(width > 0, width) * SLICES), F.lit(SLICES - 1))
        slices = bracketed(counted).where(inside).groupBy(*ks, "_n", "_lo", "_hi", "_below", F.coalesce(cut, F.lit(0)).alias("_s")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        upto = F.col("_below") + F.sum("_c").over(W.partitionBy(*ks).orderBy("_s").rowsBetween(W.unboundedPreceding, W.currentRow))
        holds = (F.col("_up") > F.floor((F.col("_n") - 1) / 2)) & (F.col("_up") - F.col("_c") <= F.floor(F.col("_n") / 2))
        moved = stage_table(slices.withColumn("_up", upto).where(holds).groupBy(*ks, "_n", "_lo", "_hi").agg(
            F.min("_from").alias("_nlo"), F.max("_to").alias("_nhi")), "medians")
        stuck = moved.where((F.col("_nlo") > F.col("_lo")) | (F.col("_nhi") < F.col("_hi"))).isEmpty()
        groups = moved.select(*ks, "_n", F.col("_nlo").alias("_lo"), F.col("_nhi").alias("_hi"))
        if stuck:
            break
    found = bracketed(counted).where(inside).groupBy(*ks, "_n", "_below", "_v").agg(F.count(F.lit(1)).alias("_c"))
    runs = found.groupBy(*ks, "_n", "_below").agg(F.sort_array(F.collect_list(F.struct("_v", "_c"))).alias("_runs"))
    ranks = [F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)]

    def add(acc, run):
        end = acc["end"] + run["_c"]
        hits = sum(((r >= acc["end"]) & (r < end)).cast("int") for r in ranks)
        return F.struct(end.alias("end"), (acc["total"] + F.when(hits > 0, run["_v"] * hits).otherwise(0.0)).alias("total"))
    total = F.aggregate("_runs", F.struct(F.col("_below").alias("end"), F.lit(0.0).alias("total")), add, lambda acc: acc["total"])
    return runs.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], (total / 2).alias(name))
