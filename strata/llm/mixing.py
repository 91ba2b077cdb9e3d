"""Mixing sources to target weights: capped water-filling.

Each source's share of the corpus is its weight over all weights. A source
may be repeated at most ``max_epochs`` times, so a target above that cap is
clamped and the excess is shared again among the others by weight, until no
target is above its cap. Documents then take whole repetitions plus a seeded
fraction of one more: a prefix by seeded rank, a few documents that fill what
is left, and further prefixes over the documents that still fit, until no
document of a source fits what is left of its target. All steps are DataFrame
operations.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; an empty table gives an empty result; rows that agree in
doc_id and text are taken together (ties share one seeded rank), so reruns
and row order never change the result; extra columns pass through ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.keys import positions
from ..session import stage_table
from .common import WORD, sized, whole_row

SEED = 20240607
#: Seeded ranks have 60 bits; their top bits make the buckets whose sizes
#: are summed first, so that only one bucket a source is looked at by row.
RANK_BITS, BUCKET_BITS = 60, 12
#: Documents that a source adds to its seeded fraction, largest first, before
#: further prefixes take all others that fit.
FILLS = 4


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_rank(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    """60 bits of md5 over seed, id and text."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                   F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, RANK_BITS // 4), 16, 10).cast("long")


def _prefix(groups: DataFrame, rests: DataFrame, n: int, all_fit: bool = False) -> DataFrame:
    """(_es, _cut, _got): the last rank up to which the groups of a source fit
    its ``_rest``, and their words. A source whose groups all fit has a row
    only with ``all_fit``."""
    shift = RANK_BITS - BUCKET_BITS
    buckets = groups.groupBy("_source", F.shiftright("_rank", shift).alias("_b")).agg(F.sum("_g").alias("_bs"))
    order = W.partitionBy("_source").orderBy("_b")
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    buckets = buckets.withColumn("_before", F.sum("_bs").over(run) - F.col("_bs"))
    over = F.col("_before") + F.col("_bs") > F.col("_rest")
    if all_fit:
        buckets = buckets.withColumn("_last", F.lead("_b").over(order).isNull())
        over = over | F.col("_last")
    buckets, small = buckets.alias("k"), sized(rests.select("_source", "_rest"), n).alias("p")
    edge = (buckets.join(small, F.col("k._source").eqNullSafe(F.col("p._source")))
            .where((F.col("_before") <= F.col("_rest")) & over)
            .select(F.col("k._source").alias("_es"), "_b", "_before", "_rest"))
    edge = sized(stage_table(edge, "mix-edges"), n)
    run = W.partitionBy("_source").orderBy("_rank").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = (groups.join(edge, F.col("_source").eqNullSafe(F.col("_es")) & (F.shiftright("_rank", shift) == F.col("_b")))
              .withColumn("_upto", F.col("_before") + F.sum("_g").over(run)))
    fits = F.col("_upto") <= F.col("_rest")
    return inside.groupBy("_es", "_b", "_before").agg(
        F.max(F.when(fits, F.col("_rank"))).alias("_in"), F.max(F.when(fits, F.col("_upto"))).alias("_got")).select(
        "_es", F.coalesce("_in", F.shiftleft("_b", shift) - 1).alias("_cut"), F.coalesce("_got", "_before").alias("_got"))


def _once_more(rank: str, size: str) -> Column:
    """Does a rank with so many words take one repetition more?"""
    later = F.exists("_rounds", lambda r: (F.col(size) <= r["limit"]) & (F.col(rank) <= r["cut"]))
    return (F.col(rank) <= F.col("_cut")) | F.array_contains("_more", F.col(rank)) | later


def _fill_rounds(groups: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """Prefixes over the documents of at most half of what is left, then of
    all of it, in turns until none fits: two turns halve what is left."""
    half = False
    while n:
        limit = F.floor(F.col("_left") / (2 if half else 1)).cast("long")
        p = sized(plan, n).select(F.col("_source").alias("_ps"), "_cut", "_more", "_rounds", limit.alias("_limit"))
        fit = stage_table(groups.join(p, F.col("_source").eqNullSafe(F.col("_ps")))
                          .where((F.col("_g") > 0) & (F.col("_g") <= F.col("_limit")) & ~_once_more("_rank", "_g"))
                          .select("_source", "_rank", "_g"), "mix-fitting")
        if not fit.isEmpty():
            cuts = _prefix(fit, plan.withColumnRenamed("_left", "_rest"), n, all_fit=True).withColumnRenamed("_cut", "_to")
            new = F.array(F.struct(limit.alias("limit"), F.col("_to").alias("cut")))
            plan = stage_table(plan.join(sized(cuts, n), F.col("_source").eqNullSafe(F.col("_es")), "left").select(
                "_source", "_total", "_target", "_whole", "_cut", (F.col("_left") - F.coalesce("_got", F.lit(0))).alias("_left"), "_more",
                F.when(F.col("_es").isNull() & F.col("_got").isNull(), F.col("_rounds")).otherwise(F.concat("_rounds", new)).alias("_rounds")), "mix-plan")
        elif not half:
            break
        half = not half
    return plan


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> tuple[DataFrame, int]:
    """(_source, _total, _target, _whole, _cut, _left, _more, _rounds) and its row count.
    ``sizes`` is a written table with _source, _size, _rank. A document takes
    ``_whole`` repetitions, and one more if its seeded rank is at most ``_cut``,
    among ``_more``, or at most the cut of a round whose limit its words (those
    of all rows of its rank) keep; ``_left`` words of the target stay open."""
    totals = sizes.groupBy("_source").agg(F.sum("_size").alias("_total"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_pos") % len(weights) + 1).cast("int"))
    src = positions(totals, [F.col("_source").asc_nulls_last()]).withColumn("_w", weight).withColumn(
        "_cap", F.col("_total") * F.lit(float(max_epochs)))
    src = stage_table(src, "mix-sources")
    n, everything, level = src.agg(F.count(F.lit(1)), F.sum("_total"), F.sum("_w")).first()
    level = everything / level if n else 0.0
    while n:  # the level only rises, and each round clamps another source or ends
        clamped, free = src.agg(
            F.sum(F.when(F.col("_w") * F.lit(level) >= F.col("_cap"), F.col("_cap"))),
            F.sum(F.when(F.col("_w") * F.lit(level) < F.col("_cap"), F.col("_w")))).first()
        risen = (everything - (clamped or 0.0)) / free if free else level
        if risen <= level:
            break
        level = risen
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(float(level)))
    src = src.select("_source", "_total", target.alias("_target")).withColumn(
        "_whole", F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(0).cast("long")
    ).withColumn("_rest", F.col("_target") - F.col("_whole") * F.col("_total"))

    # the fraction: documents by seeded rank while their words fit the rest;
    # first by buckets of ranks, then by rank in the one bucket of the edge
    groups = stage_table(sizes.groupBy("_source", "_rank").agg(F.sum("_size").alias("_g")), "mix-ranks")
    cuts = _prefix(groups, src, n)
    plan = stage_table(src.join(sized(cuts, n), F.col("_source").eqNullSafe(F.col("_es")), "left").select(
        "_source", "_total", "_target", "_whole", F.coalesce("_cut", F.lit(-1)).alias("_cut"),
        (F.col("_rest") - F.coalesce("_got", F.lit(0))).alias("_left"),
        F.array().cast("array<long>").alias("_more")), "mix-plan")
    for _ in range(FILLS):  # what is left is filled by the largest document that fits
        p = sized(plan, n).select(F.col("_source").alias("_ps"), "_cut", "_left", "_more")
        best = (groups.join(p, F.col("_source").eqNullSafe(F.col("_ps")))
                .where((F.col("_rank") > F.col("_cut")) & (F.col("_g") > 0) & (F.col("_g") <= F.col("_left"))
                       & ~F.array_contains("_more", F.col("_rank")))
                .groupBy(F.col("_source").alias("_fs")).agg(F.max(F.struct("_g", "_rank")).alias("_f")))
        plan = stage_table(plan.join(sized(best, n), F.col("_source").eqNullSafe(F.col("_fs")), "left").select(
            "_source", "_total", "_target", "_whole", "_cut",
            (F.col("_left") - F.coalesce("_f._g", F.lit(0))).alias("_left"),
            F.when(F.col("_f").isNull(), F.col("_more")).otherwise(F.array_append("_more", F.col("_f._rank"))).alias("_more")), "mix-plan")
    plan = plan.withColumn("_rounds", F.array().cast("array<struct<limit:bigint,cut:bigint>>"))
    return _fill_rounds(groups, plan, n), n


def _repeated(rows: DataFrame, sizes: DataFrame, plan: DataFrame, n: int, source: str, rank: str, size: Column) -> DataFrame:
    """``rows`` with the plan of their source and ``_copies``, their repetitions. Rounds
    limit the words of all rows of a rank; a rank that its single rows would
    pass and all of them together do not is looked up (usually few or none)."""
    p = sized(plan, n)
    rows = rows.join(p, F.col(source).eqNullSafe(p["_source"]))
    if plan.where(F.size("_rounds") > 0).isEmpty():
        more = (F.col(rank) <= F.col("_cut")) | F.array_contains("_more", F.col(rank))
        return rows.withColumn("_copies", F.col("_whole") + more.cast("long"))
    groups = sizes.groupBy(F.col("_source").alias("_xs"), F.col("_rank").alias("_xr")).agg(
        F.max("_size").alias("_one"), F.sum("_size").alias("_all"))
    both = groups.join(p, F.col("_xs").eqNullSafe(p["_source"]))
    held = stage_table(both.where(_once_more("_xr", "_one") & ~_once_more("_xr", "_all")).select("_xs", "_xr"), "mix-held")
    rows = rows.withColumn("_words", size).join(sized(held, held.count()), F.col(source).eqNullSafe(F.col("_xs")) & (F.col(rank) == F.col("_xr")), "left")
    more = _once_more(rank, "_words") & F.col("_xr").isNull()
    return rows.withColumn("_copies", F.col("_whole") + more.cast("long"))


def _measured(docs: DataFrame, keep: list[Column], seed: int) -> DataFrame:
    return docs.select(*keep, F.col("source").alias("_source"), words(F.col("text")).alias("_size"),
                       seeded_rank(F.col("doc_id"), F.col("text"), seed).alias("_rank"))


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = stage_table(_measured(docs, [F.col("doc_id").alias("_id")], seed), "mix-sizes")
    plan, n = source_plan(sizes, weights, max_epochs)
    rows = sizes.select("_id", F.col("_source").alias("_s"), "_size", F.col("_rank").alias("_r"))
    return _repeated(rows, sizes, plan, n, "_s", "_r", F.col("_size")).select(
        F.col("_id").alias("doc_id"), F.col("_s").alias("source"), F.col("_size").alias("size"),
        F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"),
        (F.col("_size") * F.col("_copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` as often as the mix takes it.
    Only sizes are shuffled; texts meet the plan of their source (one row a
    source) where they are read."""
    sizes = stage_table(_measured(docs, [], seed), "mix-sizes")
    plan, n = source_plan(sizes, weights, max_epochs)
    rows = docs.select(whole_row(docs.columns).alias("_row"), F.col("source").alias("_s"),
                       seeded_rank(F.col("doc_id"), F.col("text"), seed).alias("_r"))
    text = F.col("_row").getField("text")
    rows = _repeated(rows, sizes, plan, n, "_s", "_r", words(text)).where(F.col("_copies") > 0)
    return rows.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_row.*")


def _oracle_fills() -> str:
    """The SQL of the fills: each step has the ranks g taken so far."""
    steps = []
    for i in range(FILLS):
        steps.append(f"""
b{i} AS (SELECT source, max(struct_pack(g := g, rnk := rnk)) AS f FROM f{i} WHERE NOT taken AND g > 0 AND g <= open GROUP BY source),
f{i + 1} AS (SELECT f{i}.source, f{i}.rnk, f{i}.g, taken OR coalesce(f{i}.rnk = f.rnk, false) AS taken, open - coalesce(f.g, 0) AS open
  FROM f{i} LEFT JOIN b{i} ON f{i}.source IS NOT DISTINCT FROM b{i}.source)""")
    return ",".join(steps)


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS rnk
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0 * total AS cap, 3.0 * total / w AS ratio FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
             sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r),
l AS (SELECT arg_min(((SELECT sum(total) FROM s) - capped) / free, (ratio, coalesce(source, ''))) AS lev FROM c
      WHERE ((SELECT sum(total) FROM s) - capped) / free <= ratio),
t AS (SELECT source, total, least(cap, w * lev)::DOUBLE AS target FROM r, l),
p AS (SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT source, rnk, sum(size)::BIGINT AS g FROM d GROUP BY source, rnk),
u AS (SELECT g.source, rnk, g, target - whole * total AS rest, sum(g) OVER (PARTITION BY g.source ORDER BY rnk) AS upto
      FROM g JOIN p ON g.source IS NOT DISTINCT FROM p.source),
f0 AS (SELECT source, rnk, g, upto <= rest AS taken,
         rest - coalesce(max(upto) FILTER (upto <= rest) OVER (PARTITION BY source), 0) AS open FROM u),{_oracle_fills()}
SELECT d.doc_id, d.size::BIGINT AS size, p.total::BIGINT AS source_size, round(p.target, 3) AS target,
       (d.size * (p.whole + x.taken::BIGINT))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
       JOIN f{FILLS} x ON d.source IS NOT DISTINCT FROM x.source AND d.rnk = x.rnk
"""
