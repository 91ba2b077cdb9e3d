"""Join keys found by content (JN-04): which columns hold values of which keys.

1. **Sketch.** One aggregate a table, all tables in one job: for every
   candidate column a theta sketch of its distinct values, the number of
   non-null values, and the smallest and largest value (of whole-number
   columns). Sketches are mergeable: partial aggregates, files and runs can be
   united later (``merge_sketches``) without reading the values again.
2. **Prune.** Pairs are formed from the sketch rows (one a column). A pair is
   dropped only where its sketches show, five standard errors clear, that the
   right column repeats its values or that too few of the left values occur
   in it. Where the sketches hold too little to tell, the pair stays.
3. **Confirm.** The values of all remaining columns are reduced to distinct
   (column, value) rows and grouped by value once; each value adds to every
   remaining pair whose two columns hold it. So the result is exact, and the
   number of jobs does not depend on the number of pairs.

Values are compared as text, so an integer key meets the same key stored as
a long or a string.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import is_string
from .keys import ORDINAL_COLUMNS

#: 2 ** 12 entries a sketch: at most 32 KB a column.
SKETCH_LG = 12
#: Standard errors that a sketch must be clear of a limit to drop a pair.
CLEAR = 5.0
SKETCHES = ("dataset string, dataset_no int, column string, family string, values long, lowest decimal(38,0), "
            "highest decimal(38,0), sketch binary")
PAIRS = ("left_dataset string, left_column string, right_dataset string, right_column string, left_keys long, "
         "right_keys long, matched_keys long, confidence string")


def is_whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) or (
        isinstance(dtype, T.DecimalType) and dtype.scale == 0)


def key_columns(df: DataFrame, texts: bool = True) -> list[str]:
    """Columns that can hold keys: whole numbers and, with ``texts``, strings."""
    return [f.name for f in df.schema.fields if f.name not in ORDINAL_COLUMNS
            and (is_whole(f.dataType) or (texts and is_string(f.dataType)))]


def as_key(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


def sketch_columns(tables: Mapping[str, DataFrame], texts: bool = True) -> DataFrame:
    """One row per candidate column with its sketch; one job, one scan a table."""
    parts = []
    for no, (name, df) in enumerate(tables.items()):
        cols = key_columns(df, texts)
        if not cols:
            continue
        entries = []
        for c in cols:
            whole = is_whole(df.schema[c].dataType)
            number = F.col(f"`{c}`").cast("decimal(38,0)") if whole else F.lit(None).cast("decimal(38,0)")
            entries.append(F.struct(
                F.lit(c).alias("column"), F.lit("whole" if whole else "text").alias("family"),
                F.count(F.col(f"`{c}`")).alias("values"), F.min(number).alias("lowest"), F.max(number).alias("highest"),
                F.theta_sketch_agg(as_key(c), SKETCH_LG).alias("sketch")))
        row = df.agg(F.array(*entries).alias("e"))
        parts.append(row.select(F.lit(name).alias("dataset"), F.lit(no).alias("dataset_no"), F.explode("e").alias("e"))
                     .select("dataset", "dataset_no", "e.*"))
    if not parts:
        return next(iter(tables.values())).sparkSession.createDataFrame([], SKETCHES)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_sketches(*frames: DataFrame) -> DataFrame:
    """Sketch rows of several parts of the same tables (files, days, runs) as
    those of the whole tables."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy("dataset", "dataset_no", "column", "family").agg(
        F.sum("values").alias("values"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.theta_union_agg("sketch", SKETCH_LG).alias("sketch"))


def candidate_pairs(sketches: DataFrame, min_share: float) -> DataFrame:
    """(left, right) columns that the sketches don't rule out, with the
    estimates. The frame has one row a column, so the join of its rows is
    bounded by the schemas; equal families only, but a text may hold the
    whole numbers of another table."""
    sides = sketches.where("values > 0").withColumn("distinct", F.theta_sketch_estimate("sketch"))
    left = sides.select(*[F.col(c).alias(f"l_{c}") for c in sides.columns])
    right = sides.select(*[F.col(c).alias(f"r_{c}") for c in sides.columns])
    error = F.lit(CLEAR / 2 ** (SKETCH_LG / 2))
    # a key: no value repeats
    unique = F.col("r_distinct") * (1 + error) >= F.col("r_values")
    enough = F.col("r_distinct") * (1 + 2 * error) >= F.col("l_distinct") * min_share
    both = F.theta_sketch_estimate(F.theta_intersection("l_sketch", "r_sketch"))
    # entries of the left column that the intersection can have sampled
    sampled = F.col("l_distinct") * F.least(F.lit(1.0), F.lit(2.0 ** SKETCH_LG) / F.greatest("l_distinct", "r_distinct"))
    share = both / F.col("l_distinct")
    shows_too_few = share + CLEAR * F.sqrt(F.lit(0.25) / F.greatest(sampled, F.lit(1.0))) < min_share
    # numbers outside the right column's range can't be among its values
    apart = (F.col("l_family") == "whole") & (F.col("r_family") == "whole") & (
        (F.col("l_highest") < F.col("r_lowest")) | (F.col("l_lowest") > F.col("r_highest")))
    return (_paired(left, right.where(unique)).where((F.col("l_dataset") != F.col("r_dataset")) & enough & ~apart)
            .where(~shows_too_few)
            .select("l_dataset", "l_column", "r_dataset", "r_column"))


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with the array of the right rows: the rows are columns
    of tables, so the array is bounded by the schemas."""
    names = right.columns
    return (left.withColumn("_one", F.lit(1))
            .join(F.broadcast(right.agg(F.collect_list(F.struct(*names)).alias("_all")).withColumn("_one", F.lit(1))), "_one")
            .select(*left.columns, F.explode("_all").alias("_r")).select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in names]))


def stem(name: Column) -> Column:
    """A column's name without the short prefix of its table (``o_orderkey``)."""
    return F.regexp_replace(F.lower(name), "^[a-z]{1,3}_(?=[a-z0-9]{3,})", "")


def find_join_keys(tables: Mapping[str, DataFrame], min_share: float = 0.9, texts: bool = True,
                   sketches: DataFrame | None = None) -> DataFrame:
    """Pairs (left column, right column of another table) where the right one
    is a key (no value repeats, nulls aside) and at least ``min_share`` of the
    left one's distinct values occur in it: the exact numbers of distinct left
    and right values and of the matched ones. ``confidence`` is ``high`` where
    the names agree too, ``medium`` where at least half of the right values are
    used, else ``low`` (small numbers lie inside any numbered key).
    ``sketches`` saves the first scan where they are already there."""
    spark = next(iter(tables.values())).sparkSession
    found = sketches if sketches is not None else sketch_columns(tables, texts)
    kept = found.select("dataset", "column", "values").collect()
    pairs = [tuple(r) for r in candidate_pairs(found, min_share).collect()]
    if not pairs:
        return spark.createDataFrame([], PAIRS)
    number = {c: i for i, c in enumerate(sorted({p[:2] for p in pairs} | {p[2:] for p in pairs}))}
    size = {(r[0], r[1]): r[2] for r in kept}
    rows = None
    for name, df in tables.items():
        cols = [c for t, c in number if t == name]
        if cols:
            part = df.select(F.explode(F.array(*[F.struct(F.lit(number[name, c]).alias("c"), as_key(c).alias("v")) for c in cols]))
                             .alias("e")).select("e.c", "e.v").where("v IS NOT NULL")
            rows = part if rows is None else rows.union(part)
    # a value meets the numbers of its columns: one shuffle, hot values are one row a column and task
    holders = rows.distinct().groupBy("v").agg(F.collect_set("c").alias("held"))
    wanted = F.array(*[F.struct(F.lit(number[p[:2]]).alias("l"), F.lit(number[p[2:]]).alias("r")) for p in pairs])
    pair_counts = holders.select(F.explode(F.concat(
        F.transform("held", lambda c: F.struct(c.alias("l"), F.lit(-1).alias("r"))),
        F.filter(wanted, lambda p: F.array_contains("held", p["l"]) & F.array_contains("held", p["r"])))).alias("p")) \
        .groupBy("p.l", "p.r").agg(F.count(F.lit(1)).alias("n"))
    counted = {(r[0], r[1]): r[2] for r in pair_counts.collect()}
    out = []
    for p in pairs:
        left, right = number[p[:2]], number[p[2:]]
        keys, unique, matched = counted.get((left, -1), 0), counted.get((right, -1), 0), counted.get((left, right), 0)
        if keys and matched >= min_share * keys and unique == size[p[2:]]:
            out.append((*p, keys, unique, matched))
    result = spark.createDataFrame(out, ", ".join(PAIRS.split(", ")[:-1]))
    same = stem(F.col("left_column")) == stem(F.col("right_column"))
    used = F.col("matched_keys") * 2 >= F.col("right_keys")
    return result.withColumn("confidence", F.when(same, "high").when(used, "medium").otherwise("low"))


def join_keys_sql(tables: Mapping[str, list[str]], min_share: float = 0.9) -> str:
    """The same result in SQL, from all pairs of the given columns."""
    values = "\nUNION ALL ".join(f"SELECT '{t}' AS d, '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {t}" for t, cs in tables.items() for c in cs)
    name = "regexp_replace(lower({0}), '^[a-z]{{1,3}}_([a-z0-9]{{3,}})', '\\1')"
    return f"""
WITH a AS ({values}),
s AS (SELECT d, c, count(v) AS n, count(DISTINCT v) AS k FROM a GROUP BY d, c),
u AS (SELECT DISTINCT d, c, v FROM a WHERE v IS NOT NULL),
m AS (SELECT l.d AS ld, l.c AS lc, r.d AS rd, r.c AS rc, count(*) AS matched FROM u l JOIN u r ON l.v = r.v AND l.d <> r.d
      GROUP BY ALL)
SELECT ld AS left_dataset, lc AS left_column, rd AS right_dataset, rc AS right_column, x.k AS left_keys, y.k AS right_keys,
       matched AS matched_keys, CASE WHEN {name.format('lc')} = {name.format('rc')} THEN 'high'
       WHEN matched * 2 >= y.k THEN 'medium' ELSE 'low' END AS confidence
FROM m JOIN s x ON x.d = ld AND x.c = lc JOIN s y ON y.d = rd AND y.c = rc
WHERE matched >= {min_share} * x.k AND y.k = y.n
"""
