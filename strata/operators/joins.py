"""Joins of the gold layer (JN-01..JN-04, SO-01, D8, D28).

The null-safe full outer join is written as

    left LEFT OUTER JOIN right              (every left row, matched or not)
    UNION ALL
    right LEFT ANTI JOIN distinct(left keys) (right rows nobody matched)

Both halves are equi-joins Spark can plan as sort-merge or (when the
runtime size allows) broadcast joins, and both are join types AQE can split
when a key is skewed; a plain FULL OUTER join is neither broadcastable nor
skew-split. The distinct left keys are map-side combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

#: Rows with a null key, which all share one key, are spread over at most this
#: many salts; the other side's null-key rows are repeated once a salt.
NULL_SALTS = 32
#: The pairs of rows without a key are dealt to tasks of at most so many
#: pairs, and of at least so many while there are few tasks. A step with fewer
#: pairs joins these rows with the others. Range joins deal theirs alike.
MOST_NULL_PAIRS, LEAST_NULL_PAIRS = 1 << 25, 1 << 18
#: Where both sides of such pairs are dealt, a task has at most so many.
MOST_CELL_PAIRS = 1 << 23

METADATA_COLUMNS = {"_load_timestamp", "_source_file", "_row_inserted", "_row_updated"}


def is_id_like(name: str, allow_prefix: bool = True) -> bool:
    """PR-10: ``id``, ``*_id`` and (unless disabled) ``id_*``."""
    n = str(name).lower()
    return n == "id" or n.endswith("_id") or (allow_prefix and n.startswith("id_"))


def shared_id_keys(left_cols: Sequence[str], right_cols: Sequence[str]) -> list[str]:
    """SO-04: shared columns named ``id`` or ``*_id`` that are not lineage columns."""
    rset = set(right_cols)
    return [c for c in left_cols if c in rset and is_id_like(c, allow_prefix=False)
            and c not in METADATA_COLUMNS]


def full_outer(left: DataFrame, right: DataFrame, keys: Sequence[str],
               null_keys_match: bool = True, how: str = "full_outer", no_key: tuple[int, int] | None = None) -> DataFrame:
    """JN-01/JN-02: outer join on ``keys`` with one (coalesced) key column per
    key; non-key columns present on both sides come from the left (D28).

    ``null_keys_match`` makes null keys equal (pandas ``merge``, D8): n and m
    rows without a key give n * m rows, see ``null_key_warnings``. Their
    pairs are made by as many tasks as they need (``null_tasks``); ``no_key``
    is (n, m) where it is known, else one job counts them.
    ``how`` may also be ``inner``, ``left`` or ``right``.
    """
    keys = list(keys)
    if null_keys_match and how == "full_outer":
        return _full_outer_null_safe(left, right, keys, no_key or tuple(rows_without_key([(left, keys), (right, keys)])))[0]
    lcols = list(left.columns)
    rpay = [c for c in right.columns if c not in keys and c not in lcols]
    r = right.select(*[F.col(k).alias(f"_rk{i}") for i, k in enumerate(keys)], *rpay)

    def cond(l_df, r_df, prefix="_rk"):
        parts = []
        for i, k in enumerate(keys):
            lk, rk = l_df[k], r_df[f"{prefix}{i}"]
            parts.append(lk.eqNullSafe(rk) if null_keys_match else lk == rk)
        c = parts[0]
        for p in parts[1:]:
            c = c & p
        return c

    if how in ("inner", "left"):
        j = left.join(r, cond(left, r), how)
        return j.select(*lcols, *rpay)
    if how == "right":
        j = r.join(left, cond(left, r), "left")
        return j.select(*[F.col(f"_rk{i}").alias(k) if k in keys else F.col(k)
                          for i, k in enumerate(keys)] + [c for c in lcols if c not in keys], *rpay) \
            .select(*lcols, *rpay)
    matched = left.join(r, cond(left, r), "left").select(*lcols, *rpay)
    lkeys = left.select(*[F.col(k).alias(f"_lk{i}") for i, k in enumerate(keys)]).distinct()
    anti_parts = []
    for i, k in enumerate(keys):
        lk, rk = lkeys[f"_lk{i}"], r[f"_rk{i}"]
        anti_parts.append(rk == lk)
    ac = anti_parts[0]
    for p in anti_parts[1:]:
        ac = ac & p
    only_right = r.join(lkeys, ac, "left_anti")
    key_pos = {k: i for i, k in enumerate(keys)}
    only_right = only_right.select(
        *[F.col(f"_rk{key_pos[c]}").alias(c) if c in key_pos else F.lit(None).cast(left.schema[c].dataType).alias(c)
          for c in lcols],
        *rpay)
    return matched.unionByName(only_right)


def null_tasks(n: int, m: int, parallelism: int) -> int:
    """How many tasks make the n * m pairs of rows without a key. Each takes
    some of the n rows and all m others, so those are repeated once a task."""
    return max(1, min(n, pair_tasks(n * m, parallelism)))


def pair_tasks(pairs: int, parallelism: int) -> int:
    """How many tasks make so many pairs; 0 or 1 where they need no dealing."""
    return max(-(-pairs // MOST_NULL_PAIRS), min(4 * parallelism, pairs // LEAST_NULL_PAIRS))


@dataclass
class NullPairs:
    """The pairs of a join's rows without a key, before they are made: each of
    the n rows of ``left`` with each of the m rows of ``right``. ``rest`` has
    the join's other rows."""
    left: DataFrame
    right: DataFrame
    rest: DataFrame
    counts: tuple[int, int]

    def changed(self, fn) -> NullPairs:
        """The pairs of a table whose columns ``fn`` renames or leaves out."""
        return NullPairs(fn(self.left), fn(self.right), fn(self.rest), self.counts)

    def made(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """Each row of ``left`` with each of ``right``, which are this frame's
        sides with other columns. Both are dealt, so a task's rows of either
        side are about as many as the root of its pairs."""
        a, b = pair_sides(*self.counts, left.sparkSession.sparkContext.defaultParallelism)

        def share(of):
            return F.pmod(F.monotonically_increasing_id(), F.lit(of))

        def every(of):
            return F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
        # partitions are asked for by number, as few bytes give many pairs
        few = left.withColumn("_a", share(a)).withColumn("_b", every(b)).withColumn("_lc", F.col("_a") * b + F.col("_b"))
        many = right.withColumn("_b", share(b)).withColumn("_a", every(a)).withColumn("_rc", F.col("_a") * b + F.col("_b"))
        few, many = (df.drop("_a", "_b").repartition(a * b, cell) for df, cell in ((few, "_lc"), (many, "_rc")))
        return few.join(many.hint("shuffle_hash"), F.col("_lc") == F.col("_rc")).drop("_lc", "_rc")


def pair_sides(n: int, m: int, parallelism: int) -> tuple[int, int]:
    """Into how many shares n and m rows are dealt, each share of one side
    meeting each of the other: shares of about as many rows on both sides."""
    tasks = max(1, -(-n * m // MOST_CELL_PAIRS), min(16 * parallelism, n * m // LEAST_NULL_PAIRS))
    a = max(1, min(n, tasks, isqrt(tasks * n // max(m, 1))))
    return a, max(1, min(m, -(-tasks // a)))


def _full_outer_null_safe(left: DataFrame, right: DataFrame, keys: list[str], counted: tuple[int, int]) -> tuple[DataFrame, NullPairs | None]:
    """The full outer join with equal null keys. ``counted``: how many rows of
    each side lack a key, which settles the number of tasks alone; where
    these rows have many pairs, they are joined apart from the others. With
    one key their pairs are also returned as they are before they are made."""
    lcols = list(left.columns)
    rpay = [c for c in right.columns if c not in keys and c not in lcols]
    n = len(keys)

    def no_key(names):
        out = F.col(names[0]).isNull()
        for c in names[1:]:
            out = out | F.col(c).isNull()
        return out
    def spread(salts):
        return F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")

    def every(salts):
        return F.sequence(F.lit(0), F.lit(salts - 1))
    one = F.array(F.lit(0))

    def equal(a, b):
        out = F.col(f"{a}s") == F.col(f"{b}s")
        for i in range(n):
            out = out & F.col(f"{a}{i}").eqNullSafe(F.col(f"{b}{i}"))
        return out
    lk, rk, dk = ([f"{p}{i}" for i in range(n)] for p in ("_l", "_r", "_d"))
    left_k = left.select("*", *[F.col(f"`{k}`").alias(x) for k, x in zip(keys, lk)])
    right_k = right.select(*[F.col(f"`{k}`").alias(x) for k, x in zip(keys, rk)], *[F.col(f"`{c}`") for c in rpay])

    def pairs(left_s, right_s, cond):
        return left_s.join(right_s, cond, "left").select(*[F.col(f"`{c}`") for c in (*lcols, *rpay)])
    tasks = null_tasks(*counted, left.sparkSession.sparkContext.defaultParallelism)
    if tasks == 1:
        salts = max(1, min(NULL_SALTS, counted[0]))
        matched = pairs(left_k.withColumn("_ls", F.when(no_key(lk), spread(salts)).otherwise(0)),
                        right_k.withColumn("_rs", F.explode(F.when(no_key(rk), every(salts)).otherwise(one))), equal("_l", "_r"))
    else:
        # partitions are asked for by number, so that neither few bytes nor a
        # broadcast brings the pairs into few tasks; one key is null in all
        # these rows, so the salts alone make the pairs
        few = left_k.where(no_key(lk)).withColumn("_ls", spread(tasks)).repartition(tasks, "_ls")
        others = right_k.where(no_key(rk)).withColumn("_rs", F.explode(every(tasks))).repartition(tasks, "_rs")
        keyed = [F.col(a) == F.col(b) for a, b in zip(lk, rk)]
        matched = pairs(left_k.where(~no_key(lk)), right_k.where(~no_key(rk)), keyed).unionByName(
            pairs(few, others, F.col("_ls") == F.col("_rs") if n == 1 else equal("_l", "_r")))
    # right rows without a partner: the distinct left keys are few, so here
    # those without a key are the repeated side
    keys_s = (left.select(*[F.col(f"`{k}`").alias(x) for k, x in zip(keys, dk)]).distinct()
              .withColumn("_ds", F.explode(F.when(no_key(dk), every(NULL_SALTS)).otherwise(one))))
    alone = right_k.withColumn("_rs", F.when(no_key(rk), spread(NULL_SALTS)).otherwise(0)).join(keys_s, equal("_r", "_d"), "left_anti")
    at = dict(zip(keys, rk))
    alone = alone.select(*[F.col(at[c]).alias(c) if c in at else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in lcols],
                         *[F.col(f"`{c}`") for c in rpay])
    if tasks == 1 or n > 1:
        return matched.unionByName(alone), None
    rest = pairs(left_k.where(~no_key(lk)), right_k.where(~no_key(rk)), keyed).unionByName(alone)
    apart = NullPairs(left_k.where(no_key(lk)).select(*[F.col(f"`{c}`") for c in lcols]),
                      right_k.where(no_key(rk)).select(*[F.col(f"`{c}`") for c in rpay]), rest, counted)
    return matched.unionByName(alone), apart


def _no_key(keys: Sequence[str]):
    out = F.col(f"`{keys[0]}`").isNull()
    for k in keys[1:]:
        out = out | F.col(f"`{k}`").isNull()
    return out


def fold_keys(frames: Sequence[DataFrame]) -> list[list[str]]:
    """The keys of each step of the fold: id-like columns that a source shares
    with any source before it."""
    known, steps = list(frames[0].columns), []
    for df in frames[1:]:
        steps.append(shared_id_keys(known, df.columns))
        known += [c for c in df.columns if c not in known]
    return steps


def rows_without_key(parts: Sequence[tuple[DataFrame, Sequence[str]]]) -> list[int]:
    """How many rows of each frame lack one of its keys: one job that reads
    the key columns alone."""
    out = None
    for i, (df, keys) in enumerate(parts):
        one = df.agg(F.lit(i).alias("i"), F.count_if(_no_key(keys)).alias("n"))
        out = one if out is None else out.unionByName(one)
    counts = {} if out is None else {r["i"]: r["n"] for r in out.collect()}
    return [counts[i] for i in range(len(parts))]


def union_by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN-03 / SO-01: bag union by column name, missing columns null."""
    return left.unionByName(right, allowMissingColumns=True)


def combine_sources(frames: Sequence[DataFrame], null_keys_match: bool = True, warn=None) -> DataFrame:
    """Left fold of the gold sources: outer join on shared id-like columns,
    union by name when none is shared (JN-01..03).

    A full outer step reads its left input twice (left join and distinct
    keys). When that input is itself an earlier join, it is written once to
    the checkpoint folder first; otherwise each further step would double
    the plan (2^n re-computations of the first join for n sources).

    Rows without a key match each other, n * m of them; ``warn(keys, text)``
    is told where both sides of a step have some. One job counts those of all
    new sources; the rows joined so far are only counted where the new
    source has some.
    """
    return sources_and_pairs(frames, null_keys_match, warn)[0]


def sources_and_pairs(frames: Sequence[DataFrame], null_keys_match: bool = True, warn=None) -> tuple[DataFrame, NullPairs | None]:
    """``combine_sources``, and the pairs of its last step's rows without a
    key where these are many."""
    steps = fold_keys(frames)
    counted = [(df, keys) for df, keys in zip(frames[1:], steps) if keys] if null_keys_match else []
    first = [(frames[0], steps[0])] if counted and steps[0] else []
    found = rows_without_key([*first, *counted]) if counted else []
    start, new = (found[0] if first else 0), iter(found[len(first):])
    df = frames[0]
    joined, pairs = False, None
    for no, (nxt, keys) in enumerate(zip(frames[1:], steps)):
        if not keys:
            df, pairs = union_by_name(df, nxt), None
            continue
        if joined:
            df = stage_table(df, "outer-join")
        m = next(new) if counted else 0
        n = 0 if not m else start if no == 0 else rows_without_key([(df, keys)])[0]
        if n and warn:
            warn(",".join(keys), f"{n} and {m} rows without a key match each other: {n * m} rows")
        if null_keys_match:
            df, pairs = _full_outer_null_safe(df, nxt, keys, (n, m))
        else:
            df = full_outer(df, nxt, keys, null_keys_match=False)
        joined = True
    return df, pairs


def join_key_candidates(catalog: DataFrame) -> DataFrame:
    """JN-04: every pair of datasets (in catalog order) sharing an id-like
    column name -> (left_dataset, left_column, right_dataset, right_column,
    confidence). ``catalog`` has ``dataset, dataset_no, column``."""
    idlike = F.lower(F.col("column"))
    c = catalog.where((idlike == "id") | idlike.endswith("_id")).select("dataset", "dataset_no", "column")
    l, r = c.alias("l"), c.alias("r")
    return (l.join(r, (F.col("l.column") == F.col("r.column")) & (F.col("l.dataset_no") < F.col("r.dataset_no")))
            .select(F.col("l.dataset").alias("left_dataset"), F.col("l.column").alias("left_column"),
                    F.col("r.dataset").alias("right_dataset"), F.col("r.column").alias("right_column"),
                    F.lit("medium").alias("confidence")))


def measure_key_overlap(tables, candidates: DataFrame) -> DataFrame:
    """JN-04 (measured): for each candidate pair, the number of distinct
    non-null left keys (``left_keys``) and how many of them occur on the
    right (``matched_keys``).

    The candidate list is bounded by the schemas (pairs of id-like column
    names), so it is read on the driver; each pair becomes one aggregate
    branch, and all branches run as ONE job. Both sides are reduced to
    distinct keys (map-side combined) before the join, so a key that holds a
    third of a table is one row at the join.
    """
    pairs = candidates.collect()
    spark = candidates.sparkSession
    schema = ("left_dataset string, left_column string, right_dataset string, right_column string, "
              "confidence string, left_keys long, matched_keys long")
    branches = []
    for p in pairs:
        lk = tables[p.left_dataset].select(F.col(f"`{p.left_column}`").alias("_k")).where(F.col("_k").isNotNull())
        rk = tables[p.right_dataset].select(F.col(f"`{p.right_column}`").alias("_k")).where(F.col("_k").isNotNull())
        hit = rk.distinct().withColumn("_hit", F.lit(1))
        branches.append(lk.distinct().join(hit, "_k", "left").agg(
            F.lit(p.left_dataset).alias("left_dataset"), F.lit(p.left_column).alias("left_column"),
            F.lit(p.right_dataset).alias("right_dataset"), F.lit(p.right_column).alias("right_column"),
            F.lit(p.confidence).alias("confidence"),
            F.count(F.lit(1)).alias("left_keys"), F.count("_hit").alias("matched_keys")))
    if not branches:
        return spark.createDataFrame([], schema)
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out
