"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines is hashed (two 64-bit hashes), windows
that occur more than once in the corpus are found by one aggregate, and every
occurrence but the first (smallest doc_id, then position) has its lines
removed; overlapping removed windows merge into one set of positions. All
steps are DataFrame operations.

Defined cases: lines are split at newline characters and compared exactly;
windows of three blank lines are left alone; a text of fewer than three lines
or a null text is unchanged; rows that agree in doc_id and text are one
document and keep the same lines; extra columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import row_key, whole_row

WINDOW = 3


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_w1, _w2, _id, _k1, _k2, _pos): one row per window of every text."""
    return (docs.select(F.col("doc_id").alias("_id"), *row_key(F.col("doc_id"), F.col("text")),
                        F.split("text", "\n").alias("_l"))
            .where(F.size("_l") >= window)
            .select("_id", "_k1", "_k2", F.transform("_l", lambda x: F.struct(
                F.xxhash64(x).alias("a"), F.xxhash64(F.lit(5), x).alias("b"), (F.trim(x) == "").alias("e"))).alias("_h"))
            .select("_id", "_k1", "_k2", F.posexplode(F.transform(
                F.sequence(F.lit(0), F.size("_h") - window),
                lambda i: F.struct(F.xxhash64(*[F.col("_h")[i + k]["a"] for k in range(window)]).alias("w1"),
                                   F.xxhash64(*[F.col("_h")[i + k]["b"] for k in range(window)]).alias("w2"),
                                   F.forall(F.slice("_h", i + 1, window), lambda x: x["e"]).alias("e")))
                ).alias("_pos", "_w"))
            .where(~F.col("_w.e"))
            .select(F.col("_w.w1").alias("_w1"), F.col("_w.w2").alias("_w2"), "_id", "_k1", "_k2", "_pos"))


def later_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_k1, _k2, _gone): the merged line positions to remove per document.
    A window that holds a third of all rows is one row a task after the
    partial aggregate; the join back splits it (one row a window on the
    other side)."""
    occ = stage_table(line_windows(docs, window), "line-windows")
    at = F.struct("_id", "_k1", "_k2", "_pos")
    first = (occ.groupBy("_w1", "_w2").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
             .where(F.col("_n") > 1).drop("_n"))
    later = occ.join(first, ["_w1", "_w2"]).where(~at.eqNullSafe(F.col("_first")))
    return later.groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_starts")).select(
        "_k1", "_k2", F.array_distinct(F.flatten(F.transform(
            "_starts", lambda p: F.sequence(p, p + window - 1)))).alias("_gone"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs`` with later copies of repeated windows
    cut out of ``text``, plus _n_lines and _n_removed."""
    gone = later_lines(docs, window)
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(whole_row(rest).alias("_row") if rest else F.lit(None).alias("_row"), "text",
                       *row_key(F.col("doc_id"), F.col("text")))
    lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: lines[i])
    out = rows.join(gone, ["_k1", "_k2"], "left").select(
        "_row", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("_text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_cut"))
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns],
                      F.col("_lines").alias("_n_lines"), F.greatest("_cut", F.lit(0)).alias("_n_removed"))


ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l WHERE len(ls) >= 3),
w AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win FROM p
      WHERE NOT (trim(ls[pos + 1], ' ') = '' AND trim(ls[pos + 2], ' ') = '' AND trim(ls[pos + 3], ' ') = '')),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w),
g AS (SELECT DISTINCT doc_id, pos + o AS pos FROM (SELECT doc_id, pos, unnest([0, 1, 2]) AS o FROM r WHERE k > 1)),
x AS (SELECT l.doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM l),
k AS (SELECT x.doc_id, x.line, x.pos, g.pos IS NOT NULL AS gone FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_removed
FROM k GROUP BY doc_id
"""
