"""Row order, contiguous surrogate keys and keep-first de-duplication
(WN-01, WN-02, WN-03; D6, D7).

Spark has no row order, so every order-dependent operator takes an explicit
ordering: a business key, or the row ordinal recorded at the scan
(``_source_file``, ``_source_row``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import stage_path, stage_table
from .joins import NullPairs

SOURCE_FILE = "_source_file"
SOURCE_ROW = "_source_row"
ORDINAL_COLUMNS = (SOURCE_FILE, SOURCE_ROW)

def _cols(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def ordinal_columns(df: DataFrame) -> list[str]:
    """The row-ordinal columns present in ``df`` (file order = ordinal order)."""
    return [c for c in ORDINAL_COLUMNS if c in df.columns]


def sorted_table(df: DataFrame, order_by: Sequence[str | Column], with_path: bool = False):
    """Write ``df`` sorted by ``order_by`` ONCE to a table in the session's
    checkpoint folder and read it back with each row's rank parts:
    ``_part`` (the writing task = range partition, from the file name) and
    ``_local`` (the row's index in its file, from the Parquet row index).

    The lineage is cut at the written table (a lost executor re-reads it,
    it does not re-sort), and the order survives any later split of the
    files into read partitions.
    """
    spark = df.sparkSession
    path = stage_path(spark, "sorted")
    df.orderBy(*_cols(order_by)).write.option("maxRecordsPerFile", 0).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    tagged = back.select("*",
                         F.regexp_extract(F.col("_metadata.file_name"), r"part-([0-9]+)", 1).cast("long").alias("_part"),
                         F.col("_metadata.row_index").alias("_local"))
    return (tagged, path) if with_path else tagged


def part_offsets(tagged: DataFrame, start: int = 0, weight: str | None = None) -> tuple[DataFrame, list]:
    """Offsets of each written part (one row per part, so the frame is bounded
    by the partition count) as a broadcastable frame, plus (part, lo, hi)."""
    spark = tagged.sparkSession
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = sorted((int(r["_part"]), int(r["_n"] or 0))
                    for r in tagged.groupBy("_part").agg(w.alias("_n")).collect())
    rows, bounds, running = [], [], start
    for part, n in counts:
        rows.append((part, running))
        bounds.append((part, running, running + n))
        running += n
    schema = T.StructType([T.StructField("_pid", T.LongType(), False),
                           T.StructField("_off", T.LongType(), False)])
    return spark.createDataFrame(rows, schema), bounds


def _tiebreak(df: DataFrame, order_by: Sequence[str | Column]) -> list[Column]:
    """Extra sort keys that make ties unique, so that the range partitioner
    can split rows sharing one ``order_by`` value (a value holding a third
    of the table would otherwise be sorted and written by one task): the
    scan ordinal when present, else a row id. Ties keep file order when
    the ordinal is known; otherwise their order is arbitrary, as before.
    The sorted rows are written once, so the row id is never recomputed."""
    ords = ordinal_columns(df)
    if ords:
        named = {c for c in order_by if isinstance(c, str)}
        return [F.col(c) for c in ords if c not in named]
    return [F.monotonically_increasing_id()]


def positions(df: DataFrame, order_by: Sequence[str | Column], name: str = "_pos",
              start: int = 0) -> DataFrame:
    """Attach a contiguous position ``start..start+n-1`` in ``order_by`` order.

    Plan: one distributed range sort written once (``sorted_table``), a
    per-part row count (one row per part), offsets computed from those
    counts and broadcast (size bounded by the partition count, not the
    data), and ``offset + row index`` per row. No step gathers the data into
    one partition and the sort runs once.
    """
    tagged = sorted_table(df, [*_cols(order_by), *_tiebreak(df, order_by)])
    off_df, _ = part_offsets(tagged, start)
    return (tagged.join(F.broadcast(off_df), tagged["_part"] == off_df["_pid"])
            .withColumn(name, F.col("_off") + F.col("_local"))
            .drop("_part", "_local", "_pid", "_off"))


#: Ordinals of split text scans hold the block start above these low bits;
#: those of whole files are below it.
BLOCK_SIZE = 2 ** 33
#: Rows of one directory entry, and of one of its words.
ENTRY, WORD = 2 ** 15, 64
#: A directory of at most so many entries (4 KB each and 4 KB of counts) is
#: broadcast; a larger one is joined by a shuffle on (file, block, entry).
BROADCAST_ENTRIES = 4096
#: The counts of at most so many entries are added up on the driver.
DRIVER_ENTRIES = 100_000


def _address() -> dict[str, Column]:
    """A row's ordinal as (file, block, entry, word, bit)."""
    low = F.expr(f"cast({SOURCE_ROW} % {BLOCK_SIZE} as bigint)")
    return {"file": F.col(SOURCE_FILE), "block": F.expr(f"cast({SOURCE_ROW} div {BLOCK_SIZE} as bigint)"),
            "entry": F.floor(low / ENTRY), "word": F.floor(low % ENTRY / WORD).cast("int"), "bit": (low % WORD).cast("int")}


def _words(df: DataFrame) -> DataFrame:
    """(file, block, entry, word, bits, n): which rows of each run of 64
    ordinals there are, and how many. A scan's rows come in file order, so
    a task sends one row a run."""
    at = _address()
    return (df.select(*[c.alias(f"_{n}") for n, c in at.items()]).groupBy("_file", "_block", "_entry", "_word")
            .agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"), F.count(F.lit(1)).alias("n")))


def ordinals_are_distinct(df: DataFrame) -> bool:
    """Whether every row has an ordinal of its own: exactly, by as many set
    bits as rows."""
    if SOURCE_ROW not in df.columns or SOURCE_FILE not in df.columns:
        return False
    r = _words(df).agg(F.sum("n"), F.sum(F.bit_count("bits")), F.count_if(F.col("_file").isNull() | F.col("_entry").isNull())).first()
    return r[0] == r[1] and not r[2]


def rank_directory(df: DataFrame) -> tuple[DataFrame, int] | None:
    """(file, block, entry, offset, words, before): one row per run of 32 768
    ordinals with the rows that are there as bits, the number of set bits in
    front of each word, and the number of rows in front of the entry, files by
    name; and how many entries there are. Built from the two ordinal columns
    alone; None where an ordinal is missing or repeated, for then rows can't be
    told apart (the set bits are counted against the rows, so this is exact)."""
    per_word = F.map_from_entries(F.collect_list(F.when(F.col("_word").isNotNull(), F.struct("_word", "bits"))))
    entries = stage_table(_words(df).groupBy("_file", "_block", "_entry").agg(
        per_word.alias("w"), F.sum("n").alias("n"), F.sum(F.bit_count("bits")).cast("long").alias("held")).select(
        "_file", "_block", "_entry", "n", "held", F.transform(F.sequence(F.lit(0), F.lit(ENTRY // WORD - 1)),
                                                              lambda i: F.coalesce(F.col("w")[i], F.lit(0).cast("long"))).alias("words")), "ranks")
    at = ["_file", "_block", "_entry"]
    rows = entries.select(*at, "n", "held").limit(DRIVER_ENTRIES + 1).collect()
    if len(rows) <= DRIVER_ENTRIES:
        if any(None in (r["_file"], r["_entry"]) or r["n"] != r["held"] for r in rows):
            return None
        offsets, running = [], 0
        for r in sorted(rows):
            offsets.append((*r[:3], running))
            running += r["n"]
        front = F.broadcast(df.sparkSession.createDataFrame(offsets, "_f string, _b long, _e long, _offset long"))
        numbered = entries.join(front, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")) & (F.col("_entry") == F.col("_e")))
        return numbered.select(*at, "_offset", "words", _set_before("words").alias("before")), len(rows)
    # more entries: one row a file reaches the driver, the rest is a running sum inside each file
    files = entries.groupBy("_file").agg(F.sum("n").alias("n"), F.sum("held").alias("held"), F.count(F.lit(1)).alias("entries"),
                                         F.count_if(F.col("_entry").isNull()).alias("unset")).collect()
    if any(r["_file"] is None or r["unset"] or r["n"] != r["held"] for r in files):
        return None
    starts, running = [], 0
    for r in sorted(files, key=lambda r: r["_file"]):
        starts.append((r["_file"], running))
        running += r["n"]
    first = df.sparkSession.createDataFrame(starts, "_f string, _start long")
    inside = W.partitionBy("_file").orderBy("_block", "_entry").rowsBetween(W.unboundedPreceding, -1)
    numbered = entries.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(first), F.col("_file") == F.col("_f"))
    directory = numbered.select(*at, (F.col("_start") + F.col("_in")).alias("_offset"), "words", _set_before("words").alias("before"))
    return stage_table(directory, "rank-directory"), sum(r["entries"] for r in files)


def _set_before(words: str) -> Column:
    """How many bits are set in front of each word."""
    counts = F.transform(words, lambda x: F.bit_count(x).cast("int"))
    return F.aggregate(counts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def ranked_positions(df: DataFrame, name: str, start: int = 0) -> DataFrame | None:
    """Contiguous positions in file order without a sort or a copy, also
    where rows were dropped: a row's position is its entry's offset plus the
    set bits in front of its own (``rank_directory``). None without distinct
    ordinals: sort then."""
    if SOURCE_ROW not in df.columns or SOURCE_FILE not in df.columns:
        return None
    found = rank_directory(df)
    if found is None:
        return None
    directory, entries = found
    at = _address()
    names = ["file", "block", "entry"]
    rows = df.select("*", *[at[n].alias(f"_r_{n}") for n in (*names, "word", "bit")])
    same = [F.col(f"_r_{n}") == F.col(f"_{n}") for n in names]
    joined = rows.join(F.broadcast(directory) if entries <= BROADCAST_ENTRIES else directory, same[0] & same[1] & same[2])
    front = F.expr("~shiftleft(-1L, _r_bit)")
    rank = F.col("before")[F.col("_r_word")] + F.bit_count(F.col("words")[F.col("_r_word")].bitwiseAND(front))
    return joined.withColumn(name, F.col("_offset") + rank + start).select(*[F.col(f"`{c}`") for c in df.columns], name)


def paired_positions(pairs: NullPairs, order_by: Sequence[str | Column], name: str, start: int = 0) -> DataFrame | None:
    """``positions`` of a join's rows, of which n * m are pairs of rows without
    a key, without a sort or a copy of the pairs. A pair's values come from
    its left row or its right row, so it is enough to sort the n left rows
    among the join's other rows, each counted m times, and the m right rows by
    themselves: t left rows that are equal in the order take t * m positions,
    t for each right row. None where the order has a column of the right rows
    before one of the left rows, or where such left rows equal one of the
    other rows, whose place is then among their pairs: sort then."""
    lcols, rcols, m = pairs.left.columns, pairs.right.columns, pairs.counts[1]
    if not all(isinstance(c, str) for c in order_by):
        return None
    by_left = [c for c in order_by if c in lcols]
    by_right = [c for c in order_by if c not in lcols]
    if not by_left or list(order_by) != by_left + by_right:
        return None
    cols = [F.col(f"`{c}`") for c in (*lcols, *rcols)]
    left = pairs.left.select("*", *[F.lit(None).cast(pairs.right.schema[c].dataType).alias(c) for c in rcols], F.lit(1).alias("_pairs"))
    rows = left.unionByName(pairs.rest.select(*cols, F.lit(0).alias("_pairs")))
    tagged = sorted_table(rows, [*_cols(by_left), F.col("_pairs"), *_cols(by_right), *_tiebreak(rows, order_by)])
    ties = [F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(by_left)]

    same = F.lit(True)
    for i, c in enumerate(by_left):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_t{i}"))
    paired, alone = tagged.where("_pairs = 1"), tagged.where("_pairs = 0")
    values = paired.select(*ties).distinct()
    if alone.join(values, same, "left_semi").limit(1).collect():
        return None
    parts, rank, before = [], 0, 0
    for part, held, with_pairs in sorted(tuple(r) for r in tagged.groupBy("_part").agg(F.count(F.lit(1)), F.sum("_pairs")).collect()):
        parts.append((part, rank, before))
        rank, before = rank + held, before + with_pairs
    offsets = F.broadcast(tagged.sparkSession.createDataFrame(parts, "_pid long, _off long, _paired_off long"))
    inside = W.partitionBy("_part").orderBy("_local").rowsBetween(W.unboundedPreceding, -1)
    placed = (tagged.withColumn("_before", F.coalesce(F.sum("_pairs").over(inside), F.lit(0)))
              .join(offsets, F.col("_part") == F.col("_pid"))
              .withColumn("_rank", F.col("_off") + F.col("_local"))
              .withColumn("_at", F.col("_rank") + F.lit(m - 1) * (F.col("_before") + F.col("_paired_off")) + start))
    rest = placed.where("_pairs = 0").select(F.col("_at").alias(name), *cols)
    paired = placed.where("_pairs = 1").select(*[F.col(f"`{c}`") for c in lcols], "_rank", "_at")
    equal = paired.groupBy(*ties).agg(F.min("_at").alias("_first"), F.min("_rank").alias("_first_rank"), F.count(F.lit(1)).alias("_equal"))
    lefts = stage_table(paired.join(equal, same).select(
        *[F.col(f"`{c}`") for c in lcols], (F.col("_first") + F.col("_rank") - F.col("_first_rank")).alias("_first"), "_equal"), "paired-rows")
    rights = positions(pairs.right if rcols else pairs.right.select(F.lit(0).alias("_none")), by_right, name="_no")
    made = pairs.made(lefts, rights).select((F.col("_first") + F.col("_no") * F.col("_equal")).alias(name), *cols)
    return made.unionByName(rest)


def add_surrogate_key(df: DataFrame, name: str, order_by: Sequence[str | Column] | None = None,
                      start: int = 1, pairs: NullPairs | None = None) -> DataFrame:
    """WN-01: ``name`` = 1..n as the first column, in ``order_by`` order
    (default: the row ordinal, else all columns); skipped if present.
    ``pairs``: those of ``df``'s rows that are pairs of rows without a key."""
    if name in df.columns:
        return df
    if not order_by:
        order_by = ordinal_columns(df) or list(df.columns)
    cols = list(df.columns)
    keyed = paired_positions(pairs, order_by, name, start) if pairs else None
    if keyed is None and list(order_by) == ordinal_columns(df):
        keyed = ranked_positions(df, name, start)
    if keyed is None:
        keyed = positions(df, order_by, name=name, start=start)
    return keyed.select(name, *cols)


#: Up to so many addresses (a file name and a number each) are broadcast.
BROADCAST_ADDRESSES = 500_000


def keep_rows(df: DataFrame, chosen: DataFrame, total: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ordinals are in ``chosen`` (distinct ordinals
    of rows of ``df``). Few chosen rows, or few others, are broadcast as
    addresses, so that the rows themselves are not shuffled."""
    same = list(ORDINAL_COLUMNS)
    n = chosen.count()
    if n <= BROADCAST_ADDRESSES:
        return df.join(F.broadcast(chosen), same, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
    total = df.count() if total is None else total
    if total - n <= BROADCAST_ADDRESSES:
        others = stage_table(df.select(*same).join(chosen, same, "left_anti"), "other-rows")
        return df.join(F.broadcast(others), same, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
    return df.join(chosen, same, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def first_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ordinals of the first row of each key, written once. Only keys and
    ordinals are read and shuffled, and a hot key is one row a task."""
    at = F.min(F.struct(*ORDINAL_COLUMNS)).alias("_at")
    found = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(at).select(*[F.col(f"_at.{c}").alias(c) for c in ORDINAL_COLUMNS])
    return stage_table(found, "first-rows")


def _first_equal_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The ordinals of all rows but later copies of equal ones. Two 64-bit
    hashes find the rows that may have a copy; only those are compared whole."""
    refs = [F.col(f"`{c}`") for c in columns]
    hashes = [F.xxhash64(*refs).alias("_h1"), F.xxhash64(F.lit("strata"), *refs).alias("_h2")]
    at = list(ORDINAL_COLUMNS)
    hashed = df.select(*hashes, *at)
    groups = stage_table(hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*at)).alias("_at")), "row-hashes")
    alone = groups.where("_n = 1").select(*[F.col(f"_at.{c}").alias(c) for c in at])
    several = groups.where("_n > 1").select("_h1", "_h2")
    if several.count() <= BROADCAST_ADDRESSES:
        several = F.broadcast(several)
    compared = df.select(*hashes, "*").join(several, ["_h1", "_h2"], "left_semi").groupBy(*refs).agg(F.min(F.struct(*at)).alias("_at"))
    return stage_table(alone.union(compared.select(*[F.col(f"_at.{c}").alias(c) for c in at])), "first-rows")


def dedup_keep_first(df: DataFrame, subset: Sequence[str] | None,
                     order_by: Sequence[str] | None = None) -> DataFrame:
    """WN-02 / WN-03 / SO-02: keep the first row (in ``order_by`` order, default the
    row ordinal) of each ``subset`` key; nulls equal each other (D6).

    In file order the winners are picked as addresses: keys and ordinals alone
    go through the aggregate (``first_rows``), and the rows are then read by
    address (``keep_rows``). That needs distinct ordinals, which is checked
    exactly; else, and for another order, the winner's other columns travel
    with it (``min(struct(order, payload))``). Either way the partial
    aggregate leaves one row a key and task, so a key holding a third of
    the table never lands in one task as raw rows.
    """
    cols = list(df.columns)
    order = list(order_by) if order_by else ordinal_columns(df)
    if not order:
        # no order known: any row of the key is as good
        return df.dropDuplicates(list(subset) if subset is not None else None)
    if order == list(ORDINAL_COLUMNS) and ordinals_are_distinct(df):
        keys = [c for c in cols if c not in order] if subset is None else list(subset)
        return keep_rows(df, _first_equal_rows(df, keys) if subset is None else first_rows(df, keys))
    keys = [c for c in cols if c not in order] if subset is None else list(subset)
    payload = order + [c for c in cols if c not in keys and c not in order]
    agg = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in payload])).alias("_first"))
    return agg.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_first.`{c}`").alias(c) for c in cols])
