"""Mergeable profile (AG-02, AG-04, RX-04): what a file's rows add to its
table's profile, written once and merged with the other files'.

A file's state is its value histogram: one row per column and distinct value
with the number of rows and the first row that holds it. One scan makes it for
all columns (the rows are unpivoted and grouped by file, column and value). Row
counts, null counts, exact distinct counts, smallest, largest and mean value,
the first sample and the lists of values of the table all follow from the
states of its files, so a new file costs a scan of that file only.

A value stands as a whole number, a double or a text; texts beyond
``HASHED_FROM`` bytes as their SHA-256, so a state holds no documents. The
first long text of a file is read by a second aggregate over the columns
that have some.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import is_numeric, is_string
from .keys import SOURCE_FILE, SOURCE_ROW
from .profile import HASHED_FROM, LOV_MAX_DISTINCT, PROFILE_SCHEMA, _data_columns

#: ``id``: "t" + the value as text, or "h" + the SHA-256 of a long text.
STATE = "file string, c int, id string, whole bigint, num double, n bigint, at decimal(33,0), long_text string"


def part_of(file: Column) -> Column:
    """The name under which a file's rows and states are kept."""
    return F.substring(F.sha2(file, 256), 1, 16)


def _value(df: DataFrame, no: int, name: str) -> Column:
    dtype = df.schema[name].dataType
    c = F.col(f"`{name}`")
    none_text, none_long, none_num = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double")
    if isinstance(dtype, T.IntegralType):
        parts = none_text, c.cast("bigint"), none_num
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        number = c.cast("double") + F.lit(0.0)  # one zero
        parts = none_text, none_long, F.when(~F.isnan(c), number)
    else:
        text = c.cast("string")
        key = F.when(F.octet_length(text) <= HASHED_FROM, F.concat(F.lit("t"), text)).otherwise(F.concat(F.lit("h"), F.sha2(text, 256)))
        parts = key, none_long, c.cast("double") if isinstance(dtype, T.DecimalType) else none_num
    return F.struct(F.lit(no).alias("c"), parts[0].alias("id"), parts[1].alias("whole"), parts[2].alias("num"))


def file_states(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The states of all files of a scan with ordinals."""
    cols = list(columns) if columns is not None else _data_columns(df, None)
    at = F.col(SOURCE_ROW).cast("decimal(33,0)").alias("at")
    long_rows = df.select(F.col(SOURCE_FILE).alias("file"), at, F.explode(F.array(*[_value(df, i, c) for i, c in enumerate(cols)])).alias("v"))
    states = long_rows.groupBy("file", "v.c", "v.id", "v.whole", "v.num").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    states = states.withColumn("long_text", F.lit(None).cast("string"))
    kinds = (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)
    texts = [(i, F.col(f"`{c}`").cast("string")) for i, c in enumerate(cols) if isinstance(df.schema[c].dataType, kinds)]
    if not texts:
        return states
    # one row a file and text column with a long value: the first such value
    row = [F.when(F.octet_length(c) > HASHED_FROM, F.col(SOURCE_ROW)) for _, c in texts]
    first = df.groupBy(F.col(SOURCE_FILE).alias("file")).agg(F.array(*[F.struct(
        F.lit(i).alias("c"), F.min_by(c, r).alias("text"), F.min(r).cast("decimal(33,0)").alias("at")) for (i, c), r in zip(texts, row)]).alias("f"))
    samples = first.select("file", F.explode("f").alias("f")).where("f.at IS NOT NULL").select(
        "file", "f.c", F.lit(None).cast("string").alias("id"), F.lit(None).cast("bigint").alias("whole"),
        F.lit(None).cast("double").alias("num"), F.lit(0).cast("bigint").alias("n"), "f.at", F.col("f.text").alias("long_text"))
    return states.unionByName(samples)


def merge_states(states: DataFrame, name: str, schema: T.StructType, columns: Sequence[str]) -> tuple[DataFrame, DataFrame | None, list[str]]:
    """(profile rows, list-of-values rows, columns whose list of values has
    long texts and is left out) of a table from its files' states."""
    spark = states.sparkSession
    values = states.where("n > 0").groupBy("c", "id", "whole", "num").agg(F.sum("n").alias("n"), F.min(F.struct("file", "at")).alias("first"))
    number = F.coalesce(F.col("whole").cast("double"), F.col("num"))
    there = F.coalesce(F.col("id").isNotNull() | F.col("whole").isNotNull() | F.col("num").isNotNull(), F.lit(False))
    per = {r["c"]: r for r in values.groupBy("c").agg(
        F.sum("n").alias("rows"), F.sum(F.when(there, F.col("n"))).alias("nn"), F.count(F.when(there, 1)).alias("u"),
        F.min(number).alias("mn"), F.max(number).alias("mx"), F.sum(number * F.col("n")).alias("total"),
        F.min_by("id", F.when(there, F.col("first"))).alias("sample"),
        F.count_if(F.col("id").startswith("h")).alias("hashed")).collect()}
    longs = {} if not any(r["hashed"] for r in per.values()) else {r["c"]: r["t"] for r in states.where("n = 0").groupBy("c").agg(
        F.min_by("long_text", F.struct("file", "at")).alias("t")).collect()}
    rows = []
    for i, c in enumerate(columns):
        dtype, st = schema[c].dataType, per.get(i)
        total, nn = (int(st["rows"]), int(st["nn"] or 0)) if st else (0, 0)
        numeric = is_numeric(dtype)
        sample = None if numeric or not st or st["sample"] is None else longs.get(i) if st["sample"].startswith("h") else st["sample"][1:]
        rows.append((name, i, c, dtype.simpleString(), total, total - nn, round((total - nn) * 100.0 / total, 2) if total else 0.0,
                     int(st["u"]) if st else 0, True, st["mn"] if numeric and st else None, st["mx"] if numeric and st else None,
                     st["total"] / nn if numeric and nn else None, sample))
    prof = spark.createDataFrame(rows, PROFILE_SCHEMA)
    small = [i for i, c in enumerate(columns) if is_string(schema[c].dataType) and i in per and 0 < per[i]["u"] < LOV_MAX_DISTINCT]
    long_lists = [columns[i] for i in small if per[i]["hashed"]]
    listed = {i: columns[i] for i in small if columns[i] not in long_lists}
    if not listed:
        return prof, None, long_lists
    names = F.create_map(*[x for i, c in listed.items() for x in (F.lit(i), F.lit(c))])
    lov = values.where(F.col("c").isin(list(listed)) & F.col("id").isNotNull()).select(
        F.lit(name).alias("dataset"), names[F.col("c")].alias("column"), F.substring("id", 2, 1 << 20).alias("value"), F.col("n").alias("freq"))
    return prof, lov, long_lists


def text_lists(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame | None:
    """List-of-values rows of columns proven small, from the rows themselves."""
    if not columns:
        return None
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns])).alias("p"))
    return pairs.select("p.column", "p.value").where("value IS NOT NULL").groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("freq")).select(F.lit(name).alias("dataset"), "column", "value", "freq")


def state_profile(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """A table's profile by way of its files' states (nothing is kept)."""
    cols = _data_columns(df, None)
    prof, lov, long_lists = merge_states(file_states(df), name, df.schema, cols)
    more = text_lists(df, name, long_lists)
    return prof, more if lov is None else lov if more is None else lov.unionByName(more)


