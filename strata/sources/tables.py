"""Table scans and sinks (SC-01..SC-06, SC-17, PR-03).

Every scan returns a lazy DataFrame plus the row ordinal the order-dependent
operators need: ``_source_file`` (the file the row came from) and
``_source_row`` (its position in that file: the Parquet row index, or for
CSV/JSON a value that increases along each file, see ``split_ordinal``).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import PySparkException

from ..functions.clean import text_double
from ..operators.joins import is_id_like
from ..operators.keys import SOURCE_FILE, SOURCE_ROW
from ..session import stage_table

# Text read as missing in CSV input (the pandas default list).
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

SUPPORTED_SUFFIXES = (".csv", ".parquet", ".json")

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """SC-02: one Parquet table of a data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stem_of(path: str) -> str:
    base = os.path.basename(path.rstrip("/"))
    return os.path.splitext(base)[0]


def with_parquet_ordinal(df: DataFrame) -> DataFrame:
    """Row ordinal of a Parquet scan: file path + row index inside the file."""
    return df.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE),
                     F.col("_metadata.row_index").alias(SOURCE_ROW))


def read_parquet(spark: SparkSession, path: str, ordinal: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return with_parquet_ordinal(df) if ordinal else df


def split_ordinal():
    """Position of a row inside its file for a scan whose files may be split:
    ``file_block_start * 2^33 + (row id within the read partition)``.

    A split (block) is read whole by one partition and its rows get
    consecutive row ids there; splits of one file have increasing block
    starts. So within each file the value grows strictly along the file,
    whatever order the splits were packed into partitions in (Spark packs
    them largest first). The row id part is below 2^33 (the low bits of
    ``monotonically_increasing_id``); decimal(33,0) cannot overflow."""
    block = F.col("_metadata.file_block_start").cast("decimal(20,0)")
    rid = F.pmod(F.monotonically_increasing_id(), F.lit(2 ** 33)).cast("decimal(11,0)")
    return (block * F.lit(2 ** 33).cast("decimal(11,0)") + rid).cast("decimal(33,0)")


def quoted_newlines(spark: SparkSession, path: str) -> bool:
    """Whether some line of the file isn't whole records on its own, so that a
    quoted field may go on in the next line. A parallel scan of the text: what
    is left of a line without its escaped quotes and its quoted fields must
    hold no quote."""
    fields = F.regexp_replace(F.regexp_replace("value", '""', ""), r'(^|,)\s*"[^"]*"\s*(?=,|$)', "$1")
    return not spark.read.text(path).where(F.col("value").contains('"') & fields.contains('"')).isEmpty()


def _without_tokens(names: Iterable[str], null_tokens: Iterable[str]) -> list[Column]:
    """The columns with null in place of the null tokens."""
    toks = list(null_tokens)
    return [F.when(F.col(f"`{c}`").isin(toks), F.lit(None)).otherwise(F.col(f"`{c}`")).alias(c) for c in names]


def read_csv_text(spark: SparkSession, path: str, null_tokens: Iterable[str] = NULL_TOKENS,
                  multi_line: bool | None = None) -> DataFrame:
    """SC-01 part 1: CSV as text (header, quoted fields), the null-token list
    mapped to NULL (D14), plus the row ordinal.

    Newlines inside quoted fields are accepted; a file that has some cannot
    be split, so it is one task. All others are read in splits in parallel.
    By default a scan of the text finds out (``quoted_newlines``); a caller
    who knows saves it by ``multi_line``."""
    multi_line = quoted_newlines(spark, path) if multi_line is None else multi_line
    raw = (spark.read.option("header", True).option("multiLine", multi_line)
           .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    # multi-line files are read whole, so the scan's row id grows along each
    # file; split files need the block start in front of it
    row = F.monotonically_increasing_id() if multi_line else split_ordinal()
    return raw.select(*_without_tokens(raw.columns, null_tokens), F.col("_metadata.file_path").alias(SOURCE_FILE), row.alias(SOURCE_ROW))


_INT_RE = r"^\s*[+-]?[0-9]+\s*$"
_BOOL_TRUE = ["True", "TRUE", "true"]
_BOOL_FALSE = ["False", "FALSE", "false"]


def type_candidates(df: DataFrame, keep_text=is_id_like) -> list[str]:
    """Text columns whose type is found from their values; id-like names stay
    text (leading zeros kept, D15)."""
    return [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType) and c != SOURCE_FILE and not keep_text(c)]


def type_counts(c: str) -> list[Column]:
    """How many values of a text column there are, and how many of them read
    as whole numbers, as numbers and as booleans. The counts of a table's
    files add up to the table's."""
    col = F.col(f"`{c}`")
    whole = col.rlike(_INT_RE) & F.expr(f"try_cast(`{c}` as bigint)").isNotNull()
    return [F.count(col).alias("n"), F.count(F.when(whole, 1)).alias("i"), F.count(text_double(col)).alias("d"),
            F.count(F.when(col.isin(_BOOL_TRUE + _BOOL_FALSE), 1)).alias("b")]


def chosen_type(counts) -> str:
    """The type that every value of a column has: bigint, double, boolean,
    else string (a column without values too)."""
    for kind, type_name in (("i", "bigint"), ("d", "double"), ("b", "boolean")):
        if counts["n"] and counts[kind] == counts["n"]:
            return type_name
    return "string"


def with_types(df: DataFrame, types) -> DataFrame:
    """Text columns read as the types of ``types`` (column -> type)."""
    def read(c):
        col = F.col(f"`{c}`")
        kind = types.get(c, "string")
        if kind == "bigint":
            return F.expr(f"try_cast(`{c}` as bigint)").alias(c)
        if kind == "double":
            return text_double(col).alias(c)
        if kind == "boolean":
            return F.when(col.isin(_BOOL_TRUE), True).when(col.isin(_BOOL_FALSE), False).alias(c)
        return col
    return df.select(*[read(c) for c in df.columns])


def infer_types(df: DataFrame, keep_text=None) -> DataFrame:
    """SC-01 part 2 (D15): integer / double / boolean per text column, found
    in ONE aggregate job."""
    cand = type_candidates(df, keep_text or is_id_like)
    if not cand:
        return df
    row = df.agg(*[F.struct(*type_counts(c)).alias(f"c{i}") for i, c in enumerate(cand)]).first()
    return with_types(df, {c: chosen_type(row[f"c{i}"]) for i, c in enumerate(cand)})


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool | None = None) -> DataFrame:
    df = read_csv_text(spark, path, multi_line=multi_line)
    return infer_types(df) if infer else df


def read_csv_checked(spark: SparkSession, path: str, multi_line: bool | None = None,
                     null_tokens: Iterable[str] = NULL_TOKENS) -> tuple[DataFrame, DataFrame]:
    """SC-01 with SC-04: the typed rows and the rejected ones. The text is
    parsed once, into a staged table."""
    kept, rejected = csv_parts(spark, path, multi_line)
    names = [c for c in kept.columns if c not in (SOURCE_FILE, SOURCE_ROW)]
    return infer_types(kept.select(*_without_tokens(names, null_tokens), SOURCE_FILE, SOURCE_ROW)), rejected


def read_source(spark: SparkSession, path: str, ordinal: bool = True, csv_multi_line: bool | None = None) -> DataFrame:
    """SC-03: reader chosen by suffix; any other suffix is an error."""
    p = path.rstrip("/").lower()
    if p.endswith(".csv"):
        return read_csv(spark, path, multi_line=csv_multi_line)
    if p.endswith(".parquet"):
        return read_parquet(spark, path, ordinal=ordinal)
    if p.endswith(".json"):
        kept = json_parts(spark, path)[0]
        return kept if ordinal else kept.drop(SOURCE_FILE, SOURCE_ROW)
    raise ValueError(f"Unsupported file type: {os.path.splitext(p)[1]}")


def table_names(paths: Iterable[str]) -> dict[str, str]:
    """SC-05: path -> table name: the stem; where several paths share one, as
    many of their folders in front of it as tell them apart."""
    paths = list(dict.fromkeys(paths))
    parts = {p: [x for x in re.split(r"[/\\]+", os.path.dirname(p.rstrip("/"))) if x] for p in paths}
    names, depth = {p: stem_of(p) for p in paths}, 0
    while len(set(names.values())) < len(paths) and depth < max(map(len, parts.values())):
        depth += 1
        shared = {n for n in names.values() if list(names.values()).count(n) > 1}
        names.update({p: "_".join([*parts[p][-depth:], stem_of(p)]) for p in paths if names[p] in shared})
    if len(set(names.values())) < len(paths):
        raise ValueError(f"inputs cannot be told apart: {sorted(names)}")
    return names


def read_many(spark: SparkSession, paths: Iterable[str], csv_multi_line: bool | None = None,
              rejected: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """SC-04/SC-05: many files -> tables by name; an unreadable source is
    skipped and its error recorded (its schema is resolved eagerly). With
    ``rejected``, CSV rows that don't fit the header and JSON lines that
    can't be read go there, by table."""
    tables, errors = {}, {}
    for p, name in table_names(paths).items():
        try:
            if rejected is not None and p.rstrip("/").lower().endswith(".csv"):
                df, rejected[name] = read_csv_checked(spark, p, csv_multi_line)
            elif rejected is not None and p.rstrip("/").lower().endswith(".json"):
                df, rejected[name] = json_parts(spark, p)
            else:
                df = read_source(spark, p, csv_multi_line=csv_multi_line)
            df.schema  # noqa: B018  resolve now so a bad path fails here
            tables[name] = df
        except (PySparkException, ValueError, OSError) as exc:
            errors[name] = str(exc)
    return tables, errors


def csv_parts(spark: SparkSession, path: str, multi_line: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """SC-04: (rows whose field count fits the header, rejected rows as
    ``_corrupt_record`` with file and ordinal). No row is lost: kept and
    rejected rows add up to the input."""
    multi_line = quoted_newlines(spark, path) if multi_line is None else multi_line
    header = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path).schema
    schema = T.StructType([*header.fields, T.StructField("_corrupt_record", T.StringType())])
    raw = (spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"')
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(path))
    row = F.monotonically_increasing_id() if multi_line else split_ordinal()
    # parsed and written once: both parts read that table, not the text again
    raw = stage_table(raw.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE), row.alias(SOURCE_ROW)), "csv")
    bad = F.col("_corrupt_record").isNotNull()
    return raw.where(~bad).drop("_corrupt_record"), raw.where(bad).select("_corrupt_record", SOURCE_FILE, SOURCE_ROW)


def json_parts(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """SC-04 for JSON, one object a line (read in splits) or an array of
    objects: (rows, rejected lines as ``_corrupt_record`` with file and
    ordinal). A line that can't be read is rejected whole; it adds neither a
    column nor a null row. A field of the data that is named
    ``_corrupt_record`` stays data."""
    head = spark.read.text(path).where(F.trim("value") != "").first()
    whole = head is not None and head[0].lstrip().startswith("[")
    reader = spark.read.option("multiLine", whole)
    fields = reader.option("mode", "DROPMALFORMED").json(path).schema.fields
    bad = "_corrupt_record"
    while bad.lower() in {f.name.lower() for f in fields}:
        bad += "_"
    schema = T.StructType([*fields, T.StructField(bad, T.StringType())])
    raw = (spark.read.schema(schema).option("multiLine", whole).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", bad).json(path))
    row = F.monotonically_increasing_id() if whole else split_ordinal()
    # parsed and written once: both parts read that table, not the text again
    raw = stage_table(raw.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE), row.alias(SOURCE_ROW)), "json")
    broken = F.col(bad).isNotNull()
    return raw.where(~broken).drop(bad), raw.where(broken).select(F.col(bad).alias("_corrupt_record"), SOURCE_FILE, SOURCE_ROW)


def layer_path(root: str, layer: str, run_id: str, table: str) -> str:
    return os.path.join(root, layer, run_id, table)


def write_table(df: DataFrame, path: str) -> str:
    """SC-06: one table per folder, overwrite."""
    df.write.mode("overwrite").parquet(path)
    return path


def is_complete(spark: SparkSession, path: str) -> bool:
    """A layer table counts as done when its ``_SUCCESS`` marker exists."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")  # noqa: SLF001
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    return bool(fs.exists(jvm_path))


def sql_safe_name(name: str) -> str:
    """SC-17: ``-`` and blanks -> ``_``."""
    return re.sub(r"[- ]", "_", name)


def register_views(tables: dict[str, DataFrame]) -> dict[str, str]:
    """SC-17: register each table as a temp view under its SQL-safe name."""
    names = {}
    for name, df in tables.items():
        safe = sql_safe_name(name)
        df.createOrReplaceTempView(safe)
        names[name] = safe
    return names


def row_counts(tables) -> dict[str, int]:
    """Row count of every table in ONE job: a count branch per table (each
    reads no column, only row counts), unioned."""
    items = list(tables.items())
    if not items:
        return {}
    parts = [df.agg(F.lit(i).alias("_i"), F.count(F.lit(1)).alias("_n")) for i, (_, df) in enumerate(items)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    got = {int(r["_i"]): int(r["_n"]) for r in out.collect()}
    return {name: got[i] for i, (name, _) in enumerate(items)}
