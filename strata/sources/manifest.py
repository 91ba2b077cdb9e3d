"""What a run has read: the files of an input with their lengths and times,
and what each file adds to the whole-column decisions about its table.

A rerun compares the files that are there with the recorded ones
(``changes``) and reads only those that are new or changed. A decision that
depends on the whole column (a CSV column's type, a whole-number cast) is kept
as per-file evidence that adds up, so it is taken anew from the old evidence
and that of the new files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage_table

def input_files(spark: SparkSession, path: str) -> dict[str, list]:
    """path -> [length, time] of the files below a path (a file, a folder or a
    pattern), named as the scans report them. File contents are not read; the
    listing is the one that Spark's driver keeps of any scan of the path."""
    m = F.col("_metadata")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        m.file_path, m.file_size, F.unix_micros(m.file_modification_time)).collect()
    return {r[0]: [r[1], r[2]] for r in rows}


def changes(old: dict[str, list], new: dict[str, list]) -> dict[str, str]:
    """path -> status of every file: ``same``, ``added``, ``changed`` (length or
    time differ) or ``removed``."""
    status = {p: "added" if p not in old else "same" if list(old[p]) == list(new[p]) else "changed" for p in new}
    return status | {p: "removed" for p in old if p not in new}


def digest(*parts) -> str:
    """A short name of small driver-side values (rule rows, options)."""
    return hashlib.sha256(json.dumps(parts, default=str, sort_keys=True).encode()).hexdigest()[:32]


# --------------------------------------------------------------------------
# small texts in the run's folder
# --------------------------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001


def write_note(spark: SparkSession, path: str, value) -> None:
    """A small driver-side value as a JSON file, replaced as a whole."""
    p, fs = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(json.dumps(value, default=str).encode())
    finally:
        out.close()


def read_note(spark: SparkSession, path: str):
    """The value of ``write_note``; None where there is none."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def remove_parts(spark: SparkSession, table: str, parts: Iterable[str]) -> None:
    """Delete the rows of some files from a table kept by part."""
    for part in parts:
        p, fs = _fs(spark, f"{table.rstrip('/')}/_part={part}")
        fs.delete(p, True)


def write_parts(df: DataFrame, table: str, full: bool) -> None:
    """Write rows by their ``_part``; only the parts in ``df`` are replaced,
    with ``full`` the whole table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static" if full else "dynamic").partitionBy("_part").parquet(table)


# --------------------------------------------------------------------------
# one input between two runs
# --------------------------------------------------------------------------

@dataclass
class InputState:
    """The files of one input table against those an earlier run recorded in
    ``folder``. ``fresh`` lists the new and changed files, ``gone`` those that
    were removed; ``first`` says that nothing was recorded."""
    spark: SparkSession
    folder: str
    files: dict[str, list]
    fresh: list[str]
    gone: list[str]
    first: bool

    @staticmethod
    def open(spark: SparkSession, path: str, folder: str) -> "InputState":
        files, old = input_files(spark, path), read_note(spark, f"{folder}/files.json")
        status = changes(old or {}, files)
        return InputState(spark, folder, files, sorted(p for p, s in status.items() if s in ("added", "changed")),
                          sorted(p for p, s in status.items() if s == "removed"), old is None)

    @property
    def print(self) -> str:
        """One text for the files."""
        return digest(self.files)

    def changed(self) -> bool:
        return self.first or bool(self.fresh or self.gone)

    def record(self) -> None:
        """Remember the files; the last step of a run that has used them all,
        so that an interrupted run does its work again."""
        if self.changed():
            write_note(self.spark, f"{self.folder}/files.json", self.files)


def part_name(path: str) -> str:
    """``part_of`` for a path on the driver."""
    return hashlib.sha256(path.encode()).hexdigest()[:16]


class Evidence:
    """Per-file rows (part, name, counts) that add up to a decision."""

    def __init__(self, spark: SparkSession, path: str, counts: Sequence[str]):
        self.spark, self.path, self.counts = spark, path, list(counts)
        self.note = read_note(spark, f"{path}.json")

    @property
    def schema(self) -> str:
        return "_part string, name string, " + ", ".join(f"{c} bigint" for c in self.counts)

    def stored(self) -> DataFrame:
        if self.note is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.note["table"])

    def totals(self, rows: DataFrame) -> dict[str, dict[str, int]]:
        sums = rows.groupBy("name").agg(*[F.sum(c).alias(c) for c in self.counts])
        return {r["name"]: {c: int(r[c] or 0) for c in self.counts} for r in sums.collect()}

    def merged(self, fresh: DataFrame | None, replaced: Sequence[str], full: bool) -> DataFrame:
        """The evidence of all files: the stored rows of files that stay and
        those of the new ones. Written once (it has one row a file and column)."""
        old = None if full else self.stored().where(~F.col("_part").isin(list(replaced))) if replaced else self.stored()
        parts = [x for x in (old, fresh) if x is not None]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return stage_table(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "evidence")

    def record(self, rows: DataFrame) -> None:
        table = f"{self.path}-{uuid.uuid4().hex}"
        rows.write.parquet(table)
        before = self.note
        self.note = {"table": table}
        write_note(self.spark, f"{self.path}.json", self.note)
        if before is not None:
            p, fs = _fs(self.spark, before["table"])
            fs.delete(p, True)
