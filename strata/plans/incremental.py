"""Incremental layers (RX-06, SC-06): a rerun rebuilds what its inputs, rules
or options change, and nothing else.

Per input table the run's folder keeps the files read so far
(``sources.manifest``), their profile states, and the evidence of the
whole-column decisions. Bronze rows are kept by input file
(``_part=...`` folders), so a new file adds its part, a changed one replaces it
and a removed one takes its part with it. The result is that of a full run:
where the evidence of all files changes a column's type or a whole-number
decision, the table is built anew.

Silver and gold hold statistics, keys and joins over whole tables, so a table
there is built anew when the note it was built with (its sources' notes, its
rules, the options) differs, and kept otherwise. A note is written last: a run
that stops in between does that table's work again.
"""

from __future__ import annotations

import json
from collections import Counter, OrderedDict
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import fractional_flag, is_integral
from ..operators.keys import ORDINAL_COLUMNS, SOURCE_FILE, SOURCE_ROW
from ..operators.profile import PROFILE_SCHEMA
from ..operators.profile_state import STATE, file_states, merge_states, part_of, text_lists
from ..operators.quality import file_summary
from ..session import stage_table
from ..sources.manifest import Evidence, InputState, digest, part_name, read_note, remove_parts, write_note, write_parts
from ..sources.tables import (_without_tokens, NULL_TOKENS, chosen_type, csv_parts, json_parts, read_parquet,
                              type_candidates, type_counts, with_types)
from .layers import run_bronze
from .rules import Rule


class DecisionChanged(Exception):
    """New files turn a whole-column decision that kept rows were built with."""


def per_file(df: DataFrame, counts: dict[str, Sequence]) -> DataFrame:
    """(_part, name, counts...): one aggregate that gives every file's counts
    for every name."""
    entries = [F.struct(F.lit(name).alias("name"), *cols) for name, cols in counts.items()]
    rows = df.groupBy(part_of(F.col(SOURCE_FILE)).alias("_part")).agg(F.array(*entries).alias("e"))
    return rows.select("_part", F.explode("e").alias("e")).select("_part", "e.*")


@dataclass
class Tracked:
    """One input table of a run."""
    spark: SparkSession
    name: str
    path: str
    folder: str
    state: InputState
    csv_multi_line: bool | None = None
    types: dict = field(default_factory=dict)
    rejected: DataFrame | None = None
    full: bool = False                   # everything is built anew
    _fresh: DataFrame | None = None
    _whole: DataFrame | None = None

    @staticmethod
    def open(spark: SparkSession, name: str, path: str, folder: str, csv_multi_line: bool | None = None) -> "Tracked":
        """Compares the files with the recorded ones and settles the columns'
        types; reads nothing of a table without changes."""
        kind = path.rstrip("/").lower().rsplit(".", 1)[-1]
        if kind not in ("csv", "parquet", "json"):
            raise ValueError(f"Unsupported file type: .{kind}")
        out = Tracked(spark, name, path, folder, InputState.open(spark, path, folder), csv_multi_line)
        out.full = out.state.first
        if not out.state.changed():
            return out
        if kind == "csv":
            out._settle_types()
        elif kind == "json":  # its schema is that of all lines
            out.full = True
            out._whole, out.rejected = json_parts(spark, path)
        else:
            schema = read_note(spark, f"{folder}/schema.json")
            now = read_parquet(spark, path)
            if schema is not None and schema != json.loads(now.schema.json()):
                out.full = True
            write_note(spark, f"{folder}/schema.json", json.loads(now.schema.json()))
            out._whole = now
        return out

    @property
    def kind(self) -> str:
        return self.path.rstrip("/").lower().rsplit(".", 1)[-1]

    def changed(self) -> bool:
        return self.full or self.state.changed()

    def replaced(self) -> list[str]:
        """The parts whose rows go: of changed and of removed files (a new
        file's part is empty)."""
        return [part_name(p) for p in (*self.state.fresh, *self.state.gone)]

    def _fresh_paths(self) -> list[str]:
        return [unquote(p) for p in self.state.fresh]

    def _text(self, paths) -> DataFrame:
        kept, self.rejected = csv_parts(self.spark, paths, self.csv_multi_line)
        names = [c for c in kept.columns if c not in (SOURCE_FILE, SOURCE_ROW)]
        return kept.select(*_without_tokens(names, NULL_TOKENS), SOURCE_FILE, SOURCE_ROW)

    def _settle_types(self) -> None:
        """CSV column types from the counts of all files; where the new files
        change one, the kept files are read again."""
        evidence = Evidence(self.spark, f"{self.folder}/types", ["n", "i", "d", "b"])
        before = {c: chosen_type(n) for c, n in evidence.totals(evidence.stored()).items()}
        text = self._text(self.path) if self.full else self._text(self._fresh_paths()) if self.state.fresh else None
        names = type_candidates(text) if text is not None else []
        merged = evidence.merged(per_file(text, {c: type_counts(c) for c in names}) if names else None, self.replaced(), self.full)
        self.types = {c: chosen_type(n) for c, n in evidence.totals(merged).items()}
        evidence.record(merged)
        if self.full:
            self._whole = with_types(text, self.types)
        elif self.types != before:
            self.full = True
        elif text is not None:
            self._fresh = with_types(text, self.types)

    def whole(self) -> DataFrame:
        """All rows of the table."""
        if self._whole is None:
            if self.kind == "csv":
                if not self.types:
                    evidence = Evidence(self.spark, f"{self.folder}/types", ["n", "i", "d", "b"])
                    self.types = {c: chosen_type(n) for c, n in evidence.totals(evidence.stored()).items()}
                fresh = self.rejected
                self._whole = with_types(self._text(self.path), self.types)
                self.rejected = self.rejected if self.full or fresh is None else fresh
            elif self.kind == "json":
                self._whole, self.rejected = json_parts(self.spark, self.path)
            else:
                self._whole = read_parquet(self.spark, self.path)
        return self._whole

    def rows(self, full: bool) -> DataFrame | None:
        """The rows to build from: all, or those of new and changed files."""
        if full:
            return self.whole()
        if not self.state.fresh:
            return None
        if self._fresh is None:
            if self.kind == "csv":
                self._fresh = with_types(self._text(self._fresh_paths()), self.types)
            else:
                paths = self._fresh_paths()
                schema = T.StructType([f for f in self.whole().schema.fields if f.name not in (SOURCE_FILE, SOURCE_ROW)])
                base = self.path if all(p.startswith(self.path.rstrip("/") + "/") for p in paths) else None
                reader = self.spark.read.schema(schema)
                df = (reader.option("basePath", base) if base else reader).parquet(*paths)
                self._fresh = df.select("*", F.col("_metadata.file_path").alias(SOURCE_FILE), F.col("_metadata.row_index").alias(SOURCE_ROW))
        return self._fresh

    # -- profile ---------------------------------------------------------
    def profile(self) -> tuple[list[tuple], list[tuple]]:
        """Profile rows and list-of-value rows of the table (both bounded by
        its columns). New files are scanned once; the others stand with the
        states they left."""
        note = read_note(self.spark, f"{self.folder}/profile.json")
        if not self.changed() and note is not None:
            return [tuple(r) for r in note["profile"]], [tuple(r) for r in note["lists"]]
        table = f"{self.folder}/profile"
        full = self.full or note is None
        rows = self.rows(full)
        if not full:
            remove_parts(self.spark, table, self.replaced())
        if rows is not None:
            write_parts(file_states(rows).withColumn("_part", part_of(F.col("file"))), table, full)
        schema = (rows if rows is not None else self.whole()).schema
        columns = [f.name for f in schema.fields if f.name not in ORDINAL_COLUMNS]
        prof, lov, long_lists = merge_states(self.spark.read.schema(STATE).parquet(table), self.name, schema, columns)
        found = [tuple(r) for r in prof.collect()]
        lists = [] if lov is None else lov.collect()
        if long_lists:
            lists += text_lists(self.whole(), self.name, long_lists).collect()
        values = Counter(r["column"] for r in lists)
        lists = [(self.name, r["column"], values[r["column"]], r["value"], r["freq"]) for r in lists]
        write_note(self.spark, f"{self.folder}/profile.json", {"profile": found, "lists": lists})
        return found, lists


LISTS = "dataset string, column string, unique_count bigint, value string, freq bigint"


def profile_frames(spark: SparkSession, found: Sequence[tuple[list, list]]) -> tuple[DataFrame, DataFrame]:
    """The profile and the lists of values of all tables of a run, from rows
    on the driver."""
    return (spark.createDataFrame([r for rows, _ in found for r in rows], PROFILE_SCHEMA),
            spark.createDataFrame([r for _, rows in found for r in rows], LISTS))


# --------------------------------------------------------------------------
# layer tables with notes
# --------------------------------------------------------------------------

@dataclass
class Built:
    """A layer table and what is known of it."""
    name: str
    path: str
    stamp: str
    schema: T.StructType
    summary: dict
    rebuilt: bool
    parts: list[str] = field(default_factory=list)
    warnings: list = field(default_factory=list)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def kept_table(spark: SparkSession, name: str, path: str, note_path: str, stamp: str) -> Built | None:
    """The table as an earlier run left it, if it was built with this stamp."""
    note = read_note(spark, note_path)
    if note is None or note["stamp"] != stamp or note["path"] != path:
        return None
    return Built(name, path, stamp, T.StructType.fromJson(note["schema"]), note["summary"], rebuilt=False)


def note_table(spark: SparkSession, built: Built, note_path: str, **more) -> Built:
    """Describe a table that was written (its quality summary is one small
    aggregate and the duplicate check) and write its note."""
    built.summary = file_summary(built.name, built.read(spark))
    write_note(spark, note_path, {"stamp": built.stamp, "path": built.path, "schema": json.loads(built.schema.json()),
                                  "summary": built.summary, **more})
    return built


def update_bronze(tracked: Tracked, rules: Sequence[Rule], file_name: str, path: str, integer_policy: str = "all_or_nothing") -> Built:
    """RX-01 by files: only the parts of new, changed and removed files move."""
    spark, note_path = tracked.spark, f"{tracked.folder}/bronze.json"
    name = f"{tracked.name}_bronze"
    note = read_note(spark, note_path)
    made_with = digest([r.__dict__ for r in rules], file_name, integer_policy, tracked.types if tracked.types else (note or {}).get("types"))
    stamp = digest(made_with, tracked.state.print)
    if not tracked.changed():
        built = kept_table(spark, name, path, note_path, stamp)
        if built is not None:
            return built
    full = tracked.full or note is None or note["made_with"] != made_with or note["path"] != path
    evidence = Evidence(spark, f"{tracked.folder}/fractions", ["fractional"])
    types = tracked.types if tracked.types else (note or {}).get("types")

    def build(full: bool) -> Built:
        fresh, fractions = [], {}

        def decide(frame: DataFrame, ints: list[str], dates: list[str]):
            open_ = [c for c in ints if not is_integral(frame.schema[c].dataType)]
            if not open_:
                return {c: False for c in ints}, {}
            flags = {c: [fractional_flag(c, frame.schema[c].dataType).cast("bigint").alias("fractional")] for c in open_}
            fresh.append(stage_table(per_file(frame, flags), "fractions"))
            totals = evidence.totals(evidence.merged(fresh[-1], tracked.replaced(), full))
            frac = {c: bool(totals.get(c, {}).get("fractional")) for c in ints}
            if not full and any(frac[c] != note["fractions"].get(c, False) for c in ints):
                raise DecisionChanged
            fractions.update(frac)
            return frac, {}

        rows = tracked.rows(full)
        touched = [] if full else tracked.replaced()
        if rows is None:
            remove_parts(spark, path, touched)
            schema, warnings = T.StructType.fromJson(note["schema"]), []
            fractions.update(note["fractions"])
        else:
            res = run_bronze(OrderedDict({tracked.name: rows}), rules, {tracked.name: file_name}, integer_policy=integer_policy, decide=decide)
            df = res.tables[name]
            remove_parts(spark, path, touched)
            write_parts(df.withColumn("_part", part_of(rows_file(df, rows))), path, full)
            schema, warnings = df.schema, res.warnings
        if fresh or touched:
            evidence.record(evidence.merged(reduce(DataFrame.unionByName, fresh) if fresh else None, touched, full))
        built = Built(name, path, stamp, schema, {}, True, touched, warnings)
        return note_table(spark, built, note_path, made_with=made_with, fractions=fractions, types=types)

    try:
        return build(full)
    except DecisionChanged:
        return build(True)


def rows_file(df: DataFrame, rows: DataFrame):
    """The column of a bronze frame that holds the scan's file."""
    return F.col(SOURCE_FILE) if SOURCE_FILE in df.columns else F.col("source_file")
