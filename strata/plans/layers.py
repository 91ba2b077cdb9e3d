"""Rule execution for the three layers (RX-01 bronze, RX-02 silver, RX-03 gold).

Rules are parsed on the driver into typed steps and folded into ONE lazy
``select`` per stage. The only eager points are the whole-column decisions
(integer all-or-nothing, first-format date vote, fill statistics); those
between two row-changing steps are batched, so that the number of jobs
doesn't depend on the number of columns.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clean
from ..functions.dates import DATE_FORMATS, parse_generic, parse_text_with
from ..operators.aggregate import group_aggregate
from ..operators.joins import NullPairs, sources_and_pairs
from ..operators.keys import ORDINAL_COLUMNS, SOURCE_FILE, add_surrogate_key, dedup_keep_first, ordinal_columns
from ..operators.stats import column_decisions, fill_values
from ..session import stage_table
from .rules import (GoldPlan, Rule, gold_plans, parse_bronze, parse_silver, rules_for_table)


@dataclass
class LayerResult:
    tables: "OrderedDict[str, DataFrame]" = field(default_factory=OrderedDict)
    warnings: list[tuple[str, str, str]] = field(default_factory=list)   # (table, column, message)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means "no value" in every layer, so it becomes null where a frame starts."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floating:
        return df
    return df.select(*[F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`") for c in df.columns])


def _apply(expr: Column, dtype: T.DataType, kind: str, arg=None) -> Column | None:
    """The cleaning functions applied to a column expression of type ``dtype``
    (None = no change)."""
    e = expr
    if kind in ("integer", "integer_per_value"):
        if clean.is_integral(dtype):
            return e.cast("long")
        typed = clean.is_numeric(dtype) or isinstance(dtype, T.BooleanType)
        d = e.cast("double") if typed else clean.text_double(e.cast("string"))
        whole = d.try_cast("long") if typed else clean.text_long(e.cast("string"))
        return F.when(d == F.floor(d), whole) if kind == "integer_per_value" else whole
    if kind == "double":
        if clean.is_numeric(dtype):
            return e
        if isinstance(dtype, T.BooleanType):
            return e.cast("double")
        return clean.text_double(e.cast("string"))
    if kind == "text":
        return e if clean.is_string(dtype) else e.cast("string")
    if kind in ("date_any", "date_first", "date_per_value"):
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            return e
        if isinstance(dtype, T.DateType):
            return e.cast("timestamp")
        s = e.cast("string")
        if kind == "date_first" and arg is not None:
            return parse_text_with(s, arg)
        if kind == "date_per_value":
            return F.coalesce(*[parse_text_with(s, f) for f in DATE_FORMATS], parse_generic(s))
        return parse_generic(s)
    if kind == "lower":
        return F.lower(e.cast("string"))
    if kind == "upper":
        return F.upper(e.cast("string"))
    if kind == "title":
        marked = F.regexp_replace(e.cast("string"), "([^\\p{Lu}\\p{Ll}\\p{Lt}])", "$1\u0001 ")
        return F.regexp_replace(F.initcap(marked), "\u0001 ", "")
    if kind == "strip":
        ws = clean.PY_WHITESPACE_CLASS
        return F.regexp_replace(e.cast("string"), f"^{ws}+|{ws}+$", "")
    if kind == "fill_default":
        return F.coalesce(e, F.lit("")) if clean.is_string(dtype) else None
    if kind == "fill_value":
        value = arg
        if value is None:
            return None
        if clean.is_integral(dtype):
            if isinstance(value, float) and not float(value).is_integer():
                return F.coalesce(e.cast("double"), F.lit(value))
            return F.coalesce(e, F.lit(int(value)).cast(dtype))
        if clean.is_numeric(dtype):
            return F.coalesce(e, F.lit(value).cast(dtype))
        if clean.is_string(dtype):
            text = repr(float(value)) if isinstance(value, float) else str(value)
            return F.coalesce(e, F.lit(text))
        return F.coalesce(e, F.lit(value).cast(dtype))
    raise ValueError(kind)


class Frame:
    """A lazy frame plus pending column expressions over it."""

    def __init__(self, df: DataFrame, decide=column_decisions):
        df = nan_to_null(df)
        self.df = df
        self.decide = decide
        self.cols: "OrderedDict[str, Column]" = OrderedDict((c, F.col(f"`{c}`")) for c in df.columns)
        self.pending: dict[str, tuple[str, str]] = {}   # col -> (kind, date_mode)
        self.fills: dict[str, list[tuple]] = {}         # col -> its fill and the steps that wait for it
        self.shuffled = False   # lineage holds a shuffle (dedup) not yet written

    def reset(self, df: DataFrame) -> None:
        self.df = df
        self.cols = OrderedDict((c, F.col(f"`{c}`")) for c in df.columns)

    def settle(self) -> None:
        """Before an eager job: when the lineage holds a dedup shuffle, write
        the current frame once to the checkpoint folder, so that statistics,
        decisions and the final write read it instead of re-running the
        shuffle each."""
        if self.shuffled:
            self.reset(stage_table(self.current(), "silver"))
            self.shuffled = False

    def current(self) -> DataFrame:
        return self.df.select(*[e.alias(n) for n, e in self.cols.items()])

    def dtype(self, c: str) -> T.DataType:
        return self.df.select(self.cols[c].alias("x")).schema[0].dataType

    def materialize(self) -> None:
        self.resolve()
        self.reset(self.current())

    def rename(self, src: str, dst: str) -> bool:
        """PR-01: rename in rule order (later rules see the new name); a
        rename onto an existing column is refused."""
        if src not in self.cols or src == dst or dst in self.cols:
            return False
        self.resolve_col(src)
        self.cols = OrderedDict((dst if k == src else k, v) for k, v in self.cols.items())
        return True

    def resolve_col(self, c: str) -> None:
        if c in self.pending or c in self.fills:
            self.resolve()

    def resolve(self) -> None:
        """Settle pending whole-column decisions in one aggregate job, and the
        pending fills of all columns together (``fill_values``)."""
        if self.pending or self.fills:
            self.settle()
        while self.pending or self.fills:
            self._decide()
            self._fill()

    def _decide(self) -> None:
        if not self.pending:
            return
        frame = self.current()
        ints = [c for c, (k, _) in self.pending.items() if k == "integer"]
        dates = [c for c, (k, m) in self.pending.items() if k == "date" and m == "first_format"]
        frac, votes = self.decide(frame, ints, dates)
        for c, (kind, mode) in self.pending.items():
            dt = frame.schema[c].dataType
            if kind == "integer":
                if not frac.get(c, False):
                    self.cols[c] = _apply(self.cols[c], dt, "integer")
            elif kind == "date":
                self.cols[c] = _apply(self.cols[c], dt, "date_first", votes.get(c))
        self.pending = {}

    def _fill(self) -> None:
        waiting, self.fills = self.fills, {}
        if not waiting:
            return
        values = fill_values(self.current(), {c: steps[0][1] for c, steps in waiting.items()})
        for c, steps in waiting.items():
            if values[c] is not None:
                self.apply(c, "fill_value", values[c])
            for how, kind, arg in steps[1:]:
                (self.apply if how == "apply" else self.defer)(c, kind, arg)

    def apply(self, c: str, kind: str, arg=None) -> None:
        if c in self.fills:
            self.fills[c].append(("apply", kind, arg))
            return
        self.resolve_col(c)
        dt = self.dtype(c)
        out = _apply(self.cols[c], dt, kind, arg)
        if out is not None:
            self.cols[c] = out

    def defer(self, c: str, kind: str, mode: str = "") -> None:
        if c in self.fills:
            self.fills[c].append(("defer", kind, mode))
            return
        self.resolve_col(c)
        self.pending[c] = (kind, mode)

    def defer_fill(self, c: str, statistic: str) -> None:
        """Fill from a statistic of the column as it stands now. Rules on
        other columns don't change it, and whatever changes the rows settles
        it first, so it can wait for the fills of the other columns; the
        column's later steps wait with it."""
        self.resolve_col(c)
        self.fills[c] = [("fill", statistic, None)]


# ---------------------------------------------------------------------------
# RX-01 bronze
# ---------------------------------------------------------------------------

def run_bronze(sources: "OrderedDict[str, DataFrame]", rules: Sequence[Rule],
               file_names: dict[str, str] | None = None, match: str = "word",
               integer_policy: str = "all_or_nothing", decide=column_decisions) -> LayerResult:
    """Rename, cast and add lineage per table; output ``{stem}_bronze``.

    ``integer_policy="all_or_nothing"`` (D2) decides an integer cast for the
    whole column (one aggregate job); ``"per_value"`` casts each value alone
    (non-whole values become null), which keeps the layer row-local for
    streaming ingestion. ``decide`` takes the whole-column decisions of a
    frame (``column_decisions``); an incremental run adds what it knows of
    files that it doesn't read again."""
    res = LayerResult()
    file_names = file_names or {}
    for stem, df in sources.items():
        fname = file_names.get(stem, f"{stem}.csv")
        fr = Frame(df, decide)
        for rule in rules_for_table(rules, fname, stem):
            st = parse_bronze(rule, match)
            if st.kind == "load_ts":
                fr.resolve_col(st.target)
                fr.cols[st.target] = F.current_timestamp()
                continue
            if st.kind == "source_file":
                fr.resolve_col(st.target)
                fr.cols[st.target] = (F.col(SOURCE_FILE) if SOURCE_FILE in df.columns
                                      else F.lit(fname))
                continue
            src, tgt = st.rename_from, st.target
            if src and tgt and src in fr.cols and src != tgt:
                if not fr.rename(src, tgt):
                    res.warnings.append((stem, tgt, "rename target exists; rename skipped"))
            work = tgt if tgt in fr.cols else src
            if not work or work not in fr.cols:
                continue
            if st.cast == "integer":
                if integer_policy == "per_value":
                    fr.apply(work, "integer_per_value")
                else:
                    fr.defer(work, "integer")
            elif st.cast == "text":
                fr.apply(work, "text")
            elif st.cast == "double":
                fr.apply(work, "double")
            elif st.cast == "date":
                fr.apply(work, "date_any")
        fr.resolve()
        if "_load_timestamp" not in fr.cols and "load_timestamp" not in fr.cols:
            fr.cols["_load_timestamp"] = F.current_timestamp()
        if SOURCE_FILE not in fr.cols and "source_file" not in fr.cols:
            fr.cols[SOURCE_FILE] = F.lit(fname)
        res.tables[f"{stem}_bronze"] = fr.current()
    return res


# ---------------------------------------------------------------------------
# RX-02 silver
# ---------------------------------------------------------------------------

def run_silver(sources: "OrderedDict[str, DataFrame]", rules: Sequence[Rule],
               date_mode: str = "per_value", match: str = "word",
               key_order: dict[str, list[str]] | None = None) -> LayerResult:
    """Cleanse per rule, add ``pk_{stem}_silver_id`` and keep approved columns.

    ``sources`` is keyed by the bronze table stem (``x_bronze``); the output
    is keyed ``x_silver``. ``key_order`` gives the surrogate-key order per
    table (default: the row ordinal).
    """
    res = LayerResult()
    key_order = key_order or {}
    for stem, df in sources.items():
        fname = f"{stem}.parquet"
        trs = rules_for_table(rules, fname, stem)
        fr = Frame(df)
        for rule in trs:
            st = parse_silver(rule, match)
            if st.source and st.target and st.source in fr.cols and st.source != st.target:
                if not fr.rename(st.source, st.target):
                    res.warnings.append((stem, st.target, "rename target exists; rename skipped"))
            work = st.target if st.target in fr.cols else st.source
            if st.dedup:
                fr.materialize()
                subset = [work] if work in fr.cols else None
                fr.reset(dedup_keep_first(fr.df, subset))
                fr.shuffled = True
            if not work or work not in fr.cols:
                if not st.dedup:
                    res.warnings.append((stem, work or st.source, "rule column not found"))
                continue
            # stage 1: nulls
            if st.null_op == "drop":            # PR-09
                fr.materialize()
                fr.reset(fr.df.na.drop(subset=[work]))
            elif st.null_op in ("mean", "median", "mode"):
                fr.defer_fill(work, st.null_op)
            elif st.null_op == "default":
                fr.resolve_col(work)
                before = fr.cols[work]
                fr.apply(work, "fill_default")
                if fr.cols[work] is before:
                    res.warnings.append((stem, work, "fill default skipped on non-text column"))
            # stage 2: type
            if st.type_op == "date":
                if date_mode == "first_format":
                    fr.defer(work, "date", "first_format")
                else:
                    fr.apply(work, "date_per_value")
            elif st.type_op == "integer":
                fr.defer(work, "integer")
            elif st.type_op == "double":
                fr.apply(work, "double")
            elif st.type_op == "text":
                fr.apply(work, "text")
            # stage 3: case, stage 4: strip
            if st.case_op:
                fr.apply(work, st.case_op)
            if st.strip:
                fr.apply(work, "strip")
        fr.resolve()
        out = fr.current()
        pk = f"pk_{stem}_silver_id"
        order = key_order.get(stem) or ordinal_columns(out) or None
        out = add_surrogate_key(out, pk, order)
        # PR-04: approved targets + lineage (_*) + keys (pk_*), key first
        approved = {r.target_column for r in trs}
        keep = [c for c in out.columns if c in approved or c.startswith("_") or c.startswith("pk_")]
        keep = [pk] + [c for c in keep if c != pk]
        silver_name = stem[: -len("_bronze")] + "_silver" if stem.endswith("_bronze") else f"{stem}_silver"
        res.tables[silver_name] = out.select(*keep)
    return res


# ---------------------------------------------------------------------------
# RX-03 gold
# ---------------------------------------------------------------------------

def run_gold(sources: "OrderedDict[str, DataFrame]", rules: Sequence[Rule], match: str = "word",
             null_keys_match: bool = True, key_order: dict[str, list[str]] | None = None) -> LayerResult:
    """One gold table per target: join/union the sources, rename, group and
    aggregate, keep target columns, add ``pk_gold_id``.

    ``sources`` is keyed by the silver stem with ``_silver`` removed.
    """
    res = LayerResult()
    key_order = key_order or {}

    def cols_of(srcs):
        seen = []
        for s in srcs:
            for c in sources[s].columns:
                if c not in seen:
                    seen.append(c)
        return seen

    for plan in gold_plans(rules, list(sources), cols_of, match):
        frames = [sources[s] for s in plan.sources]
        df, pairs = sources_and_pairs(frames, null_keys_match=null_keys_match,
                                      warn=lambda keys, text, t=plan.target_table: res.warnings.append((t, keys, text)))
        res.tables[plan.target_table] = _gold_table(df, plan, res, key_order.get(plan.target_table), pairs)
    return res


def _gold_table(df: DataFrame, plan: GoldPlan, res: LayerResult, order: list[str] | None, pairs: NullPairs | None = None) -> DataFrame:
    # PR-02: one bulk rename; grouping keys and aggregates follow the new names
    renames = {s: t for s, t in plan.renames.items() if s in df.columns and t not in df.columns}
    if renames:
        df = df.withColumnsRenamed(renames)
        pairs = pairs and pairs.changed(lambda side: side.withColumnsRenamed(renames))
    group = [renames.get(c, c) for c in plan.group_by]
    group = [c for c in group if c in df.columns]
    aggs = []
    for src, fn, tgt in plan.aggs:
        col = renames.get(src, src)
        if col not in df.columns:
            continue
        if col in group:
            res.warnings.append((plan.target_table, col, f"aggregate '{fn}' ignored: column is a grouping key"))
            continue
        aggs.append((col, fn, tgt if tgt != src else col))
    grouped = False
    if group and aggs:
        df, errs = group_aggregate(df, group, aggs)
        for e in errs:
            res.warnings.append((plan.target_table,) + e)
        grouped = len(errs) < len(aggs)
        pairs = None
    elif aggs and not group:
        res.warnings.append((plan.target_table, "", "aggregate rules ignored: no grouping column"))
    # PR-05: keep target columns (+ _*, pk_*); if nothing matches keep all
    targets = set(plan.targets)
    keep = [c for c in df.columns if c in targets or c.startswith("_") or c.startswith("pk_")]
    if keep:
        df = df.select(*keep)
        pairs = pairs and pairs.changed(lambda side: side.select(*[c for c in keep if c in side.columns]))
    if order is None:
        # pandas order: sorted group keys with the null group last; else file order
        order = ([F.asc_nulls_last(f"`{c}`") for c in group] if grouped else
                 (ordinal_columns(df) or [c for c in df.columns if c.startswith("pk_")] or None))
    return add_surrogate_key(df, "pk_gold_id", order, pairs=pairs)


def warnings_frame(spark, layer: str, result: LayerResult):
    """QL-06 (ignored part): rule warnings of a layer run as a table
    (table, column, message) - renames refused, aggregates ignored (D19) or
    rejected (D21), defaults skipped (D18), rule columns not found (D29)."""
    rows = [(layer, t, c, m) for t, c, m in result.warnings]
    return spark.createDataFrame(rows, "layer string, table string, column string, message string")
