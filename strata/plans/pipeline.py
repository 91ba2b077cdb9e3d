"""The full run (RX-04 profile, RX-06 phases): profile -> bronze rules ->
bronze -> silver rules -> silver -> gold rules -> gold -> answer, with a
quality report per layer.

Each layer is written to ``{root}/{layer}/{run_id}/{table}`` and read back
by the next phase, so every phase starts from durable files (lineage is cut
at each layer and a lost executor only re-runs the current phase). A rerun
under the same run id rebuilds what changed since (``plans.incremental``): the
bronze parts of new, changed and removed input files, and the silver and gold
tables whose sources, rules or options differ.
"""

from __future__ import annotations

import contextvars
import os
from collections import OrderedDict
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..operators.quality import layer_report
from ..session import map_jobs, scratch
from ..sources import artifacts as ART
from ..sources.manifest import digest
from ..sources.tables import layer_path, table_names, write_table
from .answer import Answer, answer, answer_text
from .generate import bronze_rules, column_catalog, gold_rules, silver_rules
from .incremental import Built, Tracked, kept_table, note_table, profile_frames, update_bronze
from .layers import run_gold, run_silver
from .logs import AuditLog
from .rules import collect_rules, gold_plans, normalise_source_name, rules_for_table, selection_guard


@dataclass
class RunResult:
    run_id: str
    outputs: dict = field(default_factory=dict)       # layer -> {table: path}
    quality: dict = field(default_factory=dict)       # layer -> (files frame, summary)
    rules: dict = field(default_factory=dict)         # layer -> rule frame
    answer: Answer | None = None
    skipped: list = field(default_factory=list)       # layers in which nothing was rebuilt
    rebuilt: dict = field(default_factory=dict)       # layer -> tables that were
    parts: dict = field(default_factory=dict)         # bronze table -> input files' parts that were replaced


def _settled(rules: DataFrame) -> DataFrame:
    """The reviewed rule table computed once and kept as a local frame in rule
    order: it is written, checked and parsed afterwards, and it has one row per
    target column, so its size is bounded by the schema width, not the data."""
    rows = rules.collect()
    if "rule_no" in rules.columns:
        rows.sort(key=lambda r: r["rule_no"])
    return rules.sparkSession.createDataFrame(rows, rules.schema)


class Artifacts:
    """Small artifacts written beside the run's own jobs; ``finish`` waits for
    them, and an error of one is the run's."""

    def __init__(self, spark: SparkSession):
        self.spark, self.pool, self.jobs = spark, ThreadPoolExecutor(max_workers=2), []

    def write(self, fn, *args) -> None:
        target = inheritable_thread_target(self.spark)(fn)
        self.jobs.append(self.pool.submit(contextvars.copy_context().run, target, *args))

    def finish(self) -> None:
        self.pool.shutdown()
        for job in self.jobs:
            job.result()


def _finish_layer(spark: SparkSession, res: RunResult, audit: AuditLog, files: Artifacts, root: str, layer: str, built: Sequence[Built]) -> None:
    """Outputs, quality report and audit event of a layer. Tables that were
    kept bring the summary they were written with."""
    res.outputs[layer] = {b.name: b.path for b in built}
    res.rebuilt[layer] = [b.name for b in built if b.rebuilt]
    res.quality[layer] = layer_report(spark, layer, [b.summary for b in built], res.run_id)
    if not res.rebuilt[layer]:
        res.skipped.append(layer)
        return
    files.write(ART.write_json, res.quality[layer][0], ART.quality_paths(root, res.run_id)[layer])
    audit.log(f"{layer}_agent", "completed", outputs=res.outputs[layer], rebuilt=res.rebuilt[layer],
              warnings=[w for b in built for w in b.warnings])


def _reviewed(res: RunResult, files: Artifacts, root: str, layer: str, rules: DataFrame):
    """The reviewed rules of a layer, guarded and kept as an artifact."""
    settled = _settled(rules)
    res.rules[layer] = settled
    selection_guard(settled)
    files.write(ART.write_rules, settled, os.path.join(root, "rules", res.run_id, layer), True)
    return collect_rules(settled)


def run_pipeline(spark: SparkSession, inputs: Sequence[str], question: str, root: str, run_id: str,
                 rules_hook: Callable[[str, DataFrame], DataFrame] | None = None,
                 date_mode: str = "per_value", csv_multi_line: bool | None = None) -> RunResult:
    """RX-06. ``rules_hook(layer, rules)`` may edit/approve a rule frame
    before it runs (the review step). ``csv_multi_line`` says whether quoted
    CSV fields hold newlines (default: the text is scanned for them). CSV
    rows that don't fit their header are written to ``rejected/{run_id}``.
    What the run stages is deleted when it ends."""
    with scratch(spark):
        return _run(spark, inputs, question, root, run_id, rules_hook, date_mode, csv_multi_line)


def _run(spark: SparkSession, inputs: Sequence[str], question: str, root: str, run_id: str,
         rules_hook: Callable[[str, DataFrame], DataFrame] | None, date_mode: str, csv_multi_line: bool | None) -> RunResult:
    hook = rules_hook or (lambda layer, r: r)
    res = RunResult(run_id)
    files = Artifacts(spark)
    audit = AuditLog(spark, os.path.join(root, "audit", run_id), run_id)
    state = os.path.join(root, "state", run_id)
    tracked: "OrderedDict[str, Tracked]" = OrderedDict()
    unreadable: dict[str, str] = {}

    def opened(item):
        path, name = item
        try:
            return name, Tracked.open(spark, name, path, os.path.join(state, "inputs", name), csv_multi_line)
        except (PySparkException, ValueError, OSError) as exc:  # skip, record, go on
            return name, str(exc)
    for name, t in map_jobs(spark, opened, table_names(inputs).items()):
        if isinstance(t, Tracked):
            tracked[name] = t
        else:
            unreadable[name] = t
            audit.log("profiler", "skipped", table=name, error=t)
    if not tracked:
        raise ValueError(f"no readable input: {unreadable}")
    for name, t in tracked.items():
        n = t.rejected.count() if t.rejected is not None else 0
        if n:
            audit.log("profiler", "rejected", table=name, rows=n,
                      path=write_table(t.rejected, os.path.join(root, "rejected", run_id, name)))
    file_names = {name: os.path.basename(t.path.rstrip("/")) for name, t in tracked.items()}

    # RX-04 profile + RG-01
    found = map_jobs(spark, lambda t: t.profile(), tracked.values())
    prof, lists = profile_frames(spark, found)
    if any(t.changed() for t in tracked.values()):
        files.write(ART.write_json, prof, os.path.join(root, "profiles", run_id))
        files.write(ART.write_json, lists, os.path.join(root, "lovs", run_id))
    numbers = F.create_map(*[F.lit(x) for i, n in enumerate(tracked) for x in (n, i)])
    prof_n = prof.withColumn("dataset_no", numbers[F.col("dataset")])
    b_rules = _reviewed(res, files, root, "bronze", hook("bronze", bronze_rules(prof_n)))
    audit.log("profiler", "completed", tables=list(tracked))

    # bronze
    def bronze_table(t: Tracked) -> Built:
        own = rules_for_table(b_rules, file_names[t.name], t.name)
        return update_bronze(t, own, file_names[t.name], layer_path(root, "bronze", run_id, f"{t.name}_bronze"))
    b_built = map_jobs(spark, bronze_table, tracked.values())
    res.parts = {b.name: b.parts for b in b_built if b.rebuilt}
    _finish_layer(spark, res, audit, files, root, "bronze", b_built)
    bronze = OrderedDict((b.name, b.read(spark)) for b in b_built)

    # silver
    s_rules = _reviewed(res, files, root, "silver", hook("silver", silver_rules(
        column_catalog(spark, bronze, null_counts=res.quality["bronze"][1]["null_counts"]))))

    def silver_table(b: Built) -> Built:
        own = rules_for_table(s_rules, f"{b.name}.parquet", b.name)
        name = b.name[: -len("_bronze")] + "_silver"
        path, note = layer_path(root, "silver", run_id, name), os.path.join(state, "silver", f"{name}.json")
        stamp = digest(b.stamp, [r.__dict__ for r in own], date_mode)
        kept = kept_table(spark, name, path, note, stamp)
        if kept is not None:
            return kept
        made = run_silver(OrderedDict({b.name: bronze[b.name]}), own, date_mode=date_mode)
        df = made.tables[name]
        write_table(df, path)
        return note_table(spark, Built(name, path, stamp, df.schema, {}, True, warnings=made.warnings), note)
    s_built = map_jobs(spark, silver_table, b_built)
    _finish_layer(spark, res, audit, files, root, "silver", s_built)
    silver = OrderedDict((b.name, b.read(spark)) for b in s_built)

    # gold
    g_rules = _reviewed(res, files, root, "gold", hook("gold", gold_rules(column_catalog(spark, silver, with_nulls=False))))
    g_src = OrderedDict((normalise_source_name(n), df) for n, df in silver.items())
    stamps = {normalise_source_name(b.name): b.stamp for b in s_built}

    def gold_table(plan) -> Built:
        own = [r for r in g_rules if r.target_table.strip() == plan.target_table]
        path, note = layer_path(root, "gold", run_id, plan.target_table), os.path.join(state, "gold", f"{plan.target_table}.json")
        stamp = digest([stamps[s] for s in plan.sources], [r.__dict__ for r in own])
        kept = kept_table(spark, plan.target_table, path, note, stamp)
        if kept is not None:
            return kept
        made = run_gold(g_src, own)
        df = made.tables[plan.target_table]
        write_table(df, path)
        return note_table(spark, Built(plan.target_table, path, stamp, df.schema, {}, True, warnings=made.warnings), note)
    plans = gold_plans(g_rules, list(g_src), lambda srcs: [c for s in srcs for c in g_src[s].columns])
    # QL-05: the gold report is always there before the answer is written
    g_built = map_jobs(spark, gold_table, plans)
    _finish_layer(spark, res, audit, files, root, "gold", g_built)
    gold = OrderedDict((b.name, b.read(spark)) for b in g_built)

    # answer
    if gold and question:
        res.answer = answer(gold, question)
        res.answer.text = answer_text(res.answer, res.answer.df.first())
        files.write(ART.write_json, ART.answer_frame(spark, run_id, question, res.answer.text,
                                        "Deterministic intent parsing and aggregation.",
                                        f"op={res.answer.op} metric={res.answer.metric} group={res.answer.group_col}",
                                        res.answer.charts, res.answer.sql), os.path.join(root, "answers", run_id))
        audit.log("reporter", "completed", sql=res.answer.sql)
    files.write(audit.flush)
    files.finish()
    for t in tracked.values():
        t.state.record()
    return res
