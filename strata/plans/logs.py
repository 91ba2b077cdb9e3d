"""Run-log analytics (LG-01..LG-04, WN-04, WN-05, SC-14..SC-16, FN-21..FN-28).

Audit events, traces and agent messages are tables like any other: they are
classified with built-in expressions and summarised with partial aggregates.
"""

from __future__ import annotations

import datetime as _dt
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import audit_line, fenced_json, status_class
from ..operators.stats import group_median
from ..sources.tables import row_counts

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    T.StructField("seq", T.LongType()),
])
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

TRACE_SCHEMA = T.StructType([
    T.StructField("agent", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("plan", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("duration_seconds", T.DoubleType()),
    T.StructField("tool_calls", T.ArrayType(T.StructType([
        T.StructField("tool", T.StringType()),
        T.StructField("args", T.MapType(T.StringType(), T.StringType()))]))),
    T.StructField("error", T.StringType()),
])


# --------------------------------------------------------------------------
# SC-14 audit log: append / scan
# --------------------------------------------------------------------------

class AuditLog:
    """Append-only audit events of one run, written as JSON lines by Spark.

    Events are buffered on the driver (a handful per layer and table) and
    appended in one write per ``flush``.
    """

    def __init__(self, spark: SparkSession, path: str, run_id: str):
        self.spark, self.path, self.run_id = spark, path, run_id
        self.buffer: list[tuple] = []
        self.seq = 0

    def log(self, agent: str, action: str, **extra) -> None:
        ts = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        self.seq += 1
        self.buffer.append((ts, self.run_id, agent, action,
                            {k: v if isinstance(v, str) else json.dumps(v, default=str) for k, v in extra.items()},
                            self.seq))

    def flush(self) -> None:
        if not self.buffer:
            return
        (self.spark.createDataFrame(self.buffer, AUDIT_SCHEMA).coalesce(1).write.mode("append")
         .option("timestampFormat", TS_FORMAT).json(self.path))
        self.buffer = []


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events; a missing log is an empty frame with the schema."""
    try:
        return spark.read.schema(AUDIT_SCHEMA).option("timestampFormat", TS_FORMAT).json(path)
    except Exception:  # noqa: BLE001 - path does not exist yet
        return spark.createDataFrame([], AUDIT_SCHEMA)


# --------------------------------------------------------------------------
# LG-01 audit trail, LG-02 fallback runs
# --------------------------------------------------------------------------

def audit_trail(audit: DataFrame) -> DataFrame:
    """LG-01 (FN-26, FN-27, WN-04): classified, formatted, newest first."""
    ex = F.col("extra")
    time_text, reason = audit_line(F.col("timestamp"), ex["rationale"], ex["decision_basis"], ex["detail"])
    phase = F.coalesce(F.when(ex["phase"] != "", ex["phase"]), F.lit("-"))
    status = F.coalesce(F.when(ex["status"] != "", ex["status"]), F.lit("-"))
    extra_cols = [c for c in audit.columns if c not in ("timestamp", "run_id", "agent", "action", "extra")]
    tie = [F.desc("seq")] if "seq" in audit.columns else [F.desc("action")]
    return (audit.select("timestamp", "run_id", "agent", "action", *extra_cols,
                         time_text.alias("time_text"), reason.alias("reason"),
                         phase.alias("phase"), status.alias("status"),
                         status_class(ex["status"], F.col("action")).alias("status_class"))
            .orderBy(F.desc("timestamp"), *tie))


def latest_per_run(audit: DataFrame) -> DataFrame:
    """WN-04: the latest event of each run (``max_by``: partial aggregate)."""
    order = F.struct("timestamp", "seq") if "seq" in audit.columns else F.col("timestamp")
    return audit.groupBy("run_id").agg(
        F.max("timestamp").alias("latest_at"),
        F.max_by(F.struct("agent", "action"), order).alias("latest"))


def fallback_runs(audit: DataFrame, status_col: str = "status") -> DataFrame:
    """LG-02: per run, whether the fallback path was seen (a status of
    ``fallback_report_ready`` or an action mentioning "fallback")."""
    st = F.col("extra")[status_col] if status_col not in audit.columns else F.col(status_col)
    seen = (F.coalesce(st, F.lit("")) == "fallback_report_ready") | F.lower(F.col("action")).contains("fallback")
    return audit.groupBy("run_id").agg(F.max(seen.cast("int")).cast("boolean").alias("fallback_seen"))


# --------------------------------------------------------------------------
# LG-03 traces
# --------------------------------------------------------------------------

def trace_tool_calls(traces: DataFrame) -> DataFrame:
    """LG-03 part 1: one row per tool call (``explode``)."""
    return traces.select("run_id", "agent", "status", F.posexplode_outer("tool_calls").alias("call_no", "call")) \
        .select("run_id", "agent", "status", "call_no", F.col("call.tool").alias("tool"))


def tool_sequence(traces: DataFrame) -> DataFrame:
    """SO-05: ordered distinct tool names of each trace."""
    return traces.select("run_id", "agent", F.array_distinct(F.col("tool_calls.tool")).alias("tools"))


def trace_durations(traces: DataFrame) -> DataFrame:
    """LG-03 part 2: per (agent, status): calls, exact median and max duration."""
    counts = traces.groupBy("agent", "status").agg(
        F.count(F.lit(1)).alias("calls"), F.max("duration_seconds").alias("max_seconds"))
    med = group_median(traces, ["agent", "status"], "duration_seconds", "median_seconds")
    return counts.join(med, ["agent", "status"], "left")


# --------------------------------------------------------------------------
# WN-05 / FN-22 last parsable payload of a conversation
# --------------------------------------------------------------------------

PAYLOAD_SCHEMA = "direct_answer string, charts string, detailed_analysis string"


def last_payload(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The payload of the last message (highest ``turn``) whose fenced JSON
    parses and has a ``direct_answer``; a partial aggregate. Of messages with
    one turn the payload with the largest values counts, in any run."""
    parsed = messages.select(conv, turn, F.from_json(fenced_json(F.col(text)), PAYLOAD_SCHEMA).alias("p"))
    ok = parsed.where(F.col("p.direct_answer").isNotNull())
    return ok.groupBy(conv).agg(F.max(F.struct(turn, "p")).alias("m")).select(
        conv, F.col(f"m.{turn}").alias(turn), "m.p.direct_answer", "m.p.charts", "m.p.detailed_analysis")


# --------------------------------------------------------------------------
# FN-21 answer normalisation over a table of raw answers
# --------------------------------------------------------------------------

# What stands for a missing part of an answer.
NO_ANSWER = "No answer provided"
NO_APPROACH = "No methodology provided"
NO_ANALYSIS = "No additional analysis provided."


def normalise_answers(raw: DataFrame, question: str, col: str = "payload") -> DataFrame:
    """FN-21: a raw JSON answer -> direct_answer struct (string or object
    accepted), charts kept only when objects, and the seven counters and flags
    of what was found: analysis_was_dict, direct_answer_was_dict,
    direct_answer_was_string, charts_input_count, charts_output_count,
    invalid_chart_specs_dropped, detailed_analysis_was_string. An absent
    direct answer counts as an empty object, an absent analysis as text.

    The payload is parsed once, into a VARIANT; everything else is a typed
    path of it. The parts are put in columns of their own first, so that no
    later expression repeats the parse."""
    parts = raw.select("*", F.try_parse_json(F.col(col)).alias("_v")).select("*", *[
        F.try_variant_get("_v", f"$.{name}", "variant").alias(f"_{name}") for name in ("direct_answer", "charts", "detailed_analysis")])

    def kind(part):  # STRING, BIGINT, ARRAY<...>, OBJECT<...>, ... or "" where there is none
        return F.coalesce(F.schema_of_variant(part), F.lit(""))
    parts = parts.select("*", *[kind(p).alias(f"{p}_kind") for p in ("_v", "_direct_answer", "_charts", "_detailed_analysis")])
    whole = F.col("_v_kind").startswith("OBJECT")
    is_obj, is_text = F.col("_direct_answer_kind").startswith("OBJECT"), F.col("_direct_answer_kind") == "STRING"

    def absent(name):
        return ~whole | (F.col(f"_{name}_kind") == "")

    def field(name, default):
        found = F.try_variant_get("_direct_answer", f"$.{name}", "string")
        return F.coalesce(F.when(found != "", found), F.lit(default))
    told = F.when(is_text, F.try_variant_get("_direct_answer", "$", "string"))
    direct = F.when(is_obj, F.struct(field("question", question).alias("question"), field("answer", NO_ANSWER).alias("answer"),
                                     field("why", "").alias("why"), field("approach", NO_APPROACH).alias("approach"))) \
        .otherwise(F.struct(F.lit(question).alias("question"), F.coalesce(F.when(told != "", told), F.lit(NO_ANSWER)).alias("answer"),
                            F.lit("").alias("why"), F.lit(NO_APPROACH).alias("approach")))
    # one chart may stand alone, without a list around it
    charts = F.when(F.col("_charts_kind").startswith("OBJECT"), F.array("_charts")).otherwise(F.try_variant_get("_charts", "$", "array<variant>"))
    objects = F.transform(F.filter(charts, lambda c: F.schema_of_variant(c).startswith("OBJECT")), lambda c: F.to_json(c))
    parts = parts.withColumns({"_given": F.coalesce(F.size(charts), F.lit(0)), "_objects": objects})
    kept = F.coalesce(F.size("_objects"), F.lit(0))
    analysis = F.col("_detailed_analysis_kind")
    text = F.when(analysis == "STRING", F.try_variant_get("_detailed_analysis", "$", "string")).when(
        ~analysis.isin("", "VOID"), F.to_json("_detailed_analysis"))
    return parts.select(
        *[F.col(f"`{c}`") for c in raw.columns],
        whole.alias("analysis_was_dict"),
        (is_obj | absent("direct_answer")).alias("direct_answer_was_dict"),
        is_text.alias("direct_answer_was_string"),
        ((analysis == "STRING") | absent("detailed_analysis")).alias("detailed_analysis_was_string"),
        F.greatest(kept, F.lit(0)).alias("charts_output_count"),
        direct.alias("direct_answer"),
        F.coalesce("_objects", F.array().cast("array<string>")).alias("charts"),
        F.greatest("_given", F.lit(0)).alias("charts_input_count"),
        (F.greatest("_given", F.lit(0)) - F.greatest(kept, F.lit(0))).alias("invalid_chart_specs_dropped"),
        F.coalesce(text, F.lit(NO_ANALYSIS)).alias("detailed_analysis"))


def run_summary(spark: SparkSession, tables: Mapping[str, DataFrame], preview_columns: int = 8) -> DataFrame:
    """LG-04: rows, columns and the first column names of each input (the
    row counts of all inputs in one job)."""
    rows = []
    counts = row_counts(tables)
    for name, df in tables.items():
        cols = [c for c in df.columns if c not in ("_source_file", "_source_row")]
        rows.append((name, counts[name], len(cols), cols[:preview_columns]))
    return spark.createDataFrame(rows, "table string, rows long, columns int, column_preview array<string>")
