"""Text expressions over log and message tables (FN-14, FN-20..FN-28).

All are built-in Spark expressions (regex, JSON, string functions), so they
run inside whole-stage codegen on every executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error classes, tested in this order, and the message parts
# that select them (all tests on the lower-cased message unless noted).
ERROR_CLASSES = [
    ("tpd_hard_block", ["tokens per day", "(tpd)", "quota exhausted"]),
    ("request_too_large_shrink", ["request too large", "payload too large"]),
    ("tpm_window_retry", ["tokens per minute", "(tpm)"]),
    ("tool_schema_hard_block", ["tool_use_failed", "tool call validation failed",
                                "attempted to call tool", "failed_generation"]),
    ("context_length_hard_block", ["context_length_exceeded", "reduce the length of the messages",
                                   "reduce your message size", "request too large"]),
    ("rate_limit_other", ["rate limit", "rate_limit", "429", "tokens per"]),
]
ERROR_CLASS_DEFAULT = "other_transient"

# Audit status classes.
FAILED_STATUSES = ["failed", "error"]
SUCCESS_STATUSES = ["success", "completed"]
PROGRESS_STATUSES = ["in_progress", "started", "running"]


def name_tokens(c: Column) -> Column:
    """FN-14: distinct lower-case alphanumeric tokens of a text column."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: t != ""))


def token_estimate(c: Column) -> Column:
    """FN-25: max(1, len/4) for non-empty text, 0 for empty or null."""
    n = F.length(c)
    return (F.when(c.isNull() | (n == 0), F.lit(0).cast("long"))
            .otherwise(F.greatest(F.lit(1).cast("long"), F.floor(n / 4).cast("long"))))


def error_class(message: Column) -> Column:
    """FN-23: first matching class of ``ERROR_CLASSES``; "413" needs "tokens" too."""
    low = F.lower(message)
    expr = None
    for label, parts in ERROR_CLASSES:
        cond = None
        for p in parts:
            t = low.contains(p)
            cond = t if cond is None else (cond | t)
        if label == "request_too_large_shrink":
            cond = cond | (message.contains("413") & low.contains("tokens"))
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(ERROR_CLASS_DEFAULT)


# The message texts that FN-24 and FN-28 look for.
RETRY_SECONDS = r"try again in\s+([0-9]+(?:\.[0-9]+)?)s"
RETRY_MINUTES = r"try again in\s+([0-9]+)m([0-9]+(?:\.[0-9]+)?)s"
FAILED_GENERATION = r"(?is)failed_generation['\"]?\s*[:=]\s*['\"](.+?)['\"](?:[}\n]|$)"


def retry_after_seconds(message: Column) -> Column:
    """FN-24: "try again in 12.5s" -> 12.5, "try again in 14m29.1s" -> 869.1."""
    low = F.lower(message)
    secs = F.regexp_extract(low, RETRY_SECONDS, 1)
    mins = F.regexp_extract(low, RETRY_MINUTES, 1)
    msec = F.regexp_extract(low, RETRY_MINUTES, 2)
    return (F.when(secs != "", secs.cast("double"))
            .when(mins != "", mins.cast("double") * 60 + msec.cast("double")))


def failed_generation(message: Column) -> Column:
    """FN-28: the quoted failed-generation text (≤500 chars), else the 500
    characters from the marker on, else ""."""
    quoted = F.regexp_extract(message, FAILED_GENERATION, 1)
    pos = F.instr(F.lower(message), "failed_generation")
    return (F.when(quoted != "", F.substring(quoted, 1, 500))
            .when(pos > 0, message.substr(pos, F.lit(500)))
            .otherwise(F.lit("")))


def status_class(status: Column, action: Column) -> Column:
    """FN-26: failed / success / progress / neutral."""
    s = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    a = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    return (F.when(s.isin(FAILED_STATUSES) | a.contains("failed") | a.contains("error"), "is-failed")
            .when(s.isin(SUCCESS_STATUSES), "is-success")
            .when(s.isin(PROGRESS_STATUSES), "is-progress")
            .otherwise("is-neutral"))


def _blank_to_null(c: Column) -> Column:
    return F.when(c == "", None).otherwise(c)


def audit_line(timestamp: Column, rationale: Column, decision_basis: Column, detail: Column) -> tuple[Column, Column]:
    """FN-27: (time text = characters 12..19 of the timestamp text or
    "--:--:--", reason = first non-empty of rationale, decision_basis, detail)."""
    ts = timestamp.cast("string")
    time_text = F.when(F.length(ts) >= 19, F.substring(ts, 12, 8)).otherwise(F.lit("--:--:--"))
    reason = F.coalesce(_blank_to_null(rationale), _blank_to_null(decision_basis),
                        _blank_to_null(detail), F.lit("No rationale captured"))
    return time_text, reason


def fenced_json(text: Column) -> Column:
    """FN-22: the JSON object inside a ```json fence (else a plain fence, else
    the text), cut from the first "{" to the last "}"; null if none."""
    fenced = F.regexp_extract(text, r"(?s)```json(.*?)(```|$)", 1)
    plain = F.regexp_extract(text, r"(?s)```(.*?)(```|$)", 1)
    body = (F.when(F.instr(text, "```json") > 0, fenced)
            .when(F.instr(text, "```") > 0, plain).otherwise(text))
    start = F.instr(body, "{")
    # last "{...}" end: position of the last "}" = len - instr(reverse, "}") + 1
    end = F.length(body) - F.instr(F.reverse(body), "}") + 1
    return F.when((start > 0) & (F.instr(body, "}") > 0) & (end >= start),
                  body.substr(start, end - start + 1)).otherwise(F.lit(None))


def answer_sentence(table: str, value: Column, group: Column | None = None) -> Column:
    """FN-20: the answer sentence with thousands separators and 2 decimals
    (``format_number``), for a top group or a single value."""
    head = F.lit(f"Deterministic intent analysis completed using {table}.")
    num = F.format_number(value.cast("double"), 2)
    if group is not None:
        return F.concat(head, F.lit(" Top segment: "), group.cast("string"), F.lit(" with value "), num, F.lit("."))
    return F.concat(head, F.lit(" Computed value: "), num, F.lit("."))
