"""Rule parser on the reference's real rule texts, keyword modes (D16),
headers (SC-08), approval (PR-12), and run-log functions (FN-22..28, SC-14)."""
import os
import tempfile

from pyspark.sql import functions as F

from strata.functions import text as TX
from strata.plans import logs as LG
from strata.plans.rules import (Rule, aggregate_keyword, approved, canonical_headers, has_phrase, parse_bronze,
                                parse_silver)


def test_parse_real_rule_texts():
    def s(logic):
        st = parse_silver(Rule(source_column="c", target_column="c", transformation_logic=logic))
        return (st.null_op, st.type_op, st.case_op, st.strip)
    assert s("Type cast to text for id column; strip whitespace") == ("", "text", "", True)
    assert s("Date standardisation to YYYY-MM-DD") == ("", "date", "", False)
    assert s("Convert to float numeric") == ("", "double", "", False)
    assert s("Fill null with mode; date standardisation to YYYY-MM-DD") == ("mode", "date", "", False)
    assert s("Fill null with median; convert to float numeric") == ("median", "double", "", False)
    assert s("Fill null default value; convert to text; lowercase; strip whitespace") == (
        "default", "text", "lower", True)
    assert parse_bronze(Rule(target_column="_load_timestamp")).kind == "load_ts"
    assert parse_bronze(Rule(source_column="x", target_column="x",
                             transformation_logic="Direct pass-through; preserve integer type")).cast == "integer"


def test_keyword_word_vs_substring_d16():
    assert has_phrase("consumer segment", "sum", "substring")
    assert not has_phrase("consumer segment", "sum")
    assert aggregate_keyword("discount rate") == ""
    assert aggregate_keyword("discount rate", "substring") == "count"
    assert has_phrase("Deduplicate on key", "deduplic")


def test_headers_and_approval(spark):
    df = spark.createDataFrame([("t", "a", "x", None)], "`Source Table` string, `source column` string, logic string, approved string")
    c = canonical_headers(df)
    assert c.columns[:8][1] == "source_table" and c.first().transformation_logic == "x"
    r = spark.createDataFrame([("a", "true"), ("b", "false"), ("c", None)], "source_column string, approved string")
    assert sorted(x.source_column for x in approved(r).collect()) == ["a", "c"]


def test_error_classes_and_tokens(spark):
    msgs = ["tokens per day limit (TPD)", "Request too large", "429 Too Many", "tool_use_failed",
            "context_length_exceeded", "rate_limit hit; Please try again in 14m29.1s", "boom", ""]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    out = df.select(TX.error_class(F.col("m")).alias("c"), TX.retry_after_seconds(F.col("m")).alias("r"),
                    TX.token_estimate(F.col("m")).alias("t")).collect()
    assert [o.c for o in out] == ["tpd_hard_block", "request_too_large_shrink", "rate_limit_other",
                                  "tool_schema_hard_block", "context_length_hard_block", "rate_limit_other",
                                  "other_transient", "other_transient"]
    assert round(out[5].r, 1) == 869.1 and out[7].t == 0 and out[6].t == 1


def test_last_payload_wins(spark):
    rows = [(1, 0, 'x ```json\n{"direct_answer": "first"}\n```'), (1, 1, "no json"),
            (1, 2, '```json {"direct_answer": "second"} ```'), (1, 3, "```json {broken")]
    out = LG.last_payload(spark.createDataFrame(rows, "conv_id long, turn long, text string")).first()
    assert (out.turn, out.direct_answer) == (2, "second")


def test_audit_append_read_missing(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="strata-audit-"), "a")
    assert LG.read_audit(spark, path).count() == 0
    log = LG.AuditLog(spark, path, "run-1")
    log.log("bronze_agent", "started", rationale="go")
    log.log("bronze_agent", "completed", status="success")
    log.flush()
    trail = LG.audit_trail(LG.read_audit(spark, path)).collect()
    assert [t.action for t in trail] == ["completed", "started"]
    assert trail[0].status_class == "is-success" and trail[1].reason == "go"


def test_traces(spark):
    from strata.plans.logs import TRACE_SCHEMA, trace_durations, trace_tool_calls, tool_sequence
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [("bronze_agent", "r1", "p", "success", t0, 1.0, [("read", {}), ("write", {}), ("read", {})], None),
            ("bronze_agent", "r2", "p", "success", t0, 3.0, [("read", {})], None),
            ("gold_agent", "r1", "p", "failed", t0, 10.0, [], "429")]
    tr = spark.createDataFrame(rows, TRACE_SCHEMA)
    assert trace_tool_calls(tr).where("tool is not null").count() == 4
    seq = {r.run_id + r.agent: r.tools for r in tool_sequence(tr).collect()}
    assert seq["r1bronze_agent"] == ["read", "write"]
    d = {(r.agent, r.status): (r.calls, r.median_seconds) for r in trace_durations(tr).collect()}
    assert d[("bronze_agent", "success")] == (2, 2.0) and d[("gold_agent", "failed")] == (1, 10.0)
