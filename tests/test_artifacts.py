"""Artifacts (SC-07..SC-18) and review helpers (PR-06, PR-13, PR-16, PR-17, FN-20)."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from strata.functions.text import answer_sentence
from strata.plans.rules import (Rule, approved_preview, collect_rules, rules_frame, rules_preview, selection_guard,
                                table_preview)
from strata.sources import artifacts as A


def test_rules_roundtrip(spark):
    rules = rules_frame(spark, [Rule(source_table="t", source_column=f"c{i}", target_table="x" if i < 3 else "y",
                                     target_column=f"c{i}") for i in range(5)])
    path = os.path.join(tempfile.mkdtemp(prefix="strata-rules-"), "r")
    A.write_rules(rules, path)
    back = A.read_rules(spark, path)
    assert [r.source_column for r in collect_rules(back)] == [f"c{i}" for i in range(5)]
    assert A.rules_valid(back) and not A.rules_valid(back.limit(0))
    assert rules_preview(back, total=10, per_target=2).count() == 4
    with pytest.raises(ValueError):
        selection_guard(back.limit(0))


def test_json_artifacts_and_answer(spark):
    root = tempfile.mkdtemp(prefix="strata-art-")
    ans = A.answer_frame(spark, "r1", "q", "a", "w", "ap", [{"type": "bar", "x_column": "x"}], "d")
    A.write_json(ans, os.path.join(root, "answer"))
    back = A.read_json(spark, os.path.join(root, "answer"), ans.schema).first()
    assert back.direct_answer.answer == "a" and back.charts[0].type == "bar"
    assert A.read_json(spark, os.path.join(root, "missing"), ans.schema).count() == 0


def test_previews_and_sentence(spark):
    df = spark.createDataFrame([(1, 2, "m")], "approved_col long, dropped_col long, _meta string")
    prev = approved_preview(df, [Rule(target_column="approved_col")])
    assert prev.columns == ["approved_col", "_meta"]
    p = table_preview("t", df)
    assert p["row_count"] == 1 and p["sample_rows"][0]["approved_col"] == 1
    s = spark.createDataFrame([("West", 1234567.891)], "g string, v double").select(
        answer_sentence("sales", F.col("v"), F.col("g")).alias("s")).first().s
    assert s.endswith("Top segment: West with value 1,234,567.89.")
