"""Plan lint of the corpus queries: no cross or nested-loop joins anywhere, no
Python in the native operators and stages."""
import contextlib
import io

import pytest

import corpus_pipeline
from strata.llm import registry

SF = "/root/testdata/sf0.001"
PYTHON = ("Python", "Pandas", "Arrow")


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode="formatted")
    return text.getvalue()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_no_cross_joins(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name.startswith(("op2_", "op5_")):
        assert not any(x in text for x in PYTHON)


def test_native_stages_run_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        if name in ("line_dedup", "mixing"):
            assert not any(x in plan(stage(spark, docs, SF)) for x in PYTHON)
