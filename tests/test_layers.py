"""Bronze / silver / gold execution, after the reference's unit tests plus the
cases they leave out (outer join, every aggregate, D9, D19)."""
import os
from collections import OrderedDict

import pytest

from strata.plans.layers import run_bronze, run_gold, run_silver
from strata.plans.rules import Rule
from strata.session import ensure_checkpoint_dir


def test_bronze_lineage_rename_and_counts(spark):
    a = spark.createDataFrame([(i, i * 10) for i in range(50)], "id long, value long")
    b = spark.createDataFrame([(1,)], "old_name long")
    rules = [Rule(source_table="b", source_column="old_name", target_column="new_name",
                  transformation_logic="Direct pass-through; preserve integer type")]
    res = run_bronze(OrderedDict(a=a, b=b), rules)
    assert list(res.tables) == ["a_bronze", "b_bronze"]
    ab = res.tables["a_bronze"]
    assert ab.count() == 50
    assert {"_load_timestamp", "_source_file"} <= set(ab.columns)
    assert "new_name" in res.tables["b_bronze"].columns


def test_bronze_blank_source_table_applies_to_all(spark):
    a = spark.createDataFrame([("1",)], "id string")
    b = spark.createDataFrame([("2",)], "id string")
    rules = [Rule(source_table="", source_column="id", target_column="id", transformation_logic="integer")]
    res = run_bronze(OrderedDict(a=a, b=b), rules)
    for t in res.tables.values():
        assert t.schema["id"].dataType.simpleString() == "bigint"


def test_silver_dedup_and_rename(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 6.0)], "id long, value double")
    rules = [Rule(source_table="s_bronze", source_column="", transformation_logic="Deduplicate rows"),
             Rule(source_table="s_bronze", source_column="id", target_column="id"),
             Rule(source_table="s_bronze", source_column="value", target_column="amount")]
    out = run_silver(OrderedDict(s_bronze=df), rules, key_order={"s_bronze": ["id"]}).tables["s_silver"]
    assert out.columns == ["pk_s_bronze_silver_id", "id", "amount"]
    assert out.count() == 2


def test_silver_drops_unapproved_columns(spark):
    df = spark.createDataFrame([(1, 2, "m")], "keep long, other long, _meta string")
    rules = [Rule(source_table="t_bronze", source_column="keep", target_column="keep")]
    out = run_silver(OrderedDict(t_bronze=df), rules).tables["t_silver"]
    assert out.columns == ["pk_t_bronze_silver_id", "keep", "_meta"]


def _g(src, col, table, tgt=None, ttype="Direct", logic=""):
    return Rule(source_table=f"{src}_silver", source_column=col, target_table=table,
                target_column=tgt or col, transformation_type=ttype, transformation_logic=logic)


def test_gold_two_targets_and_subset(spark):
    df = spark.createDataFrame([(1, 100.0, 50.0), (2, 200.0, 80.0)], "id long, revenue double, cost double")
    rules = [_g("f", "id", "t1"), _g("f", "revenue", "t1", ttype="Indirect"),
             _g("f", "cost", "t2", ttype="Indirect")]
    res = run_gold(OrderedDict(f=df), rules).tables
    assert list(res) == ["t1", "t2"]
    assert res["t1"].columns == ["pk_gold_id", "id", "revenue"]
    assert res["t2"].columns == ["pk_gold_id", "cost"]


@pytest.mark.parametrize("fn,expected", [("sum", 30.0), ("average", 15.0), ("count", 2), ("max", 20.0),
                                         ("min", 10.0)])
def test_gold_every_aggregate(spark, fn, expected):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", None)], "g string, v double")
    rules = [_g("f", "g", "t"), _g("f", "v", "t", "out", "Aggregation", f"{fn} of v")]
    out = {r.g: r.out for r in run_gold(OrderedDict(f=df), rules).tables["t"].collect()}
    assert out["a"] == expected
    if fn == "sum":
        assert out["b"] == 0.0            # D9: sum of an all-null group is 0


def test_gold_null_group_kept_last(spark):
    df = spark.createDataFrame([(None, 1.0), ("b", 2.0), ("a", 3.0)], "g string, v double")
    rules = [_g("f", "g", "t"), _g("f", "v", "t", "v", "Aggregation", "sum")]
    out = run_gold(OrderedDict(f=df), rules).tables["t"].orderBy("pk_gold_id").collect()
    assert [r.g for r in out] == ["a", "b", None]


def test_gold_aggregate_on_group_key_warns_d19(spark):
    df = spark.createDataFrame([("a", 1.0)], "g string, v double")
    rules = [_g("f", "g", "t"), _g("f", "v", "t", ttype="Direct", logic="sum of v")]
    res = run_gold(OrderedDict(f=df), rules)
    assert any("grouping key" in w[2] for w in res.warnings)


def test_gold_sum_on_text_rejected_d21(spark):
    df = spark.createDataFrame([("a", "x")], "g string, t string")
    rules = [_g("f", "g", "t1"), _g("f", "t", "t1", "t", "Aggregation", "sum")]
    res = run_gold(OrderedDict(f=df), rules)
    assert any("not numeric" in w[2] for w in res.warnings)


def test_gold_outer_join_of_sources(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "store_id long, name string")
    b = spark.createDataFrame([(1, 5.0), (3, 7.0)], "store_id long, amount double")
    rules = [_g("a", "store_id", "t"), _g("a", "name", "t", ttype="Indirect"),
             _g("b", "amount", "t", ttype="Indirect")]
    out = run_gold(OrderedDict(a=a, b=b), rules).tables["t"]
    assert sorted((r.store_id, r.name, r.amount) for r in out.collect()) == [
        (1, "x", 5.0), (2, "y", None), (3, None, 7.0)]


def test_gold_several_aggregates_per_source_d20(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "g string, v double")
    rules = [_g("f", "g", "t"), _g("f", "v", "t", "v_sum", "Aggregation", "sum"),
             _g("f", "v", "t", "v_max", "Aggregation", "max")]
    r = run_gold(OrderedDict(f=df), rules).tables["t"].first()
    assert (r.v_sum, r.v_max) == (4.0, 3.0)


def test_silver_unmatched_rules_keep_only_keys_d29(spark):
    df = spark.createDataFrame([(1, "x")], "id long, _meta string")
    rules = [Rule(source_table="other_bronze", source_column="id", target_column="id")]
    out = run_silver(OrderedDict(t_bronze=df), rules).tables["t_silver"]
    assert out.columns == ["pk_t_bronze_silver_id", "_meta"]


def test_silver_statistics_after_dedup_read_staged_table(spark):
    """A dedup shuffle is written once before the fill statistics run; the
    statistics see the de-duplicated rows, and the final plan reads the
    staged table instead of re-running the dedup aggregate."""
    rows = [(1, 10.0, 1.0), (1, 99.0, 5.0), (2, None, 2.0), (3, 30.0, None), (4, 40.0, 4.0), (4, 0.0, 0.0)]
    src = spark.createDataFrame([(k, v, w, i) for i, (k, v, w) in enumerate(rows)],
                                "k long, v double, w double, _source_row long")
    rules = [Rule(source_table="t_bronze", source_column="k", target_column="k", transformation_logic="deduplicate"),
             Rule(source_table="t_bronze", source_column="v", target_column="v",
                  transformation_logic="fill null with mean"),
             Rule(source_table="t_bronze", source_column="w", target_column="w",
                  transformation_logic="fill null with median")]
    ckpt = ensure_checkpoint_dir(spark)
    before = len([p for p in os.listdir(ckpt.replace("file:", "")) if p.startswith("silver-")])
    out = run_silver(OrderedDict(t_bronze=src), rules).tables["t_silver"]
    got = {r.k: (r.v, r.w) for r in out.collect()}
    # kept rows (first per k): (1,10,1) (2,None,2) (3,30,None) (4,40,4): mean v = 80/3, median w = 2
    assert got == {1: (10.0, 1.0), 2: (80.0 / 3, 2.0), 3: (30.0, 2.0), 4: (40.0, 4.0)}
    staged = [p for p in os.listdir(ckpt.replace("file:", "")) if p.startswith("silver-")]
    assert len(staged) == before + 1
