"""Reruns under one run id: what changed is rebuilt, nothing else, and the
result is that of a full run."""

import os

import pytest
from pyspark.sql import functions as F

from strata.operators.keys import ORDINAL_COLUMNS
from strata.operators.profile import profile
from strata.operators.profile_state import state_profile
from strata.plans.pipeline import run_pipeline
from strata.sources.manifest import changes, input_files
from strata.sources.tables import json_parts, read_many, read_parquet


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def rows(spark, path, drop=("_load_timestamp",)):
    df = spark.read.parquet(path)
    return sorted((str(sorted(r.asDict().items())) for r in df.drop(*drop, "_part").collect()))


@pytest.fixture()
def folder(tmp_path):
    base = str(tmp_path / "in" / "sales.csv")
    write(f"{base}/a.csv", "store_id,amount,qty\ns1,10.5,1\ns2,20,2\n")
    write(f"{base}/b.csv", "store_id,amount,qty\ns1,5,3\n")
    stores = str(tmp_path / "in" / "stores.csv")
    write(stores, "store_id,town\ns1,York\ns2,Bath\n")
    return [base, stores], base, str(tmp_path)


def full(spark, inputs, tmp, n):
    root = f"{tmp}/full{n}"
    return run_pipeline(spark, inputs, "total amount by store", root, "r")


def same(spark, one, two):
    for layer in ("bronze", "silver", "gold"):
        assert set(one.outputs[layer]) == set(two.outputs[layer])
        for t in one.outputs[layer]:
            assert rows(spark, one.outputs[layer][t]) == rows(spark, two.outputs[layer][t]), (layer, t)
    assert sorted(map(str, one.answer.df.collect())) == sorted(map(str, two.answer.df.collect()))
    for layer in ("bronze", "silver", "gold"):
        a, b = ({r.file_path: (r.row_count, r.duplicate_row_count, str(r.null_pct_by_column)) for r in x.quality[layer][0].collect()} for x in (one, two))
        assert a == b


def test_added_changed_and_removed_files(spark, folder):
    inputs, base, tmp = folder
    root = f"{tmp}/out"

    def run():
        return run_pipeline(spark, inputs, "total amount by store", root, "r")
    first = run()
    assert first.skipped == [] and first.rebuilt["bronze"] == ["sales_bronze", "stores_bronze"]
    again = run()
    assert again.skipped == ["bronze", "silver", "gold"] and again.parts == {}

    def part_files():
        top = f"{root}/bronze/r/sales_bronze"
        return {(d, f) for d, _, fs in os.walk(top) for f in fs if f.startswith("part-")}
    before = part_files()
    write(f"{base}/c.csv", "store_id,amount,qty\ns3,1,4\ns3,,5\n")
    added = run()
    assert before <= part_files() and len(part_files()) == len(before) + 1  # kept parts keep their files
    assert added.rebuilt["bronze"] == ["sales_bronze"] and len(added.parts["sales_bronze"]) == 1
    assert "stores_silver" not in added.rebuilt["silver"] and "stores_gold" not in added.rebuilt["gold"]

    write(f"{base}/b.csv", "store_id,amount,qty\ns1,6,3\ns4,8,9\n")
    os.utime(f"{base}/b.csv", (1_900_000_000, 1_900_000_000))
    same(spark, run(), full(spark, inputs, tmp, 2))
    write(f"{base}/d.csv", "store_id,amount,qty\ns7,2,2\n")
    os.rename(f"{base}/a.csv", f"{tmp}/moved")
    gone = run()
    assert gone.rebuilt["bronze"] == ["sales_bronze"]
    same(spark, gone, full(spark, inputs, tmp, 3))


def test_a_new_file_that_changes_a_column_rebuilds_the_table(spark, folder):
    inputs, base, tmp = folder
    root = f"{tmp}/out"
    run_pipeline(spark, inputs, "total amount by store", root, "r")
    write(f"{base}/c.csv", "store_id,amount,qty\ns3,1,many\n")  # qty is text now
    res = run_pipeline(spark, inputs, "total amount by store", root, "r")
    assert dict(spark.read.parquet(res.outputs["bronze"]["sales_bronze"]).dtypes)["qty"] == "string"
    same(spark, res, full(spark, inputs, tmp, 1))


def test_changed_rules_rebuild_their_table(spark, folder):
    inputs, base, tmp = folder
    root = f"{tmp}/out"

    def hook(layer, rules):
        if layer != "silver":
            return rules
        return rules.withColumn("transformation_logic", F.when(F.col("source_column") == "town", F.lit("Convert to text; uppercase"))
                                .otherwise(F.col("transformation_logic")))
    run_pipeline(spark, inputs, "", root, "r")
    res = run_pipeline(spark, inputs, "", root, "r", rules_hook=hook)
    assert res.rebuilt == {"bronze": [], "silver": ["stores_silver"], "gold": ["stores_gold"]}
    assert {r.town for r in spark.read.parquet(res.outputs["gold"]["stores_gold"]).collect()} == {"YORK", "BATH"}


def test_whole_number_decision_of_all_files(spark, tmp_path):
    from strata.plans.incremental import Tracked, update_bronze
    from strata.plans.rules import Rule
    path, state = str(tmp_path / "t.parquet"), str(tmp_path / "state")
    rules = [Rule(source_table="t", source_column="x", target_column="x", transformation_logic="Type cast to integer")]

    def run():
        t = Tracked.open(spark, "t", path, state)
        b = update_bronze(t, rules, "t.parquet", str(tmp_path / "bronze"))
        t.state.record()
        return b, sorted(r.x for r in b.read(spark).collect())
    spark.createDataFrame([("1",), ("2",)], "x string").coalesce(1).write.parquet(path)
    built, got = run()
    assert got == [1, 2] and dict(built.read(spark).dtypes)["x"] == "bigint"
    spark.createDataFrame([("3",)], "x string").coalesce(1).write.mode("append").parquet(path)
    built, got = run()
    assert got == [1, 2, 3] and len(built.parts) == 1
    spark.createDataFrame([("4.5",)], "x string").coalesce(1).write.mode("append").parquet(path)
    built, got = run()
    assert got == ["1", "2", "3", "4.5"] and built.parts == []  # all of it anew, as text
    assert run()[0].rebuilt is False


def test_an_interrupted_run_does_its_work_again(spark, folder, monkeypatch):
    inputs, base, tmp = folder
    root = f"{tmp}/out"
    run_pipeline(spark, inputs, "", root, "r")
    write(f"{base}/c.csv", "store_id,amount,qty\ns9,3,4\n")
    from strata.plans import pipeline
    with monkeypatch.context() as m:
        m.setattr(pipeline, "run_silver", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            run_pipeline(spark, inputs, "", root, "r")
    res = run_pipeline(spark, inputs, "total amount by store", root, "r")
    same(spark, res, full(spark, inputs, tmp, 1))


def test_file_changes(spark, tmp_path):
    for name in ("a", "b", "c d"):
        write(str(tmp_path / "f" / f"{name}.csv"), "x\n1\n")
    files = input_files(spark, str(tmp_path / "f"))
    a, b, c = sorted(files)
    assert c.endswith("c%20d.csv") and files[a][0] == 4
    old = {a: files[a], b: [files[b][0] + 1, files[b][1]], "gone": [1, 1]}
    assert changes(old, files) == {a: "same", b: "changed", c: "added", "gone": "removed"}


def test_states_give_the_profile(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "a", True, "x" * 100), (2, float("nan"), None, None, "y"), (None, -0.0, "b", False, None),
                                (2, 0.0, "a", True, "x" * 100)], "i int, d double, s string, f boolean, l string")
    df = df.withColumn("ts", F.lit("2024-01-02 03:04:05").cast("timestamp")).withColumn("arr", F.array("i")).withColumn("dec", F.col("i").cast("decimal(9,2)"))
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    t = read_parquet(spark, str(tmp_path / "t"))
    want, want_lov = profile({"t": t})
    got, got_lov = state_profile(t, "t")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    lov = sorted((r.column, r.value, r.freq) for r in want_lov.collect())
    assert sorted((r.column, r.value, r.freq) for r in got_lov.collect()) == lov


def test_json_rejects(spark, tmp_path):
    path = str(tmp_path / "t.json")
    write(path, '{"a": 1, "_corrupt_record": "data"}\n{"a": 2, "b": \n\n[1, 2\n{"a": 3}\n')
    kept, bad = json_parts(spark, path)
    assert sorted(kept.drop(*ORDINAL_COLUMNS).columns) == ["_corrupt_record", "a"]
    assert sorted((r.a, r._corrupt_record) for r in kept.collect()) == [(1, "data"), (3, None)]
    assert sorted(r._corrupt_record for r in bad.collect()) == ["[1, 2", '{"a": 2, "b": ']
    write(path, '[{"a": 1},\n {"a": 2}]')
    kept, bad = json_parts(spark, path)
    assert [r.a for r in kept.collect()] == [1, 2] and bad.count() == 0
    write(path, '{"a": 1}\n{oops\n')
    rejected = {}
    tables, errors = read_many(spark, [path], rejected=rejected)
    assert tables["t"].count() == 1 and rejected["t"].count() == 1 and not errors
