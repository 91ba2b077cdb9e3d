"""All fills of a table together: same values as one by one, few jobs."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import keys as K
from strata.operators.joins import combine_sources
from strata.operators.quality import duplicate_count
from strata.operators.stats import fill_values, mean_value, median_value, mode_value
from strata.plans.layers import run_silver
from strata.plans.rules import Rule


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.random() * 100]), rng.choice([None, 1, 2, 2, 7]), rng.choice([None, "a", "b", "b"]), None,
             5.0 if rng.random() < 0.4 else rng.gauss(0, 1)) for i in range(3001)]
    return spark.createDataFrame(rows, "k long, x double, n int, t string, e double, hot double")


def test_values_agree_with_single_statistics(numbers):
    for op, single in (("mean", mean_value), ("median", median_value), ("mode", mode_value)):
        cols = ["x", "n", "e", "hot"] + (["t"] if op == "mode" else [])
        want = {c: single(numbers, c) for c in cols}
        got = fill_values(numbers, dict.fromkeys(cols, op))
        assert got == pytest.approx(want) if op != "mode" else got == want
    assert fill_values(numbers, {"x": "median", "n": "median"}, limit=3) == {c: median_value(numbers, c) for c in ("x", "n")}
    assert fill_values(numbers.limit(0), {"x": "mean", "n": "median", "t": "mode"}) == {"x": None, "n": None, "t": None}


def test_job_count_does_not_depend_on_columns(spark, numbers):
    def jobs(n):
        df = numbers.select("k", *[F.col("x").alias(f"c{i}") for i in range(n)])
        rules = [Rule(source_table="t_bronze", source_column=f"c{i}", target_column=f"c{i}",
                      transformation_logic="Fill null with median; convert to float numeric") for i in range(n)]
        group = f"fills-{n}"
        spark.sparkContext.setJobGroup(group, group)
        out = run_silver({"t_bronze": df}, rules, key_order={"t_bronze": ["k"]}).tables["t_silver"]
        ids = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert out.where("c0 is null").count() == 0
        return len(ids)
    assert jobs(8) == jobs(1)


def test_steps_wait_for_their_fill(spark):
    df = spark.createDataFrame([(1, " A "), (2, " A "), (3, None), (4, "b")], "k long, t string")
    rules = [Rule(source_table="t_bronze", source_column="t", target_column="t", transformation_logic="Fill null with mode; lowercase; strip whitespace")]
    assert sorted(r.t for r in run_silver({"t_bronze": df}, rules, key_order={"t_bronze": ["k"]}).tables["t_silver"].collect()) == ["a", "a", "a", "b"]


def test_dense_keys_need_no_sort(spark, tmp_path):
    for name, n in (("b", 5), ("a", 3)):
        spark.range(n).coalesce(1).write.parquet(f"{tmp_path}/d/{name}")
    df = spark.read.parquet(f"{tmp_path}/d/a", f"{tmp_path}/d/b").select(
        "id", F.col("_metadata.file_path").alias(K.SOURCE_FILE), F.col("_metadata.row_index").alias(K.SOURCE_ROW))
    out = K.add_surrogate_key(df, "pk")
    assert "rangepartitioning" not in out._jdf.queryExecution().toString()
    by_file = sorted((r[K.SOURCE_FILE], r[K.SOURCE_ROW], r.pk) for r in out.collect())
    assert [pk for *_, pk in by_file] == list(range(1, 9))
    for gaps in (df.where("id <> 1"), df.unionAll(df), df.limit(0), df.withColumn(K.SOURCE_ROW, F.when(F.col("id") > 0, F.col(K.SOURCE_ROW)))):
        assert sorted(r.pk for r in K.add_surrogate_key(gaps, "pk").collect()) == list(range(1, gaps.count() + 1))


def test_null_keys_meet_and_are_reported(spark):
    left = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c"), (2, "d")], "k_id long, x string")
    right = spark.createDataFrame([(None, 1), (None, 2), (None, 3), (1, 4), (5, 5)], "k_id long, y int")
    out = [(r.k_id, r.x, r.y) for r in combine_sources([left, right]).collect()]
    want = [(None, x, y) for x in "ab" for y in (1, 2, 3)] + [(1, "c", 4), (2, "d", None), (5, None, 5)]
    assert sorted(out, key=str) == sorted(want, key=str)
    told = []
    combine_sources([left, right], warn=lambda *x: told.append(x))
    assert told == [("k_id", "2 and 3 rows without a key match each other: 6 rows")]
    alone = combine_sources([left.where("k_id is not null"), right])
    assert sorted(r.y for r in alone.collect() if r.k_id is None) == [1, 2, 3]


def test_duplicate_count_with_and_without_candidates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (2, None), (3, "c")], "k long, t string")
    assert duplicate_count(df) == 3 and duplicate_count(df.distinct()) == 0
