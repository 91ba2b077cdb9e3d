"""Cases found by review: numbers, missing values, names, rejects, shapes."""

import pytest
from pyspark.sql import functions as F

from strata.functions import clean
from strata.plans import answer as AN
from strata.plans import generate as RG
from strata.plans import logs as LG
from strata.plans.layers import run_silver
from strata.plans.rules import Rule, canonical_headers
from strata.sources import tables as TB


def test_number_text_is_read_exactly(spark):
    text = ["9007199254740993", "1234567890123456789", "12F", "1D", "0x1p3", " 3 ", "1e3", "-7", "+.5", "abc", None]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    rows = df.select(clean.text_long(F.col("t")).alias("n"), clean.text_double(F.col("t")).alias("d")).collect()
    assert [r.n for r in rows] == [9007199254740993, 1234567890123456789, None, None, None, 3, 1000, -7, 0, None, None]
    assert [r.d for r in rows][2:] == [None, None, None, 3.0, 1000.0, -7.0, 0.5, None, None]


def test_seat_codes_stay_text(spark, tmp_path):
    (tmp_path / "s.csv").write_text("seat,n\n12F,1\n13F,2\n14D,3\n")
    df = TB.read_csv(spark, str(tmp_path / "s.csv"))
    assert [r.seat for r in df.collect()] == ["12F", "13F", "14D"] and dict(df.dtypes)["n"] == "bigint"


def test_mean_fill_widens_integers_and_sees_nan(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (2, 2, float("nan")), (3, None, 3.0)], "k long, q long, x double")
    rules = [Rule(source_table="t_bronze", source_column=c, target_column=c, transformation_logic="Fill null with mean") for c in ("q", "x")]
    out = sorted((r.q, r.x) for r in run_silver({"t_bronze": df}, rules).tables["t_silver"].collect())
    assert out == [(1.0, 1.0), (1.5, 3.0), (2.0, 2.0)]
    assert df.agg(F.max(RG.is_missing(df, "x"))).first()[0]


def test_nan_does_not_poison_totals(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("b", 3.0)], "region string, revenue double")
    ans = AN.answer({"s": df}, "total revenue by region")
    assert {r.region: r.value for r in ans.df.collect()} == {"a": 1.0, "b": 3.0}
    df.createOrReplaceTempView("s")
    assert {r.region: r.value for r in spark.sql(ans.sql).collect()} == {"a": 1.0, "b": 3.0}


def test_every_period_is_returned(spark):
    df = spark.range(100).select(F.expr("timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int))").alias("order_date"), F.lit(1.0).alias("amount"))
    assert AN.answer({"s": df}, "daily amount over time", faithful_time=False).df.count() == 100


def test_time_words_need_a_time_column(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "store string, price double, lifetime string")
    ans = AN.answer({"s": df}, "total price over stores by store")
    assert ans.group_col == "store" and ans.df.count() == 2
    text = spark.createDataFrame([("2024-01-01", 1.0)], "sale_date string, price double")
    assert AN.answer({"s": text}, "price trend").group_col == "sale_date"


def test_sql_is_counted_only_on_request(spark):
    spark.range(50).createOrReplaceTempView("r50")
    out = AN.run_sql(spark, "SELECT * FROM r50")
    assert out.status == "ok_non_empty" and out.row_count is None and len(out.rows) == 10
    assert AN.run_sql(spark, "SELECT * FROM r50", count=True).row_count == 50


def test_header_spellings(spark):
    df = canonical_headers(spark.createDataFrame([("orders", "a", "b", "Direct", "x")], "table string, source string, target string, type string, logic string"))
    r = df.first()
    assert (r.source_table, r.source_column, r.target_column, r.transformation_type, r.transformation_logic) == ("orders", "a", "b", "Direct", "x")


def test_answer_shapes(spark):
    raw = ['{"charts": {"type": "bar"}, "direct_answer": "yes"}', '{"direct_answer": 5}', '{"charts": [{"type": "bar"}, 3], "direct_answer": {"answer": "a"}}', "not json"]
    rows = LG.normalise_answers(spark.createDataFrame([(t,) for t in raw], "payload string"), "q").collect()
    assert [(r.direct_answer.answer, len(r.charts), r.charts_input_count) for r in rows] == [
        ("yes", 1, 1), ("No answer provided", 0, 0), ("a", 1, 2), ("No answer provided", 0, 0)]


def test_equal_stems_and_unreadable_inputs(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.csv").write_text(f"v\n{d}\n")
    paths = [str(tmp_path / "a" / "x.csv"), str(tmp_path / "b" / "x.csv"), str(tmp_path / "none.csv")]
    tables, errors = TB.read_many(spark, paths)
    assert {n: t.first().v for n, t in tables.items()} == {"a_x": "a", "b_x": "b"} and list(errors) == ["none"]


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_rejects_lose_no_row(spark, tmp_path, multi_line):
    (tmp_path / "r.csv").write_text("a,b\n1,2\n3,4,5\n6\n7,8\n")
    kept, rejected = TB.csv_parts(spark, str(tmp_path / "r.csv"), multi_line)
    assert sorted(r.a for r in kept.collect()) == ["1", "7"]
    assert sorted(r._corrupt_record for r in rejected.collect()) == ["3,4,5", "6"]
    assert kept.count() + rejected.count() == 4


def test_quoted_newlines_are_found(spark, tmp_path):
    cases = {"plain": ("a,b\n1,2\n", False), "quoted": ('a,b\n"x, y","say ""hi"""\n"",""\n', False),
             "newline": ('a,b\n"one\ntwo",2\n', True), "escaped": ('a,b\n"""one\ntwo""",2\n', True), "stray": ('a,b\n5" pipe,2\n', True)}
    for name, (text, spans) in cases.items():
        (tmp_path / f"{name}.csv").write_text(text)
        assert TB.quoted_newlines(spark, str(tmp_path / f"{name}.csv")) is spans, name
    assert TB.read_csv(spark, str(tmp_path / "newline.csv")).first().a == "one\ntwo"
    assert TB.read_csv(spark, str(tmp_path / "quoted.csv")).first().b == 'say "hi"'


def test_keys_of_a_split_file_need_no_sort(spark, tmp_path):
    from strata.operators.keys import add_surrogate_key, ranked_positions
    n = 6000
    (tmp_path / "s.csv").write_text("seq,pad\n" + "".join(f"{i},{'x' * (i % 37)}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 * 1024))
    try:
        df = TB.read_csv(spark, str(tmp_path / "s.csv"))
        assert df.rdd.getNumPartitions() > 3 and ranked_positions(df, "k") is not None
        keyed = add_surrogate_key(df, "pk")
        assert dict(keyed.dtypes)["pk"] == "bigint"
        assert all(r.pk == int(r.seq) + 1 for r in keyed.select("pk", "seq").collect())
        gaps = df.where("seq % 7 != 3 and seq % 5000 > 70")
        left = sorted(int(r.seq) for r in gaps.select("seq").collect())
        ranked = ranked_positions(gaps, "k")
        assert {int(r.seq): r.k for r in ranked.collect()} == {s: i for i, s in enumerate(left)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_full_run_keeps_rejects_and_leaves_no_scratch(spark, tmp_path):
    from pathlib import Path
    from strata.plans.pipeline import run_pipeline
    from strata.session import ensure_checkpoint_dir
    (tmp_path / "sales.csv").write_text("store_id,amount\ns1,10\ns2,20,99\ns1,5\n")
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    root = str(tmp_path / "out")
    res = run_pipeline(spark, [str(tmp_path / "sales.csv")], "total amount by store", root, "r1")
    assert set(folder.iterdir()) == before
    assert [r._corrupt_record for r in spark.read.parquet(f"{root}/rejected/r1/sales").collect()] == ["s2,20,99"]
    assert spark.read.parquet(res.outputs["bronze"]["sales_bronze"]).count() == 2
    assert len(res.answer.df.collect()) == 1


def test_distinct_counts_of_long_texts(spark):
    from strata.operators.profile import profile_table
    rows = [("x" * n,) for n in (1, 64, 65, 66, 66, 500, 500)] + [(None,), ("é" * 40,), ("é" * 40,)]
    prof, _ = profile_table("t", spark.createDataFrame(rows, "s string"))
    assert prof.first().unique_count == 6
