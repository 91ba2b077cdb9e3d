"""Profile, lists of values, join keys (AG-02..04, JN-04) and quality (QL-*)."""
from collections import OrderedDict

from strata.operators import profile as PF
from strata.operators import quality as QL
from strata.operators.joins import join_key_candidates, measure_key_overlap


def test_profile_single(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "b", 20.0), (3, "c", None)],
                               "id long, name string, value double")
    prof, lov = PF.profile(OrderedDict(single=df))
    rows = {r.column: r for r in prof.collect()}
    assert rows["value"].null_count == 1 and rows["value"].null_pct == 33.33
    assert rows["value"].mean == 15.0 and rows["value"].min == 10.0
    assert rows["name"].unique_count == 3 and rows["name"].sample_value == "a"
    assert {(r.column, r.value, r.freq) for r in lov.collect()} == {("name", "a", 1), ("name", "b", 1),
                                                                     ("name", "c", 1)}


def test_profile_approx_switch(spark):
    df = spark.range(0, 2000).selectExpr("id", "cast(id % 3 as string) as s")
    prof, _ = PF.profile(OrderedDict(t=df), estimate_distinct=True)
    rows = {r.column: r for r in prof.collect()}
    assert rows["id"].unique_exact is False and 1800 < rows["id"].unique_count < 2200
    assert rows["s"].unique_exact is False and rows["s"].unique_count == 3
    exact, _ = PF.profile(OrderedDict(t=df))
    assert {r.column: (r.unique_exact, r.unique_count) for r in exact.collect()}["id"] == (True, 2000)


def test_join_keys_pair(spark):
    sales = spark.createDataFrame([(1, 5)], "product_id long, revenue long")
    products = spark.createDataFrame([(1, "x")], "product_id long, name string")
    cat = PF.catalog_frame(spark, OrderedDict(sales=sales, products=products))
    keys = join_key_candidates(cat).collect()
    assert [(k.left_dataset, k.right_dataset, k.left_column, k.confidence) for k in keys] == [
        ("sales", "products", "product_id", "medium")]


def test_quality_notes_fallback(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id long, v string")
    prof, _ = PF.profile(OrderedDict(t=df), with_lov=False)
    assert [r.note for r in PF.quality_notes(prof).collect()] == ["t.v has high null percentage (66.67%)."]
    prof2, _ = PF.profile(OrderedDict(t=df.where("v is not null")), with_lov=False)
    assert "No major" in PF.quality_notes(prof2).first().note


def test_duplicates_exact(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k long, v string")
    assert QL.duplicate_count(df) == 3
    assert QL.duplicate_count(df.withColumn("pk_x", df.k)) == 3      # generated keys excluded (D27)


def test_validate_layer_warnings_and_rollup(spark):
    ok = spark.createDataFrame([(1,)], "a long")
    empty = spark.createDataFrame([], "a long")
    files, summary = QL.validate_layer(spark, "gold", OrderedDict(ok=ok, empty=empty), "r",
                                       expected={"ok": ["a", "b"]})
    flat = {r.table: r.warnings for r in QL.flatten(files).collect()}
    assert flat["empty"] == "Output File is Empty."
    assert flat["ok"] == "Missing Expected Columns detected."
    roll = QL.rollup(files).first()
    assert (roll.file_count, roll.files_with_warnings, roll.total_warnings, roll.status) == (2, 2, 2, "warning")
    assert summary["status"] == "warning"


def test_validate_no_outputs(spark):
    files, summary = QL.validate_layer(spark, "bronze", OrderedDict(), "r")
    assert summary["summary"]["total_warnings"] == 1 and summary["status"] == "warning"


def test_join_keys_measured_overlap(spark):
    # key 1 holds most rows on both sides (hot key); nulls are not keys
    sales = spark.createDataFrame([(1, 5)] * 40 + [(2, 1), (3, 1), (None, 9)], "product_id long, revenue long")
    products = spark.createDataFrame([(1, "x")] * 30 + [(3, "y"), (7, "z"), (None, "n")], "product_id long, name string")
    tables = OrderedDict(sales=sales, products=products)
    cat = PF.catalog_frame(spark, tables)
    got = measure_key_overlap(tables, join_key_candidates(cat)).collect()
    assert [(r.left_dataset, r.right_dataset, r.left_keys, r.matched_keys) for r in got] == [
        ("sales", "products", 3, 2)]
    none = measure_key_overlap(OrderedDict(sales=sales), join_key_candidates(
        PF.catalog_frame(spark, OrderedDict(sales=sales))))
    assert none.count() == 0 and "matched_keys" in none.columns


def test_lov_covers_every_text_column_d26(spark):
    """Lists of values for every string column under 50 distinct values
    (not only pandas 'object' dtype); numeric columns never get one."""
    df = spark.createDataFrame([("x", "p", 1), ("y", "p", 2), ("x", None, 3)], "a string, b string, n long")
    _, lov = PF.profile(OrderedDict(t=df))
    got = sorted((r.column, r.value, r.freq, r.unique_count) for r in lov.collect())
    assert got == [("a", "x", 2, 2), ("a", "y", 1, 2), ("b", "p", 2, 1)]


def test_duplicate_count_hot_row(spark):
    """A third of the rows are one identical row (a hot hash group): the
    count stays exact, and the scan ordinal / generated keys are ignored (D27)."""
    from strata.operators.quality import duplicate_count
    rows = [(i, "same", 1.5) if i % 3 == 0 else (i, f"r{i % 50}", float(i % 50)) for i in range(3000)]
    df = spark.createDataFrame([(i, s, v, i) for i, (_, s, v) in enumerate(rows)],
                               "pk_x long, s string, v double, _source_row long")
    # 1000 identical rows -> 999 extra; 2000 others over 50 distinct rows -> 1950 extra
    assert duplicate_count(df) == 999 + 1950
