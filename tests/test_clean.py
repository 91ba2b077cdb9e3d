"""Cleaning functions and the D-rows of the blueprint."""
from collections import OrderedDict
import pytest

from pyspark.sql import functions as F

from strata.plans.layers import run_silver
from strata.plans.rules import Rule


def _silver(spark, rows, schema, logic_by_col, **kw):
    df = spark.createDataFrame(rows, schema)
    rules = [Rule(source_table="t_bronze", source_column=c, target_column=c,
                  transformation_logic=logic_by_col.get(c, "")) for c in df.columns]
    res = run_silver(OrderedDict(t_bronze=df), rules, key_order={"t_bronze": [df.columns[0]]}, **kw)
    return res, res.tables["t_silver"].orderBy(df.columns[0])


def test_numeric_coerce_d1(spark):
    _, out = _silver(spark, [(1, " 3 "), (2, "1e3"), (3, "1,000"), (4, None)], "id long, v string",
                     {"v": "Convert to float numeric"})
    assert [r.v for r in out.collect()] == [3.0, 1000.0, None, None]


def test_integer_all_or_nothing_d2(spark):
    res, out = _silver(spark, [(1, "7", "2"), (2, " 8 ", "2.5")], "id long, a string, b string",
                       {"a": "Type cast to integer", "b": "Type cast to integer"})
    sch = dict((f.name, f.dataType.simpleString()) for f in out.schema.fields)
    assert sch["a"] == "bigint" and sch["b"] == "string"
    assert [r.a for r in out.collect()] == [7, 8]
    assert [r.b for r in out.collect()] == ["2", "2.5"]


def test_float_keeps_integers_d3(spark):
    _, out = _silver(spark, [(1, 5)], "id long, q long", {"q": "Convert to float numeric"})
    assert out.schema["q"].dataType.simpleString() == "bigint"


def test_date_modes_d4(spark):
    rows = [(1, "2024-01-05"), (2, "05/01/2024"), (3, "20240105"), (4, "junk")]
    _, first = _silver(spark, rows, "id long, d string", {"d": "Date standardisation"}, date_mode="first_format")
    _, per = _silver(spark, rows, "id long, d string", {"d": "Date standardisation"}, date_mode="per_value")
    f = [r.d for r in first.collect()]
    p = [r.d for r in per.collect()]
    assert f[0] is not None and f[1] is None and f[2] is None and f[3] is None
    assert p[0] == p[1] == p[2] and p[3] is None


def test_text_cast_keeps_null_d5(spark):
    _, out = _silver(spark, [(1, None), (2, 5)], "id long, v long", {"v": "Convert to text"})
    assert [r.v for r in out.collect()] == [None, "5"]


def test_mode_tie_smallest_d11(spark):
    rows = [(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)]
    _, out = _silver(spark, rows, "id long, v string", {"v": "Fill null with mode"})
    assert out.collect()[-1].v == "a"


def test_median_and_mean_fill(spark):
    rows = [(1, 10.0), (2, None), (3, 30.0), (4, 1.0), (5, 100.0)]
    _, med = _silver(spark, rows, "id long, v double", {"v": "Fill null with median"})
    assert med.collect()[1].v == 20.0          # median of 1,10,30,100 = 20 (interpolated)
    _, mean = _silver(spark, [(1, 10.0), (2, None), (3, 30.0)], "id long, v double", {"v": "Fill null with mean"})
    assert mean.collect()[1].v == 20.0


def test_title_case_d12(spark):
    _, out = _silver(spark, [(1, "they're x-ray a1b")], "id long, v string", {"v": "Title case"})
    assert out.first().v == "They'Re X-Ray A1B"


def test_strip_unicode_whitespace_d13(spark):
    _, out = _silver(spark, [(1, "\t\n x y   ")], "id long, v string", {"v": "strip whitespace"})
    assert out.first().v == "x y"


def test_fill_default_text_only_d18(spark):
    res, out = _silver(spark, [(1, None, None)], "id long, s string, n double",
                       {"s": "Fill null default value", "n": "Fill null default value"})
    r = out.first()
    assert r.s == "" and r.n is None
    assert any("non-text" in w[2] for w in res.warnings)


def test_drop_null_and_case(spark):
    rows = [(1, "Abc"), (2, None), (3, "dEF")]
    _, out = _silver(spark, rows, "id long, v string", {"v": "Drop null; uppercase"})
    assert [r.v for r in out.collect()] == ["ABC", "DEF"]
    assert [r.pk_t_bronze_silver_id for r in out.collect()] == [1, 2]


@pytest.mark.parametrize("case", ["rounds", "duplicates", "fallback", "small"])
def test_exact_quantile_paths(spark, case):
    """Exact median by bracketing, on every path: several narrowing rounds,
    a hot value (a third of the column), the sort-based fallback, and a
    column small enough to read at once."""
    import numpy as np
    from strata.operators.stats import exact_quantile
    rng = np.random.default_rng(7)
    vals = rng.normal(size=4001).round(3).tolist()
    if case == "duplicates":
        vals = vals[:2700] + [0.25] * 1300
    df = spark.createDataFrame([(float(x),) for x in vals], "v double")
    kw = {"small": {}, "rounds": dict(limit=40, accuracy=200),
          "duplicates": dict(limit=40, accuracy=200), "fallback": dict(limit=40, accuracy=200, rounds=0)}[case]
    for q in (0.5, 0.1):
        got = exact_quantile(df, "v", q, **kw)
        srt = sorted(vals)
        pos = q * (len(vals) - 1)
        assert got == (srt[int(pos // 1)], srt[int(-(-pos // 1))])
    even = spark.createDataFrame([(float(x),) for x in vals[:1000]], "v double")
    a, b = exact_quantile(even, "v", 0.5, **kw)
    assert (a + b) / 2 == float(np.median(vals[:1000]))


def test_dedup_rule_runs_rest_of_its_text_d17(spark):
    """A rule that de-duplicates on a column also applies the rest of
    its text (here: uppercase), unlike the reference, which stops there."""
    df = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "code string, v long, _source_row long")
    rules = [Rule(source_table="t_bronze", source_column="code", target_column="code",
                  transformation_logic="Deduplicate on code; convert to uppercase"),
             Rule(source_table="t_bronze", source_column="v", target_column="v")]
    out = run_silver(OrderedDict(t_bronze=df), rules).tables["t_silver"]
    assert sorted((r.code, r.v) for r in out.collect()) == [("A", 1), ("B", 3)]


def test_median_edge_cases(spark):
    """All-null column -> no median (the fill is skipped); infinities are
    ordinary values at the ends; one value is its own median."""
    from strata.operators.stats import median_value
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    assert median_value(nulls, "v") is None
    inf = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),), (None,)], "v double")
    assert median_value(inf, "v") == 1.5
    one = spark.createDataFrame([(4,)], "v long")
    assert median_value(one, "v") == 4.0
