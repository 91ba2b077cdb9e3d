"""Gold joins: null-safe outer (D8), 3-way fold, left-wins columns (D28), union."""
from strata.operators.joins import combine_sources, full_outer, shared_id_keys


def test_null_keys_match_d8(spark):
    l = spark.createDataFrame([(1, "a"), (None, "n"), (3, "c")], "k_id long, lv string")
    r = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "k_id long, rv string")
    out = sorted(full_outer(l, r, ["k_id"]).collect(), key=lambda x: (x.k_id is None, x.k_id or 0))
    assert [(x.k_id, x.lv, x.rv) for x in out] == [(1, "a", "x"), (3, "c", None), (4, None, "z"),
                                                  (None, "n", "y")]
    strict = full_outer(l, r, ["k_id"], null_keys_match=False)
    assert strict.count() == 5


def test_three_way_and_left_wins(spark):
    a = spark.createDataFrame([(1, 10, "A")], "c_id long, n_id long, name string")
    b = spark.createDataFrame([(1, 7.0, "B")], "c_id long, amount double, name string")
    c = spark.createDataFrame([(10, "X"), (11, "Y")], "n_id long, nation string")
    out = combine_sources([a, b, c])
    rows = {r.n_id: r for r in out.collect()}
    assert rows[10].name == "A" and rows[10].amount == 7.0 and rows[10].nation == "X"
    assert rows[11].c_id is None and rows[11].nation == "Y"
    assert shared_id_keys(["id", "x_id", "_source_file"], ["id", "x_id"]) == ["id", "x_id"]


def test_union_without_key(spark):
    a = spark.createDataFrame([(1,)], "a long")
    b = spark.createDataFrame([("x",)], "b string")
    out = combine_sources([a, b])
    assert out.count() == 2 and set(out.columns) == {"a", "b"}


def test_join_variants(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b")], "k_id long, lv string")
    r = spark.createDataFrame([(2, "x"), (3, "y")], "k_id long, rv string")
    assert sorted(tuple(x) for x in full_outer(l, r, ["k_id"], how="inner").collect()) == [(2, "b", "x")]
    assert sorted(tuple(x) for x in full_outer(l, r, ["k_id"], how="left").collect()) == [(1, "a", None),
                                                                                           (2, "b", "x")]
    assert sorted(tuple(x) for x in full_outer(l, r, ["k_id"], how="right").collect()) == [(2, "b", "x"),
                                                                                            (3, None, "y")]


def test_hot_key_outer_join(spark):
    """A key holding a third of the left rows: every row kept, no FULL OUTER
    sort-merge join in the plan (left + anti halves instead)."""
    import contextlib
    import io
    left = spark.range(0, 3000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k_id", "id AS v")
    right = spark.range(0, 50).selectExpr("id AS k_id", "id * 10 AS w")
    out = full_outer(left, right, ["k_id"])
    assert out.count() == 3000 + sum(1 for k in range(50) if k % 3 == 0 and k != 0)
    assert out.where("k_id = 0").count() == 1000
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    assert "FullOuter" not in buf.getvalue()


def test_fold_plan_stays_linear(spark):
    """Five sources on one key: each step re-reads a written table, so the
    final plan scans O(n) inputs (the unstaged fold would scan 2^n)."""
    frames = [spark.createDataFrame([(k, f"v{i}{k}") for k in range(i, i + 3)] + [(None, f"n{i}")],
                                    f"k_id long, v{i} string") for i in range(5)]
    out = combine_sources(frames)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") + plan.count("LocalTableScan") <= 8
    rows = {r.k_id: r for r in out.collect()}
    assert sorted(k for k in rows if k is not None) == list(range(7))
    # null keys match across every step
    assert [rows[None][f"v{i}"] for i in range(5)] == [f"n{i}" for i in range(5)]
    assert rows[2].v0 == "v02" and rows[2].v2 == "v22" and rows[2].v3 is None


def test_pairs_without_key_are_dealt_to_tasks(spark, monkeypatch):
    """Many pairs of rows without a key: whole rows as in a plain null-safe
    join, made by several tasks though the sides are small enough for a
    broadcast and lie in one partition each."""
    from strata.operators import joins
    monkeypatch.setattr(joins, "LEAST_NULL_PAIRS", 100)
    left = spark.range(0, 300, 1, 1).selectExpr("IF(id % 3 = 0, NULL, id % 50) AS k_id", "id AS v")
    right = spark.range(0, 200, 1, 1).selectExpr("IF(id % 4 = 0, NULL, id % 60) AS k_id", "id AS w")
    out = full_outer(left, right, ["k_id"])
    a, b = left.collect(), right.collect()
    held, known = {r.k_id for r in b}, {r.k_id for r in a}
    want = [(x.k_id, x.v, y.w) for x in a for y in b if x.k_id == y.k_id]
    want += [(x.k_id, x.v, None) for x in a if x.k_id not in held] + [(y.k_id, None, y.w) for y in b if y.k_id not in known]
    key = str
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    parts = {r[0] for r in out.where("k_id IS NULL").selectExpr("spark_partition_id()").distinct().collect()}
    assert len(parts) > 2
    two = full_outer(left.selectExpr("k_id", "v % 2 AS j_id", "v"), right.selectExpr("k_id", "w % 2 AS j_id", "w"), ["k_id", "j_id"])
    pairs = sum(x.k_id == y.k_id and x.v % 2 == y.w % 2 for x in a for y in b)
    assert two.where("v IS NOT NULL AND w IS NOT NULL").count() == pairs


def test_tasks_of_null_pairs_grow_with_the_pairs():
    from strata.operators.joins import MOST_NULL_PAIRS, null_tasks
    assert null_tasks(0, 9, 8) == null_tasks(9, 0, 8) == null_tasks(300, 200, 8) == 1
    for n, m in ((18_000, 12_000), (108_000, 72_000), (1_000_000, 1_000)):
        assert 8 <= null_tasks(n, m, 8) <= n and n * m / null_tasks(n, m, 8) <= MOST_NULL_PAIRS


def test_pairs_without_key_are_numbered_without_a_copy(spark, monkeypatch):
    """The gold key of n * m pairs is that of the sorted rows, also where left
    rows are equal in the order, yet only the inputs' rows are sorted and
    written. Orders that mix the pairs with other rows are sorted."""
    from collections import OrderedDict

    from strata.operators import joins, keys
    from strata.plans.layers import run_gold
    from strata.plans.rules import Rule
    monkeypatch.setattr(joins, "LEAST_NULL_PAIRS", 100)
    written, write = [], keys.sorted_table
    monkeypatch.setattr(keys, "sorted_table", lambda df, *a, **k: (written.append(df.count()), write(df, *a, **k))[1])
    a = spark.range(0, 90, 1, 2).selectExpr("IF(id % 3 = 0, NULL, id % 40) AS k_id", "id AS pk_a", "concat('x', id % 7) AS x", "id % 2 AS z", "IF(id < 15, id, NULL) AS gap")
    b = spark.range(0, 80, 1, 2).selectExpr("IF(id % 2 = 0, NULL, id % 60) AS k_id", "id % 5 AS y", "double(id) / 4 AS w")

    def rule(source, column, target):
        return Rule(source_table=source, source_column=column, target_table="t", target_column=target, transformation_type="Direct")

    def made(cols, order=None):
        rules = [rule("b" if c in ("y", "w") else "a", c, t) for c, t in cols.items()]
        written.clear()
        gold = run_gold(OrderedDict(a=a.select("k_id", *[c for c in a.columns if c in cols and c != "k_id"]), b=b), rules, key_order={"t": order} if order else None)
        assert [text for *_, text in gold.warnings] == ["30 and 40 rows without a key match each other: 1200 rows"]
        return gold.tables["t"]

    def check(out, order):
        rows = out.collect()
        assert sorted(r.pk_gold_id for r in rows) == list(range(1, len(rows) + 1))
        rows.sort(key=lambda r: r.pk_gold_id)
        values = [[(r[c] is not None, r[c] if r[c] is not None else 0) for c in order] for r in rows]
        assert values == sorted(values)
        return rows

    def plain(cols):
        both = joins.combine_sources([a, b]).select(*[f"`{c}`" for c in cols]).collect()
        return sorted((tuple(r) for r in both), key=str)
    for cols, order, copied in (
            ({"k_id": "k_id", "x": "name", "y": "y", "w": "w"}, None, False),     # left rows are equal
            ({"k_id": "k_id", "z": "z", "y": "y"}, None, False),                  # so are right rows
            ({"k_id": "k_id", "pk_a": "pk_a", "w": "w"}, ["pk_a"], False),        # pairs between other rows
            ({"k_id": "k_id", "pk_a": "pk_a", "y": "y"}, ["pk_a", "y"], False),
            ({"k_id": "k_id", "x": "x", "w": "w"}, ["w", "x"], True),             # a right column first
            ({"x": "x", "y": "y"}, None, True),                                   # other rows equal the left rows
            ({"k_id": "k_id", "gap": "gap", "y": "y"}, ["gap", "y"], True)):
        out = made(cols, order)
        rows = check(out, order or list(cols.values()))
        assert sorted((tuple(r)[1:] for r in rows), key=str) == plain(cols)
        assert (max(written) >= 1200) == copied and sorted(map(str, out.collect())) == sorted(map(str, rows))
    # no column of the right rows
    df, pairs = joins.sources_and_pairs([a, b])
    few = lambda side: side.select(*[c for c in ("k_id", "x") if c in side.columns])
    written.clear()
    rows = check(keys.add_surrogate_key(few(df), "pk_gold_id", pairs=pairs.changed(few)), ["k_id", "x"])
    assert sorted((tuple(r)[1:] for r in rows), key=str) == plain(["k_id", "x"]) and max(written) < 1200


def test_shares_of_pairs_are_bounded():
    from strata.operators.joins import MOST_CELL_PAIRS, pair_sides
    assert pair_sides(1, 1, 8) == pair_sides(300, 200, 8) == (1, 1)
    for n, m in ((18_000, 12_000), (108_000, 72_000), (1_000_000, 1_000), (10, 20_000_000), (50_000_000, 1)):
        a, b = pair_sides(n, m, 8)
        assert a <= n and b <= m and a * b >= 8 and n * m / (a * b) <= MOST_CELL_PAIRS * 1.5
