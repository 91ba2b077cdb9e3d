"""Keys found by content, answers over several tables, as-of and range joins,
the keyed store, ranks of dropped rows and late materialisation."""

import contextlib
import io
import os
import random
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from strata.operators import keys as K
from strata.operators.joins import combine_sources
from strata.operators.key_match import find_join_keys, merge_sketches, sketch_columns
from strata.operators.stats import group_median
from strata.operators.store import KeyedStore, upsert_latest
from strata.operators.timejoin import as_of_join, range_join
from strata.plans import answer as AN
from strata.sources.tables import read_parquet


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode="formatted")
    return text.getvalue()


# -- keys by content -------------------------------------------------------
def key_tables(spark):
    parent = spark.range(0, 3000).select((F.col("id") * 3 + 7).alias("a_code"), F.concat(F.lit("n"), "id").alias("label"))
    child = spark.range(0, 20_000).select(F.col("id").alias("row"), (F.col("id") * 31 % 2500 * 3 + 7).cast("int").alias("b_code"),
                                          F.when(F.col("id") % 9 > 0, (F.col("id") % 4000 * 3 + 7).cast("string")).alias("partly"))
    return OrderedDict(parent=parent, child=child)


def test_join_keys_by_content(spark):
    found = {(r.left_dataset, r.left_column, r.right_dataset, r.right_column): r for r in find_join_keys(key_tables(spark)).collect()}
    hit = found["child", "b_code", "parent", "a_code"]
    assert (hit.left_keys, hit.right_keys, hit.matched_keys, hit.confidence) == (2500, 3000, 2500, "high")
    assert ("child", "partly", "parent", "a_code") not in found
    loose = {(r.left_column, r.right_column): r for r in find_join_keys(key_tables(spark), min_share=0.7).collect()}
    assert loose["partly", "a_code"].matched_keys == 3000


def test_small_columns_against_large_keys_are_not_missed(spark):
    big = spark.range(0, 300_000).select((F.col("id") * 7).alias("k"))
    few = spark.createDataFrame([(7 * 123,), (7 * 299_999,), (None,)], "v long")
    rows = find_join_keys(OrderedDict(few=few, big=big)).collect()
    assert [(r.left_column, r.matched_keys) for r in rows if r.left_dataset == "few"] == [("v", 2)]
    assert find_join_keys(OrderedDict(a=few.limit(0), b=few.limit(0))).count() == 0


def test_sketches_merge(spark):
    tables = key_tables(spark)
    halves = [sketch_columns(OrderedDict((n, df.where(F.xxhash64(*df.columns) % 2 == p)) for n, df in tables.items())) for p in (0, 1)]
    halves += [sketch_columns(OrderedDict((n, df.where(F.xxhash64(*df.columns) % 2 == -1)) for n, df in tables.items()))]
    merged = find_join_keys(tables, sketches=merge_sketches(*halves))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, find_join_keys(tables).collect()))


# -- questions over several tables ------------------------------------------
def test_answer_across_tables(spark):
    tables = OrderedDict(
        sales=spark.createDataFrame([(1, 10, 5.0), (2, 10, 7.0), (3, 20, 1.0), (4, None, 2.0), (5, 99, 4.0)], "sale long, buyer long, price double"),
        people=spark.createDataFrame([(10, "ann", 1), (20, "bob", 2), (30, "cy", 2)], "person long, person_name string, town long"),
        towns=spark.createDataFrame([(1, "York"), (2, "Bath")], "town_number long, town_name string"))
    links = [AN.KeyLink("sales", "buyer", "people", "person"), AN.KeyLink("people", "town", "towns", "town_number")]
    ans = AN.answer_across(tables, "total price by town name", links)
    rows = {r.town_name: r.value for r in ans.df.collect()}
    assert rows == {"York": 12.0, "Bath": 1.0, None: 6.0}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    assert {r.town_name: r.value for r in spark.sql(ans.sql).collect()} == rows
    # no path from many to one: answered on one table, rows are never repeated
    assert AN.join_path(links, "towns", "sales") is None
    assert [x.target for x in AN.join_path(links, "sales", "towns")] == ["people", "towns"]
    assert AN.answer_across(tables, "total price", links).df.first().value == 19.0
    with pytest.raises(ValueError):
        AN.answer({}, "total price")


# -- as-of and range joins -----------------------------------------------------
def test_as_of_join_against_brute_force(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(200)])) for i in range(600)]
    right = [(rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(-50, 200)]), rng.randrange(9)) for _ in range(300)]
    out = as_of_join(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, at long, v long"),
                     ["k"], "t", "at", bins=7)
    want = []
    for i, k, t in left:
        fits = [(a, v) for kk, a, v in right if k is not None and kk == k and t is not None and a is not None and a <= t]
        want.append((i, k, t, *(max(fits) if fits else (None, None))))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    text = plan(out)
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_as_of_join_of_times_and_clashing_names(spark):
    left = spark.sql("SELECT 1 AS k, timestamp'2024-01-02 10:00:00' AS t, 'l' AS v UNION ALL SELECT 1, timestamp'2023-01-01', 'e'")
    right = spark.sql("SELECT 1 AS k, timestamp'2024-01-02 10:00:00' AS t, 'r' AS v UNION ALL SELECT 1, timestamp'2024-01-02 10:00:01', 's'")
    rows = {r.v: r.r_v for r in as_of_join(left, right, ["k"], "t", "t", prefix="r_").collect()}
    assert rows == {"l": "r", "e": None}
    assert as_of_join(left, right.limit(0), ["k"], "t", "t", prefix="r_").where("r_v IS NULL").count() == 2


def test_range_join_against_brute_force(spark):
    rng = random.Random(2)
    points = [(i, rng.choice(["x", "y", None]), rng.choice([None, rng.uniform(-5, 100)])) for i in range(300)] + [(900, "x", 10.0), (901, "x", 20.0)]
    spans = [(rng.choice(["x", "y"]), a, a + rng.choice([0.0, 0.001, 0.5, 3, 40, 1000, -1])) for a in (rng.uniform(-10, 90) for _ in range(120))]
    spans += [("x", 10.0, 20.0), ("x", None, 5.0), (None, 0.0, 100.0)]
    p = spark.createDataFrame(points, "id long, k string, v double")
    s = spark.createDataFrame(spans, "k string, lo double, hi double")
    for closed in (False, True):
        want = [(i, k, v, lo, hi) for i, k, v in points for kk, lo, hi in spans
                if k is not None and k == kk and v is not None and lo is not None and lo <= v and (v <= hi if closed else v < hi)]
        out = range_join(p, s, "v", "lo", "hi", ["k"], closed=closed)
        assert sorted(map(tuple, out.collect())) == sorted(want)
        met = {w[0] for w in want}
        left = range_join(p, s, "v", "lo", "hi", ["k"], how="left", closed=closed)
        assert sorted(map(tuple, left.collect()), key=str) == sorted(want + [(i, k, v, None, None) for i, k, v in points if i not in met], key=str)
    assert "NestedLoop" not in plan(range_join(p, s, "v", "lo", "hi"))
    assert range_join(p, s.limit(0), "v", "lo", "hi", how="left").count() == len(points)


def test_range_join_deals_pairs_to_tasks(spark, monkeypatch):
    """Few bytes that make many pairs: several tasks make them, a bin with too
    many is shared, and the rows are those of the plain join."""
    from strata.operators import joins
    p = spark.range(0, 400, 1, 1).selectExpr("id", "id % 2 AS k", "CAST(id % 40 AS DOUBLE) AS v")
    s = spark.range(0, 60, 1, 1).selectExpr("id AS sid", "id % 2 AS k", "CAST(id % 30 AS DOUBLE) AS lo", "CAST(id % 30 + 4 AS DOUBLE) AS hi")
    want = [(a.id, b.sid) for a in p.collect() for b in s.collect() if a.k == b.k and b.lo <= a.v < b.hi]
    met = {a for a, _ in want}
    monkeypatch.setattr(joins, "LEAST_NULL_PAIRS", 64)
    monkeypatch.setattr(joins, "MOST_NULL_PAIRS", 100)
    for how in ("inner", "left"):
        out = range_join(p, s, "v", "lo", "hi", ["k"], how=how)
        alone = [(a, None) for a in range(400) if a not in met] if how == "left" else []
        assert sorted(((r.id, r.sid) for r in out.collect()), key=str) == sorted(want + alone, key=str)
        parts = out.where("sid IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 4 and max(r["count"] for r in parts) < len(want) / 2
    # one bin holds every pair
    one = range_join(p.withColumn("v", F.lit(1.0)), s.withColumn("lo", F.lit(0.0)).withColumn("hi", F.lit(2.0)), "v", "lo", "hi", ["k"])
    assert one.count() == one.distinct().count() == 400 * 30
    assert one.groupBy(F.spark_partition_id()).count().count() > 4


# -- keyed store -----------------------------------------------------------------
def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "store"), "id", "version", buckets=8)
    assert store.read() is None
    store.upsert(spark.range(0, 400).select("id", F.lit(1).alias("version"), F.lit("a").alias("t")))

    def files():
        return {os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "store") for f in fs if f.startswith("part-")}
    before = files()
    touched = store.upsert(spark.createDataFrame([(5, 2, "b"), (1000, 1, "n")], "id long, version int, t string"))
    changed = {f.split("_bucket=")[1].split("/")[0] for f in before ^ files()}
    assert changed == {str(b) for b in touched} and len(touched) <= 2
    assert store.read().count() == 401
    assert [(r.version, r.t) for r in store.get([5]).collect()] == [(2, "b")]
    assert [r.id for r in store.first(2).collect()] == [0, 1]
    assert store.upsert(spark.createDataFrame([], "id long, version int, t string")) == []


def test_store_deals_and_writes_rows_once(spark, tmp_path, monkeypatch):
    """An upsert deals each row once, writes it once beside the buckets it
    reads and writes no other whole copy; hot keys, null keys and new columns
    come out as before."""
    from strata.operators import store as S
    staged = []
    monkeypatch.setattr(S, "stage_table", lambda df, prefix, f=S.stage_table: (staged.append(df.count()), f(df, prefix))[1])
    plans = []
    real = S.latest_rows
    monkeypatch.setattr(S, "latest_rows", lambda *a: (out := real(*a), plans.append(plan(out)))[0])
    store = KeyedStore(spark, str(tmp_path / "store"), "id", "version", buckets=4)
    base = spark.range(0, 3000).selectExpr("IF(id % 1000 = 999, NULL, id) AS id", "1 AS version", "concat('t', id) AS t")
    assert store.upsert(base) == [0, 1, 2, 3] and staged == []
    assert all(p.count("Exchange (") + p.count("Exchange\n") <= 2 for p in plans), plans[0]
    new = spark.createDataFrame([(5, 2, "b", 1.5), (5, 2, "a", 2.5), (6, 0, "late", 0.0), (None, 1, "zz", 7.0), (9000, 1, "n", None)],
                                "id long, version int, t string, x double")
    store.upsert(new)
    assert staged == [5]
    rows = {r.id: (r.version, r.t, r.x) for r in store.read().collect()}
    assert store.read().count() == len(rows) == 2997 + 2
    assert (rows[5], rows[6], rows[None], rows[9000]) == ((2, "b", 1.5), (1, "t6", None), (1, "zz", 7.0), (1, "n", None))
    monkeypatch.setattr(S, "HOT_ROWS", 3)
    hot = spark.range(0, 500).selectExpr("IF(id < 400, 5, id) AS id", "CAST(id AS INT) AS version", "'h' AS t", "0.0D AS x")
    store.upsert(hot)
    assert staged[1] == 101  # a hot key is one row before it is dealt
    assert {r.id: r.version for r in store.get([5, 6, 450]).collect()} == {5: 399, 6: 1, 450: 450}
    assert store.read().count() == 2999


def test_equal_versions_resolve_alike(spark):
    rows = [(1, 1, t) for t in "cabd"] + [(2, None, "x"), (2, 0, "y"), (None, 1, "n"), (None, 1, "m")]
    df = spark.createDataFrame(rows, "id long, version int, t string")
    for parts in (1, 2, 3, 7):
        out = upsert_latest(df.limit(0), df.repartition(parts), "id", "version")
        assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, 1, "d"), (2, 0, "y"), (None, 1, "n")], key=str)


# -- keys and duplicates by address ----------------------------------------------
@pytest.fixture()
def scan(spark, tmp_path):
    df = spark.range(0, 50_000, numPartitions=3).select("id", (F.col("id") * 17 % 4001).alias("k"), F.repeat(F.lit("pad"), 20).alias("pad"))
    df.write.parquet(str(tmp_path / "t"))
    return read_parquet(spark, str(tmp_path / "t"))


def test_keys_after_dropped_rows_without_a_sort(spark, scan, monkeypatch):
    kept = scan.where("id % 7 <> 3 AND NOT id BETWEEN 20000 AND 36000")
    out = K.add_surrogate_key(kept, "pk")
    text = plan(out)
    assert "rangepartitioning" not in text.lower() and "sorted-" not in text
    monkeypatch.setattr(K, "DRIVER_ENTRIES", 1)
    monkeypatch.setattr(K, "BROADCAST_ENTRIES", 1)
    for keyed in (out, K.add_surrogate_key(kept, "pk")):
        rows = [r[0] for r in keyed.orderBy(*K.ORDINAL_COLUMNS).select("pk").collect()]
        assert rows == list(range(1, kept.count() + 1))


def test_repeated_ordinals_are_noticed(spark, scan):
    # 0,1,1,4,5,5,6,6,8: count, sum and sum of squares are those of 0..8
    times = {0: 1, 1: 2, 4: 1, 5: 2, 6: 2, 8: 1}
    one = scan.where("_source_row IN (0, 1, 4, 5, 6, 8)").where(F.col(K.SOURCE_FILE) == scan.agg(F.min(K.SOURCE_FILE)).first()[0])
    twice = F.element_at(F.create_map(*[F.lit(x) for kv in times.items() for x in kv]), F.col(K.SOURCE_ROW).cast("int"))
    df = one.withColumn("copy", F.explode(F.sequence(F.lit(1), twice))).drop("copy")
    assert not K.ordinals_are_distinct(df) and K.ordinals_are_distinct(scan)
    assert sorted(r.pk for r in K.add_surrogate_key(df, "pk").collect()) == list(range(1, 10))


def test_first_rows_are_read_by_address(spark, scan, monkeypatch):
    want = {(r.k, r.id) for r in scan.groupBy("k").agg(F.min(F.struct(*K.ORDINAL_COLUMNS, "id")).alias("f")).select("k", "f.id").collect()}
    for limit in (K.BROADCAST_ADDRESSES, 10):
        monkeypatch.setattr(K, "BROADCAST_ADDRESSES", limit)
        out = K.dedup_keep_first(scan, ["k"])
        assert out.columns == scan.columns
        assert {(r.k, r.id) for r in out.collect()} == want
        assert "min(struct" not in plan(out) and "collect" not in plan(out)
    monkeypatch.undo()
    few = scan.where("id < 49000").unionByName(scan.where("id >= 49000").withColumn("k", F.lit(1)))
    assert K.dedup_keep_first(few, ["id"]).count() == 50_000  # nothing dropped


def test_equal_rows_are_dropped_by_address(spark, tmp_path):
    rows = [(i % 40, None if i % 3 == 0 else f"t{i % 4}") for i in range(600)]
    spark.createDataFrame(rows, "a long, b string").repartition(4).write.parquet(str(tmp_path / "d"))
    df = read_parquet(spark, str(tmp_path / "d"))
    out = K.dedup_keep_first(df, None)
    assert out.count() == len(set(rows))
    first = df.groupBy("a", "b").agg(F.min(F.struct(*K.ORDINAL_COLUMNS)).alias("f")).select("a", "b", "f.*")
    assert out.select("a", "b", *K.ORDINAL_COLUMNS).exceptAll(first).count() == 0


# -- group medians ----------------------------------------------------------------
def test_group_medians_narrow_hot_groups(spark, monkeypatch):
    from strata.operators import stats
    import statistics
    rng = random.Random(4)
    rows = [("hot", rng.choice([rng.gauss(0, 1e6), 3.25, -1e300, 1e300])) for _ in range(6000)]
    rows += [("same", 7.0)] * 3000 + [(None, float(i)) for i in range(10)] + [("one", 1.5), ("none", None), ("nan", float("nan"))]
    want = {}
    for g, v in rows:
        if v is not None and v == v:
            want.setdefault(g, []).append(v)
    df = spark.createDataFrame(rows, "g string, v double")
    for values in (200_000, 50, 1):
        monkeypatch.setattr(stats, "BRACKET_VALUES", values)
        out = group_median(df, ["g"], "v", accuracy=100)
        assert {r.g: r.median for r in out.collect()} == {g: statistics.median(v) for g, v in want.items()}
        assert "rangepartitioning" not in plan(out).lower()


# -- null keys over a fold ---------------------------------------------------------
def test_null_keys_of_sources_apart_are_reported(spark):
    a = spark.createDataFrame([(1, 1, "a"), (None, 2, "b")], "k_id long, x_id long, p string")
    b = spark.createDataFrame([(1, "c"), (3, "d")], "x_id long, q string")
    c = spark.createDataFrame([(None, 5), (1, 6)], "k_id long, r int")
    told = []
    out = combine_sources([a, b, c], warn=lambda *x: told.append(x))
    # the row of b alone has no k_id either
    assert told == [("k_id", "2 and 1 rows without a key match each other: 2 rows")]
    assert out.where("r = 5").count() == 2


# -- duplicates over several batches --------------------------------------------------
def test_ledger_counts_over_batches(spark, tmp_path):
    from strata.operators.ledger import DuplicateLedger
    from strata.operators.quality import duplicate_count
    path = str(tmp_path / "ledger")
    batches = [[(1, "a"), (1, "a"), (2, None), (3, "")], [(2, None), (4, "d"), (3, None)], [], [(1, "a"), (4, "d"), (4, "d"), (5, "e")]]
    rows = []
    for batch in batches:
        df = spark.createDataFrame(batch, "k long, t string")
        rows += batch
        ledger = DuplicateLedger(spark, path)
        before = ledger.duplicates
        assert ledger.add(df) == ledger.duplicates - before
        assert DuplicateLedger(spark, path).duplicates == duplicate_count(spark.createDataFrame(rows, "k long, t string"))
    with pytest.raises(ValueError):
        DuplicateLedger(spark, path).add(spark.createDataFrame([(1,)], "other long"))


def test_an_interrupted_batch_is_counted_once(spark, tmp_path, monkeypatch):
    from strata.operators import ledger as L
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    with monkeypatch.context() as m:
        m.setattr(L, "write_note", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            L.DuplicateLedger(spark, path).add(df)
    assert L.DuplicateLedger(spark, path).add(df) == 1
    assert L.DuplicateLedger(spark, path).add(df) == 3
