"""Surrogate keys (WN-01) and keep-first de-duplication (WN-02/03, D6)."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from strata.operators.keys import add_surrogate_key, dedup_keep_first, positions


def test_surrogate_key_contiguous_many_partitions(spark):
    """Keys 1..n in the given order, whatever the input partitioning."""
    base = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    for parts in (1, 3, 17):
        df = base.repartition(parts)
        out = add_surrogate_key(df, "pk", ["k"])
        exp = df.select(F.row_number().over(Window.orderBy("k")).alias("pk"), "k")
        assert out.columns == ["pk", "k"]
        assert out.exceptAll(exp).count() == 0 and exp.exceptAll(out).count() == 0


def test_surrogate_key_skipped_when_present(spark):
    df = spark.createDataFrame([(5, "a")], "pk long, v string")
    assert add_surrogate_key(df, "pk", ["v"]).first().pk == 5


def test_positions_empty(spark):
    df = spark.createDataFrame([], "k long")
    assert positions(df, ["k"]).count() == 0


def test_dedup_keep_first_hot_key_and_nulls(spark):
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 3 == 1 else f"k{i}"), i * 10) for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, key string, v long")
    out = {r.key: (r.ord, r.v) for r in dedup_keep_first(df, ["key"], order_by=["ord"]).collect()}
    assert out["hot"] == (0, 0)
    assert out[None] == (1, 10)            # nulls form one group (D6)
    assert len(out) == 2 + 100


def test_dedup_whole_rows(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 6.0)], "id long, v double")
    assert dedup_keep_first(df, None).count() == 2


def test_surrogate_key_many_parts_and_split_reads(spark):
    """Order must survive many sort partitions and files split across reads."""
    conf = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.files.maxPartitionBytes": "2048", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(0, 20000).select((F.col("id") * 7919 % 20011).alias("k"), F.lit("x" * 20).alias("pad"))
        out = add_surrogate_key(df, "pk", ["k"])
        exp = df.select(F.row_number().over(Window.orderBy("k")).alias("pk"), "k", "pad")
        assert out.exceptAll(exp).count() == 0 and out.count() == 20000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_sort_value_is_split_across_parts(spark):
    """One order value holds a third of the rows: the tie-break lets the
    range partitioner split it, and the keys stay contiguous 1..n."""
    from strata.operators.keys import sorted_table, _tiebreak
    from strata.operators.stats import group_median
    df = spark.range(0, 30000).selectExpr("CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS k", "id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tagged = sorted_table(df, [F.col("k"), *_tiebreak(df, ["k"])])
        parts = tagged.where("k = 5").select("_part").distinct().count()
        keyed = add_surrogate_key(df, "pk", ["k"])
        agg = keyed.agg(F.min("pk"), F.max("pk"), F.countDistinct("pk")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert parts >= 2
    assert tuple(agg) == (1, 30000, 30000)
    # group median with a hot group of identical values, and a small group
    g = spark.range(0, 9000).selectExpr("CASE WHEN id < 3000 THEN 'a' ELSE 'b' END AS g",
                                        "CASE WHEN id < 3000 THEN 7.0 ELSE CAST(id AS DOUBLE) END AS v")
    med = {r.g: r.median for r in group_median(g, ["g"], "v").collect()}
    assert med == {"a": 7.0, "b": (5999 + 6000) / 2}
