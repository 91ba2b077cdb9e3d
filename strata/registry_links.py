"""Registered queries over several tables, stores and reruns: keys found by
content, questions answered across tables, as-of and range joins, the keyed
store, incremental layers and mergeable profiles; added to ``registry`` when
that module is imported."""

from __future__ import annotations

import os
from collections import OrderedDict

from pyspark.sql import functions as F

from .operators import keys as K
from .operators.key_match import find_join_keys, join_keys_sql
from .operators.profile_state import STATE, file_states, merge_states, part_of
from .operators.store import KeyedStore
from .operators.timejoin import as_of_join, range_join
from .plans import answer as AN
from .plans.incremental import Tracked, update_bronze
from .plans.rules import Rule, collect_rules
from .registry import ORDERS_COLS, R2, T, X, _prof_out, _profile_sql, register
from .session import stage_path
from .sources import artifacts as ART
from .sources.manifest import write_parts
from .sources.tables import json_parts, read_parquet

# ===========================================================================
# JN-04 by content, RX-05 over several tables
# ===========================================================================

KEY_TABLES = OrderedDict(
    region=["r_regionkey", "r_name"], nation=["n_nationkey", "n_name", "n_regionkey"],
    customer=["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], supplier=["s_suppkey", "s_name", "s_nationkey"],
    part=["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    orders=["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"],
    lineitem=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"],
    documents=["doc_id", "text", "lang", "source", "n_chars"], labels=["doc_id", "quality", "toxic"])


@register("join_keys_by_content", join_keys_sql(KEY_TABLES))
def join_keys_by_content(spark, sf):
    """JN-04: every pair of columns of nine tables where one holds values of
    the other's key, found by sketches and confirmed exactly."""
    return find_join_keys(OrderedDict((t, T(spark, sf, t)) for t in KEY_TABLES))


def _linked(spark, sf):
    return OrderedDict(
        orders=T(spark, sf, "orders").select(F.col("o_orderkey").alias("order_number"), F.col("o_custkey").alias("buyer"),
                                             F.col("o_totalprice").alias("total_price"), F.col("o_orderdate").alias("order_date")),
        customer=T(spark, sf, "customer").select(F.col("c_custkey").alias("customer_number"), F.col("c_name").alias("customer_name"),
                                                 F.col("c_nationkey").alias("home")),
        nation=T(spark, sf, "nation").select(F.col("n_nationkey").alias("nation_number"), F.col("n_name").alias("nation_name")))


@register("answer_across_tables", """
SELECT * FROM (SELECT 'customer' AS question, c_name AS name, round(sum(o_totalprice), 2) AS value
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY c_name ORDER BY sum(o_totalprice) DESC NULLS LAST, c_name LIMIT 20)
UNION ALL SELECT * FROM (SELECT 'nation' AS question, n_name AS name, round(avg(o_totalprice), 2) AS value
 FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
 GROUP BY n_name ORDER BY avg(o_totalprice) DESC NULLS LAST, n_name LIMIT 20)
""")
def answer_across_tables(spark, sf):
    """RX-05: the measure lies in one table, the names in another, one and two
    joins away; the joins follow keys found by content."""
    tables = _linked(spark, sf)
    links = AN.key_links(find_join_keys(tables, texts=False))
    one = AN.answer_across(tables, "total price by customer name", links).df
    two = AN.answer_across(tables, "average price by nation name", links).df
    return (one.select(F.lit("customer").alias("question"), F.col("customer_name").alias("name"), R2("value"))
            .unionByName(two.select(F.lit("nation").alias("question"), F.col("nation_name").alias("name"), R2("value"))))


# ===========================================================================
# JN-05 as-of and range joins
# ===========================================================================

@register("as_of_join", """
SELECT l.event_id, l.user_id, r.event_id AS seen_event, r.value AS seen_value
FROM (SELECT * FROM events WHERE event_type <> 'view') l
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts >= r.ts
""")
def as_of_join_query(spark, sf):
    """JN-05: each event with its user's latest view before it."""
    e = T(spark, sf, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), F.col("event_id").alias("seen_event"),
                                                  F.col("value").alias("seen_value"))
    out = as_of_join(e.where("event_type <> 'view'"), views, ["user_id"], "ts", "seen_at")
    return out.select("event_id", "user_id", "seen_event", "seen_value")


@register("range_join", """
SELECT c_custkey, c_acctbal, s_suppkey, c_nationkey FROM customer LEFT JOIN supplier
ON c_nationkey = s_nationkey AND c_acctbal >= s_acctbal - 10 * (s_suppkey % 50) AND c_acctbal < s_acctbal + 500
""")
def range_join_query(spark, sf):
    """JN-05: customers with the suppliers of their nation in whose balance
    range (of many widths) they lie."""
    bands = T(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("c_nationkey"),
                                            X("s_acctbal - 10 * (s_suppkey % 50)").alias("low"), X("s_acctbal + 500").alias("high"))
    out = range_join(T(spark, sf, "customer"), bands, "c_acctbal", "low", "high", keys=["c_nationkey"], how="left")
    return out.select("c_custkey", "c_acctbal", "s_suppkey", "c_nationkey")


# ===========================================================================
# SC-16 keyed store
# ===========================================================================

@register("doc_store_upserts", """
WITH r AS (SELECT doc_id, 1 AS version, text, lang FROM documents
  UNION ALL SELECT doc_id, 2, text || ' [v2]', lang FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 2, text || ' [v2b]', lang FROM documents WHERE doc_id % 15 = 0
  UNION ALL SELECT doc_id, 0, 'late', lang FROM documents WHERE doc_id % 7 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC, text DESC, lang DESC) AS n FROM r)
SELECT doc_id, version, md5(text) AS text_md5, lang FROM k WHERE n = 1
""")
def doc_store_upserts(spark, sf):
    """SC-16: three upserts into a bucketed store: newer versions, two rows of
    one version in one upsert (the larger text stays), and late old versions."""
    d = T(spark, sf, "documents").select("doc_id", F.lit(1).alias("version"), "text", "lang")
    store = KeyedStore(spark, stage_path(spark, "doc-store"), "doc_id", "version", buckets=16)
    store.upsert(d)
    v2 = d.where("doc_id % 5 = 0").select("doc_id", F.lit(2).alias("version"), F.concat("text", F.lit(" [v2]")).alias("text"), "lang")
    v2b = d.where("doc_id % 15 = 0").select("doc_id", F.lit(2).alias("version"), F.concat("text", F.lit(" [v2b]")).alias("text"), "lang")
    store.upsert(v2.unionByName(v2b))
    store.upsert(d.where("doc_id % 7 = 0").select("doc_id", F.lit(0).alias("version"), F.lit("late").alias("text"), "lang"))
    return store.read().select("doc_id", "version", F.md5("text").alias("text_md5"), "lang")


# ===========================================================================
# WN-01 keys after dropped and repeated rows
# ===========================================================================

@register("surrogate_key_after_drop", """
SELECT row_number() OVER (ORDER BY o_orderkey) AS pk, o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 3 AND o_custkey % 5 <> 1
""")
def surrogate_key_after_drop(spark, sf):
    """WN-01: rows were dropped, so the key is the rank of the row's ordinal
    among those left: no sort and no copy of the rows."""
    o = read_parquet(spark, os.path.join(sf, "orders.parquet")).where("o_orderkey % 7 <> 3 AND o_custkey % 5 <> 1")
    return K.add_surrogate_key(o, "pk").select("pk", "o_orderkey", "o_custkey")


@register("surrogate_key_repeats", """
SELECT count(*) AS n, min(pk) AS lowest, max(pk) AS highest, count(DISTINCT pk) AS keys FROM (
 SELECT row_number() OVER () AS pk FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 3
 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1))
""")
def surrogate_key_repeats(spark, sf):
    """WN-01: repeated and dropped ordinals together; the repeats are noticed
    and the keys are still 1..n."""
    o = read_parquet(spark, os.path.join(sf, "orders.parquet"))
    df = o.where("o_orderkey % 7 <> 3").unionByName(o.where("o_orderkey % 4 = 1"))
    return K.add_surrogate_key(df, "pk").agg(F.count(F.lit(1)).alias("n"), F.min("pk").alias("lowest"), F.max("pk").alias("highest"),
                                             F.countDistinct("pk").alias("keys"))


# ===========================================================================
# RX-06 / AG-02 reruns
# ===========================================================================

INCREMENT_RULES = [Rule(source_table="orders", source_column="o_orderkey", target_column="order_key", transformation_logic="Type cast to integer"),
                   Rule(source_table="orders", source_column="o_totalprice", target_column="price", transformation_logic="Convert to float numeric"),
                   Rule(source_table="orders", source_column="o_orderpriority", target_column="priority", transformation_logic="Type cast to integer")]


def _first_part(spark, sf, folder):
    path = os.path.join(folder, "orders.parquet")
    o = T(spark, sf, "orders").withColumn("o_orderpriority", F.substring("o_orderpriority", 1, 1))
    o.where("o_orderkey % 4 <> 3").write.parquet(path)
    return o, path


@register("bronze_incremental", """
SELECT o_orderkey AS order_key, round(o_totalprice, 2) AS price, CAST(substring(o_orderpriority, 1, 1) AS BIGINT) AS priority,
       o_orderkey % 4 = 3 AS rebuilt FROM orders
""")
def bronze_incremental(spark, sf):
    """RX-06: a second run after more files came; ``rebuilt`` marks the rows
    that it wrote."""
    folder = stage_path(spark, "incremental")
    o, path = _first_part(spark, sf, folder)

    def run():
        t = Tracked.open(spark, "orders", path, os.path.join(folder, "state"))
        built = update_bronze(t, INCREMENT_RULES, "orders.parquet", os.path.join(folder, "bronze"))
        t.state.record()
        return built.read(spark)
    before = run().agg(F.max("_load_timestamp")).first()[0]
    o.where("o_orderkey % 4 = 3").write.mode("append").parquet(path)
    return run().select("order_key", R2("price"), "priority", (F.col("_load_timestamp") > F.lit(before)).alias("rebuilt"))


@register("profile_incremental", _profile_sql("orders", ORDERS_COLS))
def profile_incremental(spark, sf):
    """AG-02: the profile of orders merged from the states of two batches of
    files, each scanned once."""
    folder = stage_path(spark, "profile")
    o = T(spark, sf, "orders")
    for n, rows in enumerate((o.where("o_orderkey % 4 <> 3"), o.where("o_orderkey % 4 = 3"))):
        path = os.path.join(folder, f"in{n}.parquet")
        rows.write.parquet(path)
        df = read_parquet(spark, path)
        write_parts(file_states(df).withColumn("_part", part_of(F.col("file"))), os.path.join(folder, "states"), full=False)
    states = spark.read.schema(STATE).parquet(os.path.join(folder, "states"))
    return _prof_out(merge_states(states, "orders", o.schema, o.columns)[0])


# ===========================================================================
# SC-04 JSON rejects, SC-08 header preference
# ===========================================================================

JSON_LINE = ("'{\"order_key\":' || CAST(o_orderkey AS VARCHAR) || ',\"status\":\"' || o_orderstatus || '\"' || "
             "CASE WHEN o_orderkey % 9 = 4 THEN '' ELSE '}' END")


@register("json_rejects", f"""
SELECT CASE WHEN o_orderkey % 9 = 4 THEN 'rejected' ELSE 'kept' END AS part, CASE WHEN o_orderkey % 9 <> 4 THEN o_orderkey END AS order_key,
       CASE WHEN o_orderkey % 9 <> 4 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 9 = 4 THEN {JSON_LINE} END AS line
FROM orders
""")
def json_rejects(spark, sf):
    """SC-04: JSON lines that were cut off are set aside whole; they add
    neither rows nor columns to the table."""
    path = stage_path(spark, "lines") + ".json"
    T(spark, sf, "orders").select(X(JSON_LINE.replace("VARCHAR", "STRING")).alias("value")).write.text(path)
    kept, rejected = json_parts(spark, path)
    none = F.lit(None).cast("string")
    return kept.select(F.lit("kept").alias("part"), "order_key", "status", none.alias("line")).unionByName(
        rejected.select(F.lit("rejected").alias("part"), F.lit(None).cast("bigint").alias("order_key"), none.alias("status"),
                        F.col("_corrupt_record").alias("line")))


@register("rule_header_preference", "SELECT o_orderkey AS order_key, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def rule_header_preference(spark, sf):
    """SC-08: joined spellings, and two spellings of one column in a file: the
    canonical one counts wherever it stands."""
    from .plans.layers import run_bronze
    path = stage_path(spark, "rules-joined")
    rows = [("nowhere", "orders", "o_orderkey", "order_key", "Direct", "Type cast to integer"),
            ("nowhere", "orders", "o_custkey", "customer", "Direct", "Convert to text")]
    spark.createDataFrame(rows, ["table", "source_table", "SourceColumn", "targetcolumn", "transformationtype", "logic"]) \
        .coalesce(1).write.option("header", True).csv(path)
    rules = collect_rules(ART.read_rules(spark, path))
    out = run_bronze(OrderedDict(orders=T(spark, sf, "orders")), rules, {"orders": "orders.csv"}).tables["orders_bronze"]
    return out.select("order_key", "customer")


# ===========================================================================
# AG-09 duplicates over several batches
# ===========================================================================

@register("duplicates_across_runs", """
WITH b AS (SELECT CAST(o_orderkey % 3 AS INTEGER) AS batch, o_custkey % 200 AS k, o_orderstatus, o_orderpriority FROM orders),
f AS (SELECT k, o_orderstatus, o_orderpriority, min(batch) AS first FROM b GROUP BY ALL),
n AS (SELECT batch, count(*) AS n FROM b GROUP BY batch), d AS (SELECT first AS batch, count(*) AS d FROM f GROUP BY first)
SELECT n.batch, n.n - coalesce(d.d, 0) AS repeated, sum(n.n - coalesce(d.d, 0)) OVER (ORDER BY n.batch)::BIGINT AS so_far
FROM n LEFT JOIN d ON n.batch = d.batch
""")
def duplicates_across_runs(spark, sf):
    """AG-09: three batches of orders counted one after the other; each is
    compared with the digests of those before it."""
    from .operators.ledger import DuplicateLedger
    o = T(spark, sf, "orders").select("o_orderkey", X("o_custkey % 200").alias("k"), "o_orderstatus", "o_orderpriority")
    path, out = stage_path(spark, "row-ledger"), []
    for batch in range(3):
        ledger = DuplicateLedger(spark, path)
        n = ledger.add(o.where(F.col("o_orderkey") % 3 == batch).drop("o_orderkey"))
        out.append((batch, n, ledger.duplicates))
    return spark.createDataFrame(out, "batch int, repeated bigint, so_far bigint")
