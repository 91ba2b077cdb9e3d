"""Registered queries: one per operator group of the blueprint, each reading
the whole given tables, with the equivalent DuckDB SQL as an oracle.

Dirt (nulls, padded text, mixed date formats, duplicates) is injected with
deterministic SQL expressions over the table keys; the same expression text
is used on both sides.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as TX
from .functions.dates import DATE_FORMATS
from .operators import charts as CH
from .operators import keys as K
from .operators import profile as PF
from .operators import quality as QL
from .operators import store as ST
from .operators.joins import combine_sources, join_key_candidates, measure_key_overlap
from .operators.stats import group_median
from .plans import answer as AN
from .plans import generate as RG
from .plans import logs as LG
from .plans.layers import run_bronze, run_gold, run_silver
from .plans.rules import Rule, approved, collect_rules, rules_frame
from .sources.tables import TABLE_NAMES, register_views

QUERIES: "OrderedDict[str, Callable[[SparkSession, str], DataFrame]]" = OrderedDict()
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def X(sql: str):
    return F.expr(sql)


def R2(c: str, nd: int = 2):
    return F.round(F.col(c), nd).alias(c)


# ===========================================================================
# bronze / silver cleaning
# ===========================================================================

CUST_TEXT = "lpad(CAST(o_custkey AS VARCHAR), 8, '0')"


@register("bronze_ingest_orders", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus,
       o_totalprice AS total_price, o_orderdate AS order_date, o_orderpriority AS priority
FROM orders
""")
def bronze_ingest_orders(spark, sf):
    src = T(spark, sf, "orders").select(
        "o_orderkey", X(CUST_TEXT.replace("VARCHAR", "STRING")).alias("o_custkey"), "o_orderstatus",
        "o_totalprice", "o_orderdate", "o_orderpriority",
        F.col("_metadata.file_path").alias(K.SOURCE_FILE), F.col("_metadata.row_index").alias(K.SOURCE_ROW))
    rules = [Rule(source_table="orders", source_column="o_orderkey", target_column="order_id",
                  transformation_logic="Type cast to integer"),
             Rule(source_table="orders", source_column="o_custkey", target_column="customer_id",
                  transformation_logic="Convert to whole number"),
             Rule(source_table="orders", source_column="o_orderstatus", target_column="o_orderstatus",
                  transformation_logic="Keep in text format"),
             Rule(source_table="orders", source_column="o_totalprice", target_column="total_price",
                  transformation_logic="Convert to decimal"),
             Rule(source_table="orders", source_column="o_orderdate", target_column="order_date",
                  transformation_logic="Parse datetime"),
             Rule(source_table="orders", source_column="o_orderpriority", target_column="priority",
                  transformation_logic="Direct pass-through"),
             Rule(source_table="orders", target_column="_load_timestamp",
                  transformation_logic="Current UTC timestamp injected at load time")]
    out = run_bronze(OrderedDict(orders=src), rules, {"orders": "orders.parquet"}).tables["orders_bronze"]
    return out.drop("_load_timestamp", K.SOURCE_FILE, K.SOURCE_ROW)


NAME_DIRT = ("CASE WHEN c_custkey % 3 = 0 THEN concat(' ' || chr(9), upper(c_name), '  ') "
             "WHEN c_custkey % 3 = 1 THEN concat(c_name, chr(10)) ELSE c_name END")
SEG_DIRT = "CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END"


@register("bronze_ingest_orders_csv", """
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS total_price,
       o_orderdate AS order_date,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority
FROM orders
""")
def bronze_ingest_orders_csv(spark, sf):
    """SC-01 end to end: ``orders`` written as CSV text (zero-padded keys,
    null tokens 'N/A' and 'NA', timestamps as text) to the checkpoint folder,
    read back in parallel splits with the null-token list (D14) and type
    inference (D15), then the bronze rules."""
    from .session import stage_path
    from .sources.tables import read_csv
    text = T(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        X(CUST_TEXT.replace("VARCHAR", "STRING")).alias("o_custkey"), "o_orderstatus",
        X("CASE WHEN o_orderkey % 13 = 0 THEN 'N/A' ELSE CAST(o_totalprice AS STRING) END").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"),
        X("CASE WHEN o_orderkey % 11 = 0 THEN 'NA' ELSE o_orderpriority END").alias("o_orderpriority"))
    path = stage_path(spark, "orders-csv")
    text.write.option("header", True).csv(path)
    src = read_csv(spark, path, multi_line=False)
    rules = [Rule(source_table="orders", source_column="o_orderkey", target_column="order_id",
                  transformation_logic="Type cast to integer"),
             Rule(source_table="orders", source_column="o_custkey", target_column="customer_id",
                  transformation_logic="Convert to whole number"),
             Rule(source_table="orders", source_column="o_orderstatus", target_column="o_orderstatus",
                  transformation_logic="Keep in text format"),
             Rule(source_table="orders", source_column="o_totalprice", target_column="total_price",
                  transformation_logic="Convert to decimal"),
             Rule(source_table="orders", source_column="o_orderdate", target_column="order_date",
                  transformation_logic="Parse datetime"),
             Rule(source_table="orders", source_column="o_orderpriority", target_column="priority",
                  transformation_logic="Direct pass-through")]
    out = run_bronze(OrderedDict(orders=src), rules, {"orders": "orders.csv"}).tables["orders_bronze"]
    return out.drop("_load_timestamp", K.SOURCE_FILE, K.SOURCE_ROW)


@register("silver_clean_customer", f"""
SELECT row_number() OVER (ORDER BY c_custkey) AS pk_customer_bronze_silver_id,
       c_custkey AS customer_id,
       lower(trim({NAME_DIRT}, ' ' || chr(9) || chr(10))) AS c_name,
       upper(trim({SEG_DIRT})) AS c_mktsegment,
       c_acctbal
FROM customer
""")
def silver_clean_customer(spark, sf):
    c = T(spark, sf, "customer")
    dirty = c.select("c_custkey", X(NAME_DIRT).alias("c_name"), "c_nationkey", "c_acctbal",
                     X(SEG_DIRT).alias("c_mktsegment"))
    rules = [Rule(source_table="customer_bronze", source_column="c_custkey", target_column="customer_id",
                  transformation_logic="Type cast to integer for id column"),
             Rule(source_table="customer_bronze", source_column="c_name", target_column="c_name",
                  transformation_logic="Convert to text; lowercase; strip whitespace"),
             Rule(source_table="customer_bronze", source_column="c_mktsegment", target_column="c_mktsegment",
                  transformation_logic="Convert to text; uppercase; trim"),
             Rule(source_table="customer_bronze", source_column="c_acctbal", target_column="c_acctbal",
                  transformation_logic="Convert to float numeric")]
    res = run_silver(OrderedDict(customer_bronze=dirty), rules, key_order={"customer_bronze": ["customer_id"]})
    return res.tables["customer_silver"]


DISC_NULL = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END"


@register("drop_nulls", f"""
SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_discount) AS pk_lineitem_bronze_silver_id,
       l_orderkey, l_linenumber, l_discount
FROM (SELECT l_orderkey, l_linenumber, {DISC_NULL} AS l_discount FROM lineitem) t
WHERE l_discount IS NOT NULL
""")
def drop_nulls(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X(DISC_NULL).alias("l_discount"))
    rules = [Rule(source_table="lineitem_bronze", source_column=c, target_column=c,
                  transformation_logic="Drop null rows" if c == "l_discount" else "Direct")
             for c in ["l_orderkey", "l_linenumber", "l_discount"]]
    res = run_silver(OrderedDict(lineitem_bronze=li), rules,
                     key_order={"lineitem_bronze": ["l_orderkey", "l_linenumber", "l_discount"]})
    return res.tables["lineitem_silver"]


PRICE_NULL = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"


def _silver_one(spark, df: DataFrame, stem: str, col: str, logic: str, key: list[str]) -> DataFrame:
    rules = [Rule(source_table=stem, source_column=c, target_column=c,
                  transformation_logic=logic if c == col else "Direct") for c in df.columns]
    return run_silver(OrderedDict([(stem, df)]), rules, key_order={stem: key}).tables[
        stem.replace("_bronze", "_silver")]


@register("fill_mean", f"""
SELECT o_orderkey, round(coalesce(p, (SELECT avg(p) FROM (SELECT {PRICE_NULL} AS p FROM orders) a)), 2) AS o_totalprice
FROM (SELECT o_orderkey, {PRICE_NULL} AS p FROM orders) t
""")
def fill_mean(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", X(PRICE_NULL).alias("o_totalprice"))
    out = _silver_one(spark, o, "orders_bronze", "o_totalprice", "Fill null with mean", ["o_orderkey"])
    return out.select("o_orderkey", R2("o_totalprice"))


EXT_NULL = "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END"


@register("fill_median", f"""
SELECT l_orderkey, l_linenumber,
       round(coalesce(p, (SELECT median(p) FROM (SELECT {EXT_NULL} AS p FROM lineitem) a)), 2) AS l_extendedprice
FROM (SELECT l_orderkey, l_linenumber, {EXT_NULL} AS p FROM lineitem) t
""")
def fill_median(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X(EXT_NULL).alias("l_extendedprice"))
    out = _silver_one(spark, li, "lineitem_bronze", "l_extendedprice", "Fill null with median",
                      ["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", R2("l_extendedprice"))


TYPE_NULL = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END"


@register("fill_mode", f"""
SELECT event_id, coalesce(et, (SELECT et FROM (SELECT {TYPE_NULL} AS et FROM events) a
                               WHERE et IS NOT NULL GROUP BY et ORDER BY count(*) DESC, et LIMIT 1)) AS event_type
FROM (SELECT event_id, {TYPE_NULL} AS et FROM events) t
""")
def fill_mode(spark, sf):
    e = T(spark, sf, "events").select("event_id", X(TYPE_NULL).alias("event_type"))
    out = _silver_one(spark, e, "events_bronze", "event_type", "Fill null with mode", ["event_id"])
    return out.select("event_id", "event_type")


PRIO_NULL = "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END"


@register("fill_default", f"""
SELECT o_orderkey, coalesce({PRIO_NULL}, '') AS o_orderpriority, {PRICE_NULL} AS o_totalprice FROM orders
""")
def fill_default(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", X(PRIO_NULL).alias("o_orderpriority"),
                                      X(PRICE_NULL).alias("o_totalprice"))
    rules = [Rule(source_table="orders_bronze", source_column="o_orderkey", target_column="o_orderkey"),
             Rule(source_table="orders_bronze", source_column="o_orderpriority", target_column="o_orderpriority",
                  transformation_logic="Fill null default value"),
             Rule(source_table="orders_bronze", source_column="o_totalprice", target_column="o_totalprice",
                  transformation_logic="Fill null default value")]
    out = run_silver(OrderedDict(orders_bronze=o), rules, key_order={"orders_bronze": ["o_orderkey"]})
    return out.tables["orders_silver"].select("o_orderkey", "o_orderpriority", "o_totalprice")


CENTS = "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)"
NUM_TEXT = (f"CASE WHEN event_id % 4 = 0 THEN concat('  ', {CENTS}, ' ') "
            f"WHEN event_id % 4 = 1 THEN concat({CENTS}, 'e-2') "
            f"WHEN event_id % 4 = 2 THEN 'n/a' ELSE concat({CENTS}, ',0') END")


@register("cast_numeric", f"""
SELECT event_id, TRY_CAST(trim({NUM_TEXT}) AS DOUBLE) AS value_num FROM events
""")
def cast_numeric(spark, sf):
    e = T(spark, sf, "events").select("event_id", X(NUM_TEXT.replace("VARCHAR", "STRING")).alias("value_num"))
    out = _silver_one(spark, e, "events_bronze", "value_num", "Convert to float numeric", ["event_id"])
    return out.select("event_id", "value_num")


INT_TEXT = "concat(' ', CAST(user_id AS VARCHAR), ' ')"
FRAC_TEXT = "CASE WHEN event_id = 3 THEN '2.5' ELSE CAST(user_id AS VARCHAR) END"


@register("cast_integer_policy", f"""
SELECT event_id, CAST(user_id AS BIGINT) AS user_num, {FRAC_TEXT} AS user_frac FROM events
""")
def cast_integer_policy(spark, sf):
    e = T(spark, sf, "events").select("event_id", X(INT_TEXT.replace("VARCHAR", "STRING")).alias("user_num"),
                                      X(FRAC_TEXT.replace("VARCHAR", "STRING")).alias("user_frac"))
    rules = [Rule(source_table="events_bronze", source_column="event_id", target_column="event_id"),
             Rule(source_table="events_bronze", source_column="user_num", target_column="user_num",
                  transformation_logic="Type cast to integer"),
             Rule(source_table="events_bronze", source_column="user_frac", target_column="user_frac",
                  transformation_logic="Type cast to integer")]
    out = run_silver(OrderedDict(events_bronze=e), rules, key_order={"events_bronze": ["event_id"]})
    return out.tables["events_silver"].select("event_id", "user_num", "user_frac")


DATE_TEXT_DUCK = ("CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') "
                  "WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%d/%m/%Y') "
                  "ELSE strftime(o_orderdate, '%Y%m%d') END")
DATE_TEXT_SPARK = ("CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') "
                   "WHEN o_orderkey % 3 = 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') "
                   "ELSE date_format(o_orderdate, 'yyyyMMdd') END")


def _date_query(spark, sf, mode):
    o = T(spark, sf, "orders").select("o_orderkey", X(DATE_TEXT_SPARK).alias("o_orderdate"))
    rules = [Rule(source_table="orders_bronze", source_column="o_orderkey", target_column="o_orderkey"),
             Rule(source_table="orders_bronze", source_column="o_orderdate", target_column="order_date",
                  transformation_logic="Date standardisation to YYYY-MM-DD")]
    out = run_silver(OrderedDict(orders_bronze=o), rules, date_mode=mode,
                     key_order={"orders_bronze": ["o_orderkey"]})
    return out.tables["orders_silver"].select("o_orderkey", "order_date")


@register("date_first_format", f"""
SELECT o_orderkey, TRY_STRPTIME({DATE_TEXT_DUCK}, '%Y-%m-%d') AS order_date FROM orders
""")
def date_first_format(spark, sf):
    return _date_query(spark, sf, "first_format")


@register("date_per_value", f"""
SELECT o_orderkey, COALESCE(TRY_STRPTIME({DATE_TEXT_DUCK}, '%Y-%m-%d'), TRY_STRPTIME({DATE_TEXT_DUCK}, '%d/%m/%Y'),
                            TRY_STRPTIME({DATE_TEXT_DUCK}, '%m/%d/%Y'), TRY_STRPTIME({DATE_TEXT_DUCK}, '%Y%m%d')) AS order_date
FROM orders
""")
def date_per_value(spark, sf):
    return _date_query(spark, sf, "per_value")


PNAME_DIRT = ("CASE WHEN p_partkey % 2 = 0 THEN concat(chr(9) || ' ', upper(p_name), ' ' || chr(10)) "
              "ELSE p_name END")


@register("text_case_trim", f"""
SELECT p_partkey, lower(trim({PNAME_DIRT}, ' ' || chr(9) || chr(10))) AS p_name, upper(p_brand) AS p_brand,
       trim(concat('  ', p_type, '  ')) AS p_type
FROM part
""")
def text_case_trim(spark, sf):
    p = T(spark, sf, "part").select("p_partkey", X(PNAME_DIRT).alias("p_name"), "p_brand",
                                    F.concat(F.lit("  "), "p_type", F.lit("  ")).alias("p_type"))
    rules = [Rule(source_table="part_bronze", source_column="p_partkey", target_column="p_partkey"),
             Rule(source_table="part_bronze", source_column="p_name", target_column="p_name",
                  transformation_logic="Convert to text; lowercase; strip whitespace"),
             Rule(source_table="part_bronze", source_column="p_brand", target_column="p_brand",
                  transformation_logic="uppercase"),
             Rule(source_table="part_bronze", source_column="p_type", target_column="p_type",
                  transformation_logic="trim")]
    out = run_silver(OrderedDict(part_bronze=p), rules, key_order={"part_bronze": ["p_partkey"]})
    return out.tables["part_silver"].select("p_partkey", "p_name", "p_brand", "p_type")


TITLE_DUCK = ("array_to_string(list_transform(regexp_extract_all(s, '[A-Za-z]+|[^A-Za-z]+'), "
              "lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z]') THEN upper(x[1]) || lower(x[2:]) ELSE x END), '')")


@register("text_title_case", f"""
SELECT row_number() OVER (ORDER BY p_partkey) AS pk_part_bronze_silver_id, p_partkey,
       {TITLE_DUCK.replace('(s,', "(p_name || ' o''neil x-ray a1b',")} AS p_name
FROM part
""")
def text_title_case(spark, sf):
    """Every run of letters capitalised ("o'neil x-ray a1b" -> "O'Neil X-Ray A1B")."""
    p = T(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" o'neil x-ray a1b")).alias("p_name"))
    return _silver_one(spark, p, "part_bronze", "p_name", "Convert to text; title case", ["p_partkey"])


@register("dedup_keep_first", """
SELECT event_id, ts, user_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) t
WHERE rn = 1
""")
def dedup_keep_first(spark, sf):
    e = T(spark, sf, "events")
    return K.dedup_keep_first(e, ["user_id"], order_by=["event_id"])


LI_DUP = ("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem "
          "UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag "
          "FROM lineitem WHERE l_orderkey % 10 = 0")


@register("dedup_rows", f"SELECT DISTINCT * FROM ({LI_DUP}) t")
def dedup_rows(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                         "l_quantity", "l_returnflag")
    dup = li.unionByName(li.where("l_orderkey % 10 = 0"))
    rules = [Rule(source_table="lineitem_bronze", source_column="", target_column="",
                  transformation_logic="Deduplicate rows")] + [
        Rule(source_table="lineitem_bronze", source_column=c, target_column=c) for c in li.columns]
    out = run_silver(OrderedDict(lineitem_bronze=dup), rules,
                     key_order={"lineitem_bronze": ["l_orderkey", "l_linenumber"]})
    return out.tables["lineitem_silver"].drop("pk_lineitem_bronze_silver_id")


@register("surrogate_key", """
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS pk_orders_id, o_orderkey, o_orderdate FROM orders
""")
def surrogate_key(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return K.add_surrogate_key(o, "pk_orders_id", ["o_orderdate", "o_orderkey"])


# ===========================================================================
# joins and unions (gold sources)
# ===========================================================================

@register("outer_join_two", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, d.source, l.quality, l.toxic
FROM documents d FULL JOIN labels l ON d.doc_id IS NOT DISTINCT FROM l.doc_id
""")
def outer_join_two(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "lang", "source")
    return combine_sources([d, T(spark, sf, "labels")])


CUST_KEY_DIRT = "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END"
NATION_KEY_DIRT = "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END"


def _star_frames(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", X(CUST_KEY_DIRT).alias("customer_id"), "o_totalprice")
    c = T(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), "c_name",
                                        X(NATION_KEY_DIRT).alias("nation_id"))
    n = T(spark, sf, "nation").select(F.col("n_nationkey").alias("nation_id"), "n_name")
    return o, c, n


STAR_SQL = f"""
WITH o AS (SELECT o_orderkey, {CUST_KEY_DIRT} AS customer_id, o_totalprice FROM orders),
     c AS (SELECT c_custkey AS customer_id, c_name, {NATION_KEY_DIRT} AS nation_id FROM customer),
     n AS (SELECT n_nationkey AS nation_id, n_name FROM nation),
     oc AS (SELECT o.o_orderkey, coalesce(o.customer_id, c.customer_id) AS customer_id, o.o_totalprice,
                   c.c_name, c.nation_id
            FROM o FULL JOIN c ON o.customer_id IS NOT DISTINCT FROM c.customer_id)
SELECT oc.o_orderkey, oc.customer_id, oc.o_totalprice, oc.c_name,
       coalesce(oc.nation_id, n.nation_id) AS nation_id, n.n_name
FROM oc FULL JOIN n ON oc.nation_id IS NOT DISTINCT FROM n.nation_id
"""


@register("outer_join_three", STAR_SQL)
def outer_join_three(spark, sf):
    o, c, n = _star_frames(spark, sf)
    return combine_sources([o, c, n])


NATION_NULL = "CASE WHEN n_nationkey = 7 THEN NULL ELSE n_nationkey END"


@register("outer_join_null_keys", f"""
WITH c AS (SELECT c_custkey, {NATION_KEY_DIRT} AS nation_id FROM customer),
     n AS (SELECT {NATION_NULL} AS nation_id, n_name FROM nation)
SELECT c.c_custkey, coalesce(c.nation_id, n.nation_id) AS nation_id, n.n_name
FROM c FULL JOIN n ON c.nation_id IS NOT DISTINCT FROM n.nation_id
""")
def outer_join_null_keys(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", X(NATION_KEY_DIRT).alias("nation_id"))
    n = T(spark, sf, "nation").select(X(NATION_NULL).alias("nation_id"), "n_name")
    return combine_sources([c, n], null_keys_match=True)


@register("union_no_key", "SELECT * FROM nation UNION ALL BY NAME SELECT * FROM region")
def union_no_key(spark, sf):
    return combine_sources([T(spark, sf, "nation"), T(spark, sf, "region")])


# ===========================================================================
# gold aggregates (rule driven)
# ===========================================================================

def _gold(spark, sources: dict, rules: list[Rule]) -> dict:
    return run_gold(OrderedDict(sources), rules).tables


def _grule(src, col, tgt_table, tgt=None, ttype="Direct", logic=""):
    return Rule(source_table=f"{src}_silver", source_column=col, target_table=tgt_table,
                target_column=tgt or col, transformation_type=ttype, transformation_logic=logic)


@register("gold_sum", """
SELECT row_number() OVER (ORDER BY l_returnflag, l_linestatus) AS pk_gold_id, l_returnflag, l_linestatus,
       round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def gold_sum(spark, sf):
    li = T(spark, sf, "lineitem")
    rules = [_grule("lineitem", "l_returnflag", "flags"), _grule("lineitem", "l_linestatus", "flags"),
             _grule("lineitem", "l_quantity", "flags", "sum_qty", "Aggregation", "sum of quantity"),
             _grule("lineitem", "l_extendedprice", "flags", "sum_price", "Aggregation", "Total (sum) price")]
    g = _gold(spark, {"lineitem": li}, rules)["flags"]
    return g.select("pk_gold_id", "l_returnflag", "l_linestatus", R2("sum_qty"), R2("sum_price"))


@register("gold_avg", """
SELECT row_number() OVER (ORDER BY p_brand) AS pk_gold_id, p_brand,
       round(avg(p_retailprice), 4) AS avg_price, round(avg(p_size), 4) AS avg_size
FROM part GROUP BY p_brand
""")
def gold_avg(spark, sf):
    p = T(spark, sf, "part")
    rules = [_grule("part", "p_brand", "brands"),
             _grule("part", "p_retailprice", "brands", "avg_price", "Aggregation", "average retail price"),
             _grule("part", "p_size", "brands", "avg_size", "Aggregation", "mean size")]
    g = _gold(spark, {"part": p}, rules)["brands"]
    return g.select("pk_gold_id", "p_brand", R2("avg_price", 4), R2("avg_size", 4))


@register("gold_count", """
SELECT row_number() OVER (ORDER BY event_type) AS pk_gold_id, event_type, count(event_id) AS n_events
FROM events GROUP BY event_type
""")
def gold_count(spark, sf):
    e = T(spark, sf, "events")
    rules = [_grule("events", "event_type", "event_counts"),
             _grule("events", "event_id", "event_counts", "n_events", "Aggregation", "count of events")]
    return _gold(spark, {"events": e}, rules)["event_counts"]


@register("gold_min_max", """
SELECT row_number() OVER (ORDER BY o_orderstatus) AS pk_gold_id, o_orderstatus,
       max(o_totalprice) AS max_price, min(o_orderdate) AS first_date
FROM orders GROUP BY o_orderstatus
""")
def gold_min_max(spark, sf):
    o = T(spark, sf, "orders")
    rules = [_grule("orders", "o_orderstatus", "status_range"),
             _grule("orders", "o_totalprice", "status_range", "max_price", "Aggregation", "max price"),
             _grule("orders", "o_orderdate", "status_range", "first_date", "Aggregation", "min order date")]
    return _gold(spark, {"orders": o}, rules)["status_range"]


PRIO_KEY_NULL = "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END"
URGENT_NULL = "CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_totalprice END"


@register("gold_null_group", f"""
SELECT row_number() OVER (ORDER BY prio NULLS LAST) AS pk_gold_id, prio AS o_orderpriority,
       round(coalesce(sum(price), 0), 2) AS total_price
FROM (SELECT {PRIO_KEY_NULL} AS prio, {URGENT_NULL} AS price FROM orders) t GROUP BY prio
""")
def gold_null_group(spark, sf):
    o = T(spark, sf, "orders").select(X(PRIO_KEY_NULL).alias("o_orderpriority"), X(URGENT_NULL).alias("o_totalprice"))
    rules = [_grule("orders", "o_orderpriority", "prio"),
             _grule("orders", "o_totalprice", "prio", "total_price", "Aggregation", "sum")]
    g = _gold(spark, {"orders": o}, rules)["prio"]
    return g.select("pk_gold_id", "o_orderpriority", R2("total_price"))


@register("gold_star", f"""
WITH j AS ({STAR_SQL})
SELECT row_number() OVER (ORDER BY n_name NULLS LAST) AS pk_gold_id, n_name AS nation,
       round(coalesce(sum(o_totalprice), 0), 2) AS revenue
FROM j GROUP BY n_name
""")
def gold_star(spark, sf):
    o, c, n = _star_frames(spark, sf)
    rules = [_grule("orders", "o_totalprice", "revenue_by_nation", "revenue", "Aggregation", "sum of total price"),
             _grule("customer", "c_name", "revenue_by_nation", "c_name", "Indirect", "lookup"),
             _grule("nation", "n_name", "revenue_by_nation", "nation", "Direct", "group by nation")]
    g = _gold(spark, {"orders": o, "customer": c, "nation": n}, rules)["revenue_by_nation"]
    return g.select("pk_gold_id", "nation", R2("revenue"))


# ===========================================================================
# profile, lists of values, semantic classes, notes, join keys
# ===========================================================================

def _profile_sql(table: str, cols: list[tuple[str, str, bool]], compact: bool = False) -> str:
    parts = []
    for name, dtype, numeric in cols:
        stats = (f"CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max, "
                 f"round(avg({name}), 4) AS mean" if numeric else
                 "CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean")
        nulls = "" if compact else f"count(*) - count({name}) AS null_count, "
        parts.append(f"SELECT '{table}' AS dataset, '{name}' AS \"column\", '{dtype}' AS dtype, {nulls}"
                     f"round(CAST(100 * (count(*) - count({name})) AS DOUBLE) / count(*), 2) AS null_pct, "
                     f"count(DISTINCT {name}) AS unique_count, {stats} FROM {table}")
    return "\nUNION ALL\n".join(parts)


PART_COLS = [("p_partkey", "bigint", True), ("p_name", "string", False), ("p_brand", "string", False),
             ("p_type", "string", False), ("p_size", "int", True), ("p_retailprice", "double", True)]
ORDERS_COLS = [("o_orderkey", "bigint", True), ("o_custkey", "bigint", True), ("o_orderstatus", "string", False),
               ("o_totalprice", "double", True), ("o_orderdate", "timestamp_ntz", False),
               ("o_orderpriority", "string", False)]
LINEITEM_COLS = [("l_orderkey", "bigint", True), ("l_partkey", "bigint", True), ("l_suppkey", "bigint", True),
                 ("l_linenumber", "int", True), ("l_quantity", "double", True),
                 ("l_extendedprice", "double", True), ("l_discount", "double", True), ("l_tax", "double", True),
                 ("l_returnflag", "string", False), ("l_linestatus", "string", False),
                 ("l_shipdate", "timestamp_ntz", False)]


def _prof_out(prof: DataFrame, compact: bool = False) -> DataFrame:
    cols = ["dataset", "column", "dtype"] + ([] if compact else ["null_count"]) + \
        ["null_pct", "unique_count", "min", "max", R2("mean", 4)]
    return prof.select(*cols)


@register("profile_columns", _profile_sql("part", PART_COLS) + "\nUNION ALL\n" + _profile_sql("orders", ORDERS_COLS))
def profile_columns(spark, sf):
    prof, _ = PF.profile(OrderedDict(part=T(spark, sf, "part"), orders=T(spark, sf, "orders")))
    return _prof_out(prof)


@register("profile_json_roundtrip", ORACLE["profile_columns"])
def profile_json_roundtrip(spark, sf):
    """SC-11: the profile of part and orders written as a JSON artifact and
    scanned back with the profile schema; same rows as ``profile_columns``."""
    from .session import stage_path
    from .sources import artifacts as ART
    prof, _ = PF.profile(OrderedDict(part=T(spark, sf, "part"), orders=T(spark, sf, "orders")))
    path = ART.write_json(prof, stage_path(spark, "profile-json"))
    return _prof_out(ART.read_json(spark, path, PF.PROFILE_SCHEMA))


@register("profile_compact", _profile_sql("lineitem", LINEITEM_COLS, compact=True))
def profile_compact(spark, sf):
    prof, _ = PF.profile(OrderedDict(lineitem=T(spark, sf, "lineitem")), compact=True)
    return _prof_out(prof, compact=True)


def _lov_sql(table, cols):
    parts = []
    for c in cols:
        parts.append(f"SELECT '{table}' AS dataset, '{c}' AS \"column\", "
                     f"count(*) OVER () AS unique_count, value, freq FROM "
                     f"(SELECT {c} AS value, count(*) AS freq FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) g")
    return "\nUNION ALL\n".join(parts)


LOV_SQL = f"""
WITH x AS (
{_lov_sql('part', ['p_name', 'p_brand', 'p_type'])}
UNION ALL
{_lov_sql('orders', ['o_orderstatus', 'o_orderpriority'])}
)
SELECT * FROM x WHERE unique_count < 50
"""


@register("lov", LOV_SQL)
def lov(spark, sf):
    _, lv = PF.profile(OrderedDict(part=T(spark, sf, "part"), orders=T(spark, sf, "orders")))
    return lv


def _catalog_all(spark, sf):
    return PF.catalog_frame(spark, OrderedDict((t, T(spark, sf, t)) for t in TABLE_NAMES))


# The column names and (DuckDB) types of the given tables, in
# file order, as published with the test data.
TABLE_SCHEMAS = {
    "region": [("r_regionkey", "integer"), ("r_name", "varchar")],
    "nation": [("n_nationkey", "integer"), ("n_name", "varchar"), ("n_regionkey", "integer")],
    "customer": [("c_custkey", "bigint"), ("c_name", "varchar"), ("c_nationkey", "integer"),
                 ("c_acctbal", "double"), ("c_mktsegment", "varchar")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "varchar"), ("s_nationkey", "integer"),
                 ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "varchar"), ("p_brand", "varchar"), ("p_type", "varchar"),
             ("p_size", "integer"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "varchar"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "varchar")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "integer"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "varchar"),
                 ("l_linestatus", "varchar"), ("l_shipdate", "timestamp")],
    "events": [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"), ("event_type", "varchar"),
               ("value", "double"), ("props", "varchar")],
    "documents": [("doc_id", "bigint"), ("text", "varchar"), ("lang", "varchar"), ("source", "varchar"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "float[]"), ("label", "integer")],
    "pages": [("page_id", "bigint"), ("url", "varchar"), ("html", "varchar")],
    "benchmark": [("item_id", "bigint"), ("text", "varchar")],
    "labels": [("doc_id", "bigint"), ("quality", "integer"), ("toxic", "integer")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "varchar"), ("text", "varchar")],
}


def _columns_sql(tables: list[str], first_no: int = 0) -> str:
    """(t, table_no, column_no, c, dt) rows of the given tables as VALUES."""
    vals = ", ".join(f"('{t}', {ti + first_no}, {ci}, '{c}', '{dt}')"
                     for ti, t in enumerate(tables) for ci, (c, dt) in enumerate(TABLE_SCHEMAS[t]))
    return f"SELECT * FROM (VALUES {vals}) AS ic(t, table_no, column_no, c, dt)"




@register("semantic_classes", f"""
SELECT t AS dataset, c AS "column",
  CASE WHEN lower(c) = 'id' OR lower(c) LIKE '%\\_id' ESCAPE '\\' THEN 'Identifier column'
       WHEN lower(c) LIKE '%date%' OR lower(c) LIKE '%time%' THEN 'Date/time column'
       WHEN lower(c) LIKE '%price%' OR lower(c) LIKE '%amount%' OR lower(c) LIKE '%cost%'
         OR lower(c) LIKE '%revenue%' OR lower(c) LIKE '%total%' THEN 'Monetary/numeric measure'
       WHEN lower(c) LIKE '%qty%' OR lower(c) LIKE '%quantity%' THEN 'Quantity measure'
       WHEN dt LIKE '%int%' OR dt LIKE '%float%' OR dt LIKE '%double%' OR dt LIKE '%decimal%'
         THEN 'Numeric attribute'
       ELSE 'Categorical/text attribute' END AS meaning
FROM ({_columns_sql(TABLE_NAMES)}) ic
""")
def semantic_classes(spark, sf):
    """FN-12 as run inside RX-04: classes over the profile of every table.
    Names and types decide, so no distinct values are counted."""
    prof, _ = PF.profile(OrderedDict((t, T(spark, sf, t)) for t in TABLE_NAMES), with_lov=False, distinct=False)
    return PF.semantic_classes(prof)


ORD_DIRT = {"o_orderpriority": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END",
            "o_totalprice": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END",
            "o_custkey": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END"}


def _dirty_orders(spark, sf):
    o = T(spark, sf, "orders")
    return o.select(*[X(ORD_DIRT[c]).alias(c) if c in ORD_DIRT else F.col(c) for c in o.columns])


_DIRTY_ORDERS_SQL = ("SELECT " + ", ".join(f"{ORD_DIRT[c]} AS {c}" if c in ORD_DIRT else c
                                           for c, _, _ in ORDERS_COLS) + " FROM orders")


def _null_pct_sql(src_sql: str, table: str, cols: list[str]) -> str:
    parts = [f"SELECT '{table}' AS dataset, '{c}' AS \"column\", "
             f"round(CAST(100 * (count(*) - count({c})) AS DOUBLE) / count(*), 2) AS null_pct FROM d" for c in cols]
    return f"WITH d AS ({src_sql})\n" + "\nUNION ALL\n".join(parts)


@register("quality_notes", f"""
WITH p AS ({_null_pct_sql(_DIRTY_ORDERS_SQL, 'orders', [c for c, _, _ in ORDERS_COLS])})
SELECT dataset || '.' || "column" || ' has high null percentage (' || CAST(null_pct AS VARCHAR) || '%).' AS note
FROM p WHERE null_pct > 20
UNION ALL
SELECT 'No major deterministic quality issues detected in profiling fallback.' AS note
WHERE NOT EXISTS (SELECT 1 FROM p WHERE null_pct > 20)
""")
def quality_notes(spark, sf):
    prof, _ = PF.profile(OrderedDict(orders=_dirty_orders(spark, sf)), with_lov=False)
    return PF.quality_notes(prof)


def _id_pairs(tables: list[str]) -> list[tuple[str, str, str]]:
    """(left table, right table, column) for every pair of tables sharing an
    id-like column name, in table order."""
    idlike = {t: [c for c, _ in TABLE_SCHEMAS[t] if c.lower() == "id" or c.lower().endswith("_id")]
              for t in tables}
    return [(l, r, c) for i, l in enumerate(tables) for r in tables[i + 1:] for c in idlike[l] if c in idlike[r]]


def _key_overlap_sql(tables: list[str]) -> str:
    parts = [f"""SELECT '{l}' AS left_dataset, '{c}' AS left_column, '{r}' AS right_dataset, '{c}' AS right_column,
       'medium' AS confidence, count(*) AS left_keys, count(rk.k) AS matched_keys
FROM (SELECT DISTINCT {c} AS k FROM {l} WHERE {c} IS NOT NULL) lk
LEFT JOIN (SELECT DISTINCT {c} AS k FROM {r} WHERE {c} IS NOT NULL) rk ON lk.k = rk.k"""
             for l, r, c in _id_pairs(tables)]
    return "\nUNION ALL\n".join(parts)


@register("join_keys", _key_overlap_sql(TABLE_NAMES))
def join_keys(spark, sf):
    """JN-04: candidate pairs from the schemas, each measured on the data
    (distinct left keys and how many of them the right side holds)."""
    tables = OrderedDict((t, T(spark, sf, t)) for t in TABLE_NAMES)
    return measure_key_overlap(tables, join_key_candidates(PF.catalog_frame(spark, tables)))


@register("profile_preview", """
SELECT 'lineitem' AS dataset, count(*) AS rows, 11 AS columns FROM lineitem
""")
def profile_preview(spark, sf):
    pv = PF.preview("lineitem", T(spark, sf, "lineitem"))
    return pv.select("dataset", "rows", "columns").distinct()


# ===========================================================================
# rule generation, approval and coverage
# ===========================================================================

def _info_cols(tables: list[str], first_no: int = 0) -> str:
    return _columns_sql(tables, first_no)


RULE_COLS_SQL = ("source_schema, source_table, source_column, target_schema, target_table, target_column, "
                 "transformation_type, transformation_logic, rule_no")

BRONZE_RULES_SQL = f"""
SELECT 'raw' AS source_schema, t AS source_table, c AS source_column, 'bronze' AS target_schema,
       t || '_bronze' AS target_table, c AS target_column, 'Direct' AS transformation_type,
       CASE WHEN dt LIKE '%int%' THEN '{RG.BRONZE_LOGIC_INT}'
            WHEN dt LIKE '%float%' OR dt LIKE '%double%' OR dt LIKE '%decimal%' THEN '{RG.BRONZE_LOGIC_FLOAT}'
            WHEN dt LIKE '%date%' OR dt LIKE '%time%' THEN '{RG.BRONZE_LOGIC_DATE}'
            ELSE '{RG.BRONZE_LOGIC_DEFAULT}' END AS transformation_logic,
       CAST(table_no * 100000 + column_no AS BIGINT) AS rule_no
FROM ({_info_cols(['orders', 'customer'])}) ic
UNION ALL
SELECT 'raw', t, '', 'bronze', t || '_bronze', x.c, 'Indirect', x.logic, CAST(i * 100000 + x.k AS BIGINT)
FROM (VALUES ('orders', 0), ('customer', 1)) AS tt(t, i),
     (VALUES ('_load_timestamp', '{RG.LOAD_TS_LOGIC}', 99998), ('_source_file', '{RG.SOURCE_FILE_LOGIC}', 99999))
     AS x(c, logic, k)
"""


def _bronze_rules(spark, sf):
    tables = OrderedDict(orders=T(spark, sf, "orders"), customer=T(spark, sf, "customer"))
    prof, _ = PF.profile(tables, with_lov=False)
    order = spark.createDataFrame([(n, i) for i, n in enumerate(tables)], "dataset string, dataset_no int")
    return RG.bronze_rules(prof.join(F.broadcast(order), "dataset"))


@register("rules_bronze", BRONZE_RULES_SQL)
def rules_bronze(spark, sf):
    return _bronze_rules(spark, sf)


def _silver_logic_sql(name: str, dt: str) -> str:
    n = f"lower({name})"
    is_id = f"({n} = 'id' OR {n} LIKE '%\\_id' ESCAPE '\\' OR {n} LIKE 'id\\_%' ESCAPE '\\')"
    is_int = f"({dt} IN ('tinyint', 'smallint', 'integer', 'bigint'))"
    is_num = f"({is_int} OR {dt} IN ('float', 'double') OR {dt} LIKE 'decimal%')"
    is_date = f"({n} LIKE '%date%' OR {n} LIKE '%time%' OR {dt} LIKE 'timestamp%' OR {dt} = 'date')"
    return (f"CASE WHEN {is_id} AND {is_int} THEN '{RG.SILVER_ID_INT}' WHEN {is_id} THEN '{RG.SILVER_ID_TEXT}' "
            f"WHEN {is_date} THEN '{RG.SILVER_DATE}' WHEN {is_num} THEN '{RG.SILVER_NUM}' "
            f"ELSE '{RG.SILVER_TEXT}' END")


SILVER_RULES_SQL = f"""
WITH cat AS (
  SELECT t || '_bronze' AS t, table_no, column_no, c, dt FROM ({_info_cols(['orders', 'customer'])}) ic
  UNION ALL
  SELECT tt.t || '_bronze', tt.i, tt.n + x.k, x.c, x.dt
  FROM (VALUES ('orders', 0, 6), ('customer', 1, 5)) AS tt(t, i, n),
       (VALUES ('_source_file', 0, 'varchar'), ('_load_timestamp', 1, 'timestamp')) AS x(c, k, dt)
)
SELECT 'bronze' AS source_schema, t || '.parquet' AS source_table, c AS source_column, 'silver' AS target_schema,
       replace(t, '_bronze', '_silver') AS target_table, c AS target_column, 'Direct' AS transformation_type,
       {_silver_logic_sql('c', 'dt')} AS transformation_logic,
       CAST(table_no * 100000 + column_no + 1 AS BIGINT) AS rule_no
FROM cat
UNION ALL
SELECT 'bronze', t || '_bronze.parquet', '', 'silver', t || '_silver', 'pk_' || t || '_bronze_silver_id', 'Indirect',
       '{RG.KEY_LOGIC}', CAST(i * 100000 AS BIGINT)
FROM (VALUES ('orders', 0), ('customer', 1)) AS tt(t, i)
"""


@register("rules_csv_roundtrip", f"""
SELECT source_schema, source_table, source_column, target_schema, target_table, target_column,
       transformation_type, transformation_logic,
       CAST(row_number() OVER (ORDER BY rule_no) - 1 AS BIGINT) AS rule_no
FROM ({BRONZE_RULES_SQL}) r
""")
def rules_csv_roundtrip(spark, sf):
    """SC-09 then SC-07/SC-08: the generated bronze rules written as the
    reviewable CSV (fixed column order, rule order, blanks as "") and read
    back; ``rule_no`` becomes the position in the file."""
    from .session import stage_path
    from .sources import artifacts as ART
    path = ART.write_rules(_bronze_rules(spark, sf), stage_path(spark, "rules-csv"))
    return ART.read_rules(spark, path)


@register("rules_silver", SILVER_RULES_SQL)
def rules_silver(spark, sf):
    from .sources.tables import read_parquet
    raw = OrderedDict(orders=read_parquet(spark, os.path.join(sf, "orders.parquet")),
                      customer=read_parquet(spark, os.path.join(sf, "customer.parquet")))
    rules = collect_rules(_bronze_rules(spark, sf))
    bronze = run_bronze(raw, rules, {"orders": "orders.parquet", "customer": "customer.parquet"}).tables
    return RG.silver_rules(RG.column_catalog(spark, bronze))


@register("rules_gold", f"""
SELECT 'silver' AS source_schema, t || '_silver' AS source_table, c AS source_column, 'gold' AS target_schema,
       t || '_gold' AS target_table, c AS target_column, 'Direct' AS transformation_type,
       '{RG.GOLD_LOGIC}' AS transformation_logic, CAST((table_no + 1) * 100000 + column_no AS BIGINT) AS rule_no
FROM ({_info_cols(['orders', 'customer'])}) ic
UNION ALL
SELECT 'silver', '', '', 'gold', 'gold_fallback', 'pk_gold_id', 'Indirect', '{RG.KEY_LOGIC}', CAST(0 AS BIGINT)
""")
def rules_gold(spark, sf):
    tables = OrderedDict(orders_silver=T(spark, sf, "orders"), customer_silver=T(spark, sf, "customer"))
    return RG.gold_rules(RG.column_catalog(spark, tables, with_nulls=False))


@register("rules_approved", f"SELECT * FROM ({BRONZE_RULES_SQL}) r WHERE rule_no % 5 <> 0")
def rules_approved(spark, sf):
    r = _bronze_rules(spark, sf).withColumn(
        "approved", F.expr("CASE WHEN rule_no % 5 = 0 THEN 'false' WHEN rule_no % 5 = 1 THEN NULL ELSE 'true' END"))
    return approved(r)


EDIT_SRC = "CASE WHEN rule_no % 4 = 0 AND source_column <> '' THEN upper(source_column) ELSE source_column END"


@register("rules_uncovered", f"""
SELECT source_schema, source_table, {EDIT_SRC} AS source_column, target_schema, target_table, target_column,
       transformation_type, transformation_logic, rule_no
FROM ({BRONZE_RULES_SQL}) r WHERE rule_no % 4 = 0 AND source_column <> ''
""")
def rules_uncovered(spark, sf):
    r = _bronze_rules(spark, sf).withColumn("source_column", X(EDIT_SRC))
    cat = RG.column_catalog(spark, OrderedDict(orders=T(spark, sf, "orders"), customer=T(spark, sf, "customer")),
                            with_nulls=False)
    return RG.uncovered_rules(r, cat)


# ===========================================================================
# quality reports
# ===========================================================================

def _li_dup(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                         "l_quantity", "l_returnflag")
    return li.unionByName(li.where("l_orderkey % 10 = 0"))


def _dup_sql(src: str) -> str:
    return f"(SELECT count(*) FROM ({src}) a) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({src}) b) c)"


@register("quality_summary", f"""
SELECT 'gold' AS layer_name, 'orders' AS "table", count(*) AS row_count, CAST(6 AS BIGINT) AS column_count,
       CAST({_dup_sql('SELECT * FROM orders')} AS BIGINT) AS duplicate_row_count, '' AS warnings
FROM orders
UNION ALL
SELECT 'gold', 'lineitem', count(*), CAST(11 AS BIGINT),
       CAST({_dup_sql('SELECT * FROM lineitem')} AS BIGINT), '' FROM lineitem
""")
def quality_summary(spark, sf):
    files, _ = QL.validate_layer(spark, "gold", OrderedDict(orders=T(spark, sf, "orders"),
                                                            lineitem=T(spark, sf, "lineitem")), "r1")
    return QL.flatten(files)


@register("quality_nulls", _null_pct_sql(_DIRTY_ORDERS_SQL, "orders", [c for c, _, _ in ORDERS_COLS])
          .replace("AS dataset", "AS \"table\""))
def quality_nulls(spark, sf):
    files, _ = QL.validate_layer(spark, "silver", OrderedDict(orders=_dirty_orders(spark, sf)), "r1")
    return files.select(F.col("file_path").alias("table"),
                        F.explode("null_pct_by_column").alias("column", "null_pct"))


@register("quality_duplicates", f"""
SELECT 'lineitem' AS "table", CAST((SELECT count(*) FROM ({LI_DUP}) a) AS BIGINT) AS row_count,
       CAST({_dup_sql(LI_DUP)} AS BIGINT) AS duplicate_row_count,
       'Duplicate rows detected : ' || CAST({_dup_sql(LI_DUP)} AS VARCHAR) AS warnings
""")
def quality_duplicates(spark, sf):
    files, _ = QL.validate_layer(spark, "silver", OrderedDict(lineitem=_li_dup(spark, sf)), "r1")
    return QL.flatten(files).select("table", "row_count", "duplicate_row_count", "warnings")


@register("quality_columns", """
SELECT 'orders' AS "table", 'o_comment' AS missing, 'o_orderstatus' AS unexpected,
       'Missing Expected Columns detected.' AS warnings
""")
def quality_columns(spark, sf):
    o = T(spark, sf, "orders")
    expected = [c for c in o.columns if c != "o_orderstatus"] + ["o_comment"]
    files, _ = QL.validate_layer(spark, "gold", OrderedDict(orders=o), "r1", expected={"orders": expected})
    return files.select(F.col("file_path").alias("table"),
                        F.concat_ws(",", "missing_expected_columns").alias("missing"),
                        F.concat_ws(",", "unexpected_columns").alias("unexpected"),
                        F.concat_ws("; ", "warnings").alias("warnings"))


@register("quality_rollup", f"""
WITH w AS (
  SELECT CASE WHEN {_dup_sql('SELECT * FROM orders')} > 0 THEN 1 ELSE 0 END AS w
  UNION ALL SELECT CASE WHEN {_dup_sql(LI_DUP)} > 0 THEN 1 ELSE 0 END
  UNION ALL SELECT CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey < 0) = 0 THEN 1 ELSE 0 END)
SELECT 'r1' AS run_id, 'gold' AS layer_name, CAST(3 AS BIGINT) AS file_count,
       CAST(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) AS BIGINT) AS files_with_warnings,
       CAST(sum(w) AS BIGINT) AS total_warnings,
       CASE WHEN sum(w) > 0 THEN 'warning' ELSE 'passed' END AS status
FROM w
""")
def quality_rollup(spark, sf):
    o = T(spark, sf, "orders")
    tables = OrderedDict(orders=o, lineitem_dup=_li_dup(spark, sf), empty=o.where("o_orderkey < 0"))
    files, _ = QL.validate_layer(spark, "gold", tables, "r1")
    return QL.rollup(files)


# ===========================================================================
# ad-hoc SQL over registered tables (same text on both engines)
# ===========================================================================

SQL_TEXTS = {
    "sql_filter_sort": """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice > 200000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey""",
    "sql_window": """
SELECT o_custkey, o_orderkey,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS order_seq,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running_total
FROM orders""",
    "sql_rollup": """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_set_ops": """
SELECT c_nationkey AS nationkey FROM customer
INTERSECT
SELECT s_nationkey FROM supplier
EXCEPT
SELECT n_nationkey FROM nation WHERE n_regionkey = 0""",
    "sql_subquery": """
WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, b.n
FROM customer c JOIN big b ON b.o_custkey = c.c_custkey
WHERE b.n > (SELECT avg(n) FROM big)
  AND EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey IN
              (SELECT r_regionkey FROM region WHERE r_name <> 'ASIA'))""",
}


def _views(spark, sf, names=None):
    register_views(OrderedDict((t, T(spark, sf, t)) for t in (names or TABLE_NAMES)))


def _sql_query(key):
    def run(spark, sf):
        _views(spark, sf)
        return spark.sql(AN.guarded(SQL_TEXTS[key]))
    return run


for _k, _sql in SQL_TEXTS.items():
    register(_k, _sql)(_sql_query(_k))


STATUS_SQL = {
    1: "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'",
    2: "SELECT o_orderkey FROM orders WHERE o_totalprice < 0",
    3: "DROP TABLE orders",
    4: "SELECT no_such_column FROM orders",
}


@register("sql_statuses", """
SELECT 1 AS query_no, 'ok_non_empty' AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS row_count
UNION ALL SELECT 2, 'ok_empty', CAST(0 AS BIGINT)
UNION ALL SELECT 3, 'sql_error', CAST(0 AS BIGINT)
UNION ALL SELECT 4, 'sql_error', CAST(0 AS BIGINT)
""")
def sql_statuses(spark, sf):
    _views(spark, sf, ["orders"])
    rows = []
    for no, text in STATUS_SQL.items():
        out = AN.run_sql(spark, text, count=True)
        rows.append((no, out.status, int(out.row_count)))
    return spark.createDataFrame(rows, "query_no int, status string, row_count long")


# ===========================================================================
# questions -> answers (deterministic intent analysis)
# ===========================================================================

def _gold_tables(spark, sf):
    """Gold-style tables with readable column names (as the layers produce)."""
    o = T(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_totalprice").alias("total_price"),
        F.col("o_orderdate").alias("order_date"), F.col("o_orderpriority").alias("order_priority"))
    e = T(spark, sf, "events")
    return OrderedDict(orders_gold=o, events_gold=e)


def _intent(question, faithful_time=True):
    def run(spark, sf):
        ans = AN.answer(_gold_tables(spark, sf), question, faithful_time=faithful_time)
        return ans.df.select(*[R2(c) if c == "value" and ans.op != "count" else F.col(c) for c in ans.df.columns])
    return run


register("intent_group", """
SELECT order_priority, round(coalesce(sum(o_totalprice), 0), 2) AS value
FROM (SELECT o_orderpriority AS order_priority, o_totalprice FROM orders) t
GROUP BY order_priority ORDER BY value DESC, order_priority LIMIT 20
""")(_intent("total price by order priority"))

register("intent_scalar", """
SELECT round(coalesce(CAST(avg(value) AS DOUBLE), 0.0), 2) AS value FROM events
""")(_intent("average event value"))

register("intent_count", """
SELECT event_type, count(*) AS value FROM events GROUP BY event_type ORDER BY value DESC, event_type LIMIT 20
""")(_intent("how many events by event type"))

register("intent_trend", """
SELECT date_trunc('day', ts) AS ts, round(coalesce(sum(value), 0), 2) AS value
FROM events GROUP BY date_trunc('day', ts)
""")(_intent("daily value trend over time", faithful_time=False))

register("intent_pick_table", """
SELECT order_status, round(max(o_totalprice), 2) AS value
FROM (SELECT o_orderstatus AS order_status, o_totalprice FROM orders) t
GROUP BY order_status ORDER BY value DESC, order_status LIMIT 20
""")(_intent("highest total price per order status"))


@register("pipeline_full_run", """
SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0), 2) AS value
FROM orders GROUP BY o_orderpriority ORDER BY value DESC, o_orderpriority LIMIT 20
""")
def pipeline_full_run(spark, sf):
    """RX-06 end to end on ``orders``: profile, generated rules for all
    three layers, each layer written and read back with its quality report,
    then the question answered on the gold table."""
    from .plans.pipeline import run_pipeline
    from .session import stage_path
    res = run_pipeline(spark, [os.path.join(sf, "orders.parquet")], "total totalprice by orderpriority",
                       root=stage_path(spark, "pipeline"), run_id="r1")
    return res.answer.df.select("o_orderpriority", R2("value"))


@register("intent_sql_text", """
SELECT order_priority, round(coalesce(sum(o_totalprice), 0), 2) AS value
FROM (SELECT o_orderpriority AS order_priority, o_totalprice FROM orders) t
GROUP BY order_priority ORDER BY value DESC, order_priority LIMIT 20
""")
def intent_sql_text(spark, sf):
    """RX-05 emits the SQL it stands for: run that text on the same tables."""
    tables = _gold_tables(spark, sf)
    register_views(tables)
    ans = AN.answer(tables, "total price by order priority")
    return AN.run_sql(spark, ans.sql).df.select("order_priority", R2("value"))


@register("answer_catalog", """
SELECT 'orders_gold' AS table_name, count(*) AS row_count FROM orders
UNION ALL SELECT 'events_gold', count(*) FROM events
""")
def answer_catalog(spark, sf):
    cat = AN.catalog(spark, _gold_tables(spark, sf), "total price by order priority")
    return cat.select("table_name", "row_count")


# ===========================================================================
# chart frames
# ===========================================================================

@register("chart_bar", """
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders
WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority ORDER BY o_totalprice DESC, o_orderpriority LIMIT 10
""")
def chart_bar(spark, sf):
    f = CH.chart_frame(T(spark, sf, "orders"), {"type": "bar", "x_column": "o_orderpriority",
                                                "y_column": "o_totalprice"})
    return f.select("o_orderpriority", R2("o_totalprice"))


@register("chart_counts", """
SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY l_returnflag ORDER BY count DESC, l_returnflag LIMIT 10
""")
def chart_counts(spark, sf):
    return CH.chart_frame(T(spark, sf, "lineitem"), {"type": "bar", "x_column": "l_returnflag"})


@register("chart_pie", """
SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice,
       round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share
FROM orders GROUP BY o_orderstatus
""")
def chart_pie(spark, sf):
    f = CH.chart_frame(T(spark, sf, "orders"), {"type": "pie", "labels_column": "o_orderstatus",
                                                "values_column": "o_totalprice"})
    return f.select("o_orderstatus", R2("o_totalprice"), R2("share", 6))


@register("chart_trend", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
       round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n
FROM lineitem
""")
def chart_trend(spark, sf):
    t = CH.trend(T(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return t.select(R2("slope", 4), R2("intercept", 4), F.col("n").cast("long").alias("n"))


@register("chart_auto", """
SELECT l_returnflag, l_orderkey FROM lineitem ORDER BY l_orderkey, l_linenumber, l_returnflag LIMIT 20
""")
def chart_auto(spark, sf):
    kind, f = CH.auto_chart(T(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber"),
                            ["l_orderkey", "l_linenumber", "l_returnflag"])
    return f


# ===========================================================================
# run-log analytics over events read as log rows
# ===========================================================================

K_SQL_SPARK = "CAST(get_json_object(props, '$.k') AS INT)"
K_SQL_DUCK = "CAST(json_extract_string(props, '$.k') AS INTEGER)"


def _log_cols(k: str) -> dict:
    return {
        "run_id": "concat('run-', CAST(user_id % 10 AS VARCHAR))",
        "action": (f"concat(event_type, '_', CASE WHEN {k} % 3 = 0 THEN 'started' WHEN {k} % 3 = 1 "
                   f"THEN 'completed' ELSE 'fallback_used' END)"),
        "status": (f"CASE WHEN {k} % 5 = 0 THEN 'failed' WHEN {k} % 5 = 1 THEN 'success' WHEN {k} % 5 = 2 "
                   f"THEN 'running' WHEN {k} % 5 = 3 THEN 'fallback_report_ready' ELSE '' END"),
        "rationale": f"CASE WHEN {k} % 2 = 0 THEN concat('k=', CAST({k} AS VARCHAR)) ELSE '' END",
        "message": (f"CASE event_type WHEN 'error' THEN concat('Rate limit reached. Please try again in ', "
                    f"CAST({k} AS VARCHAR), '.5s') "
                    f"WHEN 'click' THEN concat('Limit on tokens per minute (TPM): try again in 1m', "
                    f"CAST({k} AS VARCHAR), 's') "
                    f"WHEN 'view' THEN concat('tool_use_failed failed_generation: ''', props, '''') "
                    f"WHEN 'signup' THEN 'Error code: 413 - request too large for model tokens' "
                    f"ELSE concat('context_length_exceeded at step ', CAST({k} AS VARCHAR)) END"),
    }


def _audit_frame(spark, sf) -> DataFrame:
    """Events as audit rows: (timestamp, run_id, agent, action, extra map)."""
    cols = {n: X(e.replace("VARCHAR", "STRING")) for n, e in _log_cols(K_SQL_SPARK).items()}
    e = T(spark, sf, "events")
    return e.select("event_id", F.col("ts").alias("timestamp"), cols["run_id"].alias("run_id"),
                    F.col("event_type").alias("agent"), cols["action"].alias("action"),
                    F.create_map(F.lit("status"), cols["status"], F.lit("rationale"), cols["rationale"],
                                 F.lit("detail"), F.col("event_type"), F.lit("phase"), F.lit("")).alias("extra"),
                    cols["message"].alias("message"), F.col("value").alias("duration_seconds"))


_LC = _log_cols(K_SQL_DUCK)
_AUDIT_SQL = (f"SELECT event_id, ts AS timestamp, {_LC['run_id']} AS run_id, event_type AS agent, "
              f"{_LC['action']} AS action, {_LC['status']} AS status, {_LC['rationale']} AS rationale, "
              f"event_type AS detail, {_LC['message']} AS message, value AS duration_seconds FROM events")


@register("log_status_class", f"""
WITH a AS ({_AUDIT_SQL})
SELECT event_id,
       CASE WHEN lower(status) IN ('failed', 'error') OR lower(action) LIKE '%failed%' OR lower(action) LIKE '%error%'
              THEN 'is-failed'
            WHEN lower(status) IN ('success', 'completed') THEN 'is-success'
            WHEN lower(status) IN ('in_progress', 'started', 'running') THEN 'is-progress'
            ELSE 'is-neutral' END AS status_class,
       substr(CAST(timestamp AS VARCHAR), 12, 8) AS time_text,
       coalesce(nullif(rationale, ''), nullif(detail, ''), 'No rationale captured') AS reason,
       coalesce(nullif(status, ''), '-') AS status
FROM a
""")
def log_status_class(spark, sf):
    trail = LG.audit_trail(_audit_frame(spark, sf).drop("message", "duration_seconds"))
    return trail.select("event_id", "status_class", "time_text", "reason", "status")


@register("log_audit_json", ORACLE["log_status_class"])
def log_audit_json(spark, sf):
    """SC-14 + LG-01: the audit rows written as JSON lines by Spark (one
    file per task, in the checkpoint folder), scanned back with the audit
    schema and turned into the trail; same result as ``log_status_class``."""
    from .session import stage_path
    a = _audit_frame(spark, sf)
    path = stage_path(spark, "audit-jsonl")
    (a.select(F.col("timestamp").cast("timestamp").alias("timestamp"), "run_id", "agent", "action", "extra",
              F.col("event_id").alias("seq"))
     .write.option("timestampFormat", LG.TS_FORMAT).json(path))
    trail = LG.audit_trail(LG.read_audit(spark, path))
    return trail.select(F.col("seq").alias("event_id"), "status_class", "time_text", "reason", "status")


@register("log_error_class", f"""
WITH a AS ({_AUDIT_SQL})
SELECT event_id,
  CASE WHEN lower(message) LIKE '%tokens per day%' OR lower(message) LIKE '%(tpd)%' OR lower(message) LIKE '%quota exhausted%'
         THEN 'tpd_hard_block'
       WHEN lower(message) LIKE '%request too large%' OR lower(message) LIKE '%payload too large%'
         OR (message LIKE '%413%' AND lower(message) LIKE '%tokens%') THEN 'request_too_large_shrink'
       WHEN lower(message) LIKE '%tokens per minute%' OR lower(message) LIKE '%(tpm)%' THEN 'tpm_window_retry'
       WHEN lower(message) LIKE '%tool\\_use\\_failed%' ESCAPE '\\' OR lower(message) LIKE '%tool call validation failed%'
         OR lower(message) LIKE '%attempted to call tool%' OR lower(message) LIKE '%failed\\_generation%' ESCAPE '\\'
         THEN 'tool_schema_hard_block'
       WHEN lower(message) LIKE '%context\\_length\\_exceeded%' ESCAPE '\\' THEN 'context_length_hard_block'
       WHEN lower(message) LIKE '%rate limit%' OR lower(message) LIKE '%rate\\_limit%' ESCAPE '\\'
         OR message LIKE '%429%' OR lower(message) LIKE '%tokens per%' THEN 'rate_limit_other'
       ELSE 'other_transient' END AS error_class,
  CASE WHEN regexp_matches(lower(message), 'try again in\\s+[0-9]+(\\.[0-9]+)?s')
         THEN CAST(regexp_extract(lower(message), 'try again in\\s+([0-9]+(?:\\.[0-9]+)?)s', 1) AS DOUBLE)
       WHEN regexp_matches(lower(message), 'try again in\\s+[0-9]+m[0-9]+(\\.[0-9]+)?s')
         THEN CAST(regexp_extract(lower(message), 'try again in\\s+([0-9]+)m', 1) AS DOUBLE) * 60
              + CAST(regexp_extract(lower(message), 'try again in\\s+[0-9]+m([0-9]+(?:\\.[0-9]+)?)s', 1) AS DOUBLE)
       END AS retry_after,
  CASE WHEN length(message) = 0 THEN 0 ELSE greatest(1, length(message) // 4) END AS tokens,
  CASE WHEN event_type = 'view' THEN substr(props, 1, 500) ELSE '' END AS failed_generation
FROM a JOIN events USING (event_id)
""")
def log_error_class(spark, sf):
    a = _audit_frame(spark, sf)
    m = F.col("message")
    return a.select("event_id", TX.error_class(m).alias("error_class"),
                    TX.retry_after_seconds(m).alias("retry_after"),
                    TX.token_estimate(m).alias("tokens"),
                    TX.failed_generation(m).alias("failed_generation"))


@register("log_latest", f"""
WITH a AS ({_AUDIT_SQL}),
     r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY timestamp DESC) AS rn FROM a)
SELECT run_id, timestamp AS latest_at, agent, action FROM r WHERE rn = 1
""")
def log_latest(spark, sf):
    out = LG.latest_per_run(_audit_frame(spark, sf))
    return out.select("run_id", "latest_at", "latest.agent", "latest.action")


@register("log_fallback_runs", f"""
WITH a AS ({_AUDIT_SQL})
SELECT run_id, bool_or(status = 'fallback_report_ready' OR lower(action) LIKE '%fallback%') AS fallback_seen
FROM a GROUP BY run_id
""")
def log_fallback_runs(spark, sf):
    return LG.fallback_runs(_audit_frame(spark, sf))


@register("log_trace_durations", f"""
WITH a AS ({_AUDIT_SQL})
SELECT agent, status, count(*) AS calls, max(duration_seconds) AS max_seconds,
       round(median(duration_seconds), 4) AS median_seconds
FROM a GROUP BY agent, status
""")
def log_trace_durations(spark, sf):
    a = _audit_frame(spark, sf).select("agent", F.col("extra")["status"].alias("status"), "duration_seconds")
    out = LG.trace_durations(a)
    return out.select("agent", "status", "calls", "max_seconds", R2("median_seconds", 4))


# ===========================================================================
# messages, document store, token estimates
# ===========================================================================

GOOD_PAYLOAD = ("(conv_id + turn) % 3 = 0 AND role = 'assistant'")
BAD_PAYLOAD = ("(conv_id + turn) % 3 = 1")


def _messages(spark, sf) -> DataFrame:
    c = T(spark, sf, "conversations")
    good = F.concat(F.col("text"), F.lit("\n```json\n{\"direct_answer\": \"answer "),
                    F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"),
                    F.lit("\", \"detailed_analysis\": \"turn "), F.col("turn").cast("string"),
                    F.lit("\"}\n```"))
    bad = F.concat(F.col("text"), F.lit("\n```json {\"direct_answer\": broken"))
    return c.select("conv_id", "turn", "role",
                    F.when(X(GOOD_PAYLOAD), good).when(X(BAD_PAYLOAD), bad).otherwise(F.col("text")).alias("text"))


@register("message_last_payload", f"""
WITH g AS (SELECT conv_id, turn FROM conversations WHERE {GOOD_PAYLOAD}),
     m AS (SELECT conv_id, max(turn) AS turn FROM g GROUP BY conv_id)
SELECT conv_id, turn, 'answer ' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS direct_answer,
       CAST(NULL AS VARCHAR) AS charts, 'turn ' || CAST(turn AS VARCHAR) AS detailed_analysis
FROM m
""")
def message_last_payload(spark, sf):
    return LG.last_payload(_messages(spark, sf))


PAYLOAD_SQL_SPARK = ("CASE WHEN turn % 2 = 0 THEN concat('{\"direct_answer\": \"a', CAST(conv_id AS STRING), "
                     "'\", \"charts\": [{\"type\": \"bar\"}, \"bad\", 3]}') "
                     "ELSE '{\"direct_answer\": {\"answer\": \"b\", \"why\": \"w\"}, \"charts\": [], "
                     "\"detailed_analysis\": \"d\"}' END")


@register("answer_normalise", """
SELECT conv_id, turn,
       CASE WHEN turn % 2 = 0 THEN 'a' || CAST(conv_id AS VARCHAR) ELSE 'b' END AS answer,
       CASE WHEN turn % 2 = 0 THEN 'No methodology provided' ELSE 'No methodology provided' END AS approach,
       CASE WHEN turn % 2 = 0 THEN 3 ELSE 0 END AS charts_input_count,
       CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS invalid_chart_specs_dropped,
       CASE WHEN turn % 2 = 0 THEN 'No additional analysis provided.' ELSE 'd' END AS detailed_analysis
FROM conversations
""")
def answer_normalise(spark, sf):
    raw = T(spark, sf, "conversations").select("conv_id", "turn", X(PAYLOAD_SQL_SPARK).alias("payload"))
    out = LG.normalise_answers(raw, "q")
    return out.select("conv_id", "turn", F.col("direct_answer.answer").alias("answer"),
                      F.col("direct_answer.approach").alias("approach"), "charts_input_count",
                      "invalid_chart_specs_dropped", "detailed_analysis")


@register("doc_upsert_latest", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS version,
       md5(CASE WHEN doc_id % 5 = 0 THEN text || ' [v2]' ELSE text END) AS text_md5, lang
FROM documents
""")
def doc_upsert_latest(spark, sf):
    d = T(spark, sf, "documents").select("doc_id", "text", "lang", F.lit(1).alias("version"))
    upd = d.where("doc_id % 5 = 0").select("doc_id", F.concat("text", F.lit(" [v2]")).alias("text"), "lang",
                                            F.lit(2).alias("version"))
    out = ST.upsert_latest(d, upd, "doc_id", "version")
    return out.select("doc_id", "version", F.md5("text").alias("text_md5"), "lang")


@register("tokens_estimate", """
SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS tokens,
       len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))) AS n_name_tokens
FROM documents
""")
def tokens_estimate(spark, sf):
    d = T(spark, sf, "documents")
    return d.select("doc_id", TX.token_estimate(F.col("text")).alias("tokens"),
                    F.size(TX.name_tokens(F.col("text"))).cast("long").alias("n_name_tokens"))


@register("log_run_summary", """
SELECT 'orders' AS "table", count(*) AS rows, 6 AS columns,
       'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS column_preview FROM orders
UNION ALL
SELECT 'lineitem', count(*), 11,
       'l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax' FROM lineitem
""")
def log_run_summary(spark, sf):
    """LG-04: rows, columns and the first eight column names of each input."""
    out = LG.run_summary(spark, OrderedDict(orders=T(spark, sf, "orders"), lineitem=T(spark, sf, "lineitem")))
    return out.select("table", "rows", "columns", F.concat_ws(",", "column_preview").alias("column_preview"))


@register("rule_warnings", """
SELECT 'gold' AS layer, 'status_mix' AS "table", 'o_orderstatus' AS "column",
       'aggregate ''count'' ignored: column is a grouping key' AS message
UNION ALL
SELECT 'gold', 'status_mix', 'o_orderpriority', 'aggregate ''sum'' rejected: column is not numeric'
""")
def rule_warnings(spark, sf):
    """QL-06 on a gold run over orders: a count on a grouping key is ignored
    (D19) and a sum over text is rejected (D21); the valid aggregate runs."""
    from .plans.layers import warnings_frame
    o = T(spark, sf, "orders")
    rules = [_grule("orders", "o_orderstatus", "status_mix", logic="count of status"),
             _grule("orders", "o_orderpriority", "status_mix", "o_orderpriority", "Aggregation", "sum"),
             _grule("orders", "o_totalprice", "status_mix", "total", "Aggregation", "sum")]
    res = run_gold(OrderedDict(orders=o), rules)
    res.tables["status_mix"].write.format("noop").mode("overwrite").save()
    return warnings_frame(spark, "gold", res)


from . import registry_links, registry_runs  # noqa: E402,F401  add their queries to the same tables
