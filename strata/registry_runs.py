"""Registered queries over written artifacts, rejects, generated rules and
answer records; added to ``registry`` when that module is imported."""

from __future__ import annotations

import os
from collections import OrderedDict

from pyspark.sql import functions as F

from .functions import clean
from .operators import charts as CH
from .operators import profile as PF
from .operators import quality as QL
from .operators.joins import combine_sources
from .plans import answer as AN
from .plans import generate as RG
from .plans import logs as LG
from .plans.layers import run_bronze, run_gold, run_silver
from .plans.rules import Rule, approved_preview, collect_rules, normalise_source_name, rules_preview, table_preview
from .registry import BRONZE_RULES_SQL, ORDERS_COLS, R2, T, X, _bronze_rules, _gold_tables, register
from .session import stage_path
from .sources import artifacts as ART
from .sources.tables import csv_parts, read_many, read_parquet, register_views

# ===========================================================================
# rejects, names, numbers
# ===========================================================================

LINE = ("concat_ws(',', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), o_orderstatus, "
        "CASE WHEN o_orderkey % 7 = 0 THEN 'extra' END)")
RAGGED = f"CASE WHEN o_orderkey % 11 = 3 THEN CAST(o_orderkey AS VARCHAR) ELSE {LINE} END"


@register("csv_rejects", f"""
SELECT CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 3 THEN 'rejected' ELSE 'kept' END AS part, {RAGGED} AS line
FROM orders
""")
def csv_rejects(spark, sf):
    """SC-04: rows with too many or too few fields are set aside whole;
    kept and rejected rows add up to the file."""
    path = stage_path(spark, "ragged-csv")
    line = X(RAGGED.replace("VARCHAR", "STRING")).alias("o_orderkey,o_custkey,o_orderstatus")
    T(spark, sf, "orders").select(line).write.option("header", True).option("sep", "\u0001").csv(path)
    kept, rejected = csv_parts(spark, path, multi_line=False)
    kept = kept.select(F.lit("kept").alias("part"), F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus").alias("line"))
    return kept.unionByName(rejected.select(F.lit("rejected").alias("part"), F.col("_corrupt_record").alias("line")))


@register("read_many_same_stem", """
SELECT 'a_t' AS "table", c_custkey AS key FROM customer
UNION ALL SELECT 'b_t', s_suppkey FROM supplier
UNION ALL SELECT 'missing: recorded', count(*) FROM region WHERE r_regionkey < 0
""")
def read_many_same_stem(spark, sf):
    """SC-04/SC-05: two inputs of one stem keep apart; an unreadable one is
    recorded and skipped."""
    root = stage_path(spark, "inputs")
    T(spark, sf, "customer").select(F.col("c_custkey").alias("key")).write.parquet(f"{root}/a/t.parquet")
    T(spark, sf, "supplier").select(F.col("s_suppkey").alias("key")).write.parquet(f"{root}/b/t.parquet")
    tables, errors = read_many(spark, [f"{root}/a/t.parquet", f"{root}/b/t.parquet", f"{root}/missing.parquet"])
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("table"), F.col("key").cast("long").alias("key"))
        out = part if out is None else out.unionByName(part)
    skipped = spark.createDataFrame([(f"{n}: recorded", 0) for n in errors], "table string, key long")
    return out.unionByName(skipped)


NUMBER_TEXT = ("CASE o_orderkey % 8 WHEN 0 THEN concat('12345678901', lpad(CAST(o_orderkey AS VARCHAR), 8, '0')) "
               "WHEN 1 THEN concat(CAST(o_custkey AS VARCHAR), 'F') WHEN 2 THEN concat('0x1p', CAST(o_custkey % 9 AS VARCHAR)) "
               "WHEN 3 THEN concat(' ', CAST(o_custkey AS VARCHAR), ' ') WHEN 4 THEN '1e3' "
               "WHEN 5 THEN concat('-', CAST(o_custkey AS VARCHAR)) WHEN 6 THEN concat('+', CAST(o_custkey AS VARCHAR), '.5') "
               "ELSE o_orderpriority END")


@register("numbers_from_text", """
SELECT o_orderkey,
       CASE o_orderkey % 8 WHEN 0 THEN 1234567890100000000 + o_orderkey WHEN 3 THEN o_custkey WHEN 4 THEN 1000
            WHEN 5 THEN -o_custkey WHEN 6 THEN o_custkey END AS whole,
       CASE o_orderkey % 8 WHEN 3 THEN CAST(o_custkey AS DOUBLE) WHEN 4 THEN 1000.0
            WHEN 5 THEN CAST(-o_custkey AS DOUBLE) WHEN 6 THEN o_custkey + CAST(0.5 AS DOUBLE) END AS number
FROM orders
""")
def numbers_from_text(spark, sf):
    """FN-01/FN-02: long identifiers read exactly; suffixed and hexadecimal
    codes are no numbers."""
    text = T(spark, sf, "orders").select("o_orderkey", X(NUMBER_TEXT.replace("VARCHAR", "STRING")).alias("t"))
    number = F.when(F.col("o_orderkey") % 8 != 0, clean.text_double(F.col("t")))
    return text.select("o_orderkey", clean.text_long(F.col("t")).alias("whole"), number.alias("number"))


# ===========================================================================
# generated rules on data with nulls; lineage; gold rules that run
# ===========================================================================

NULLED = {"price": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END",
          "placed_date": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END",
          "priority": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat(' ', o_orderpriority) END",
          "lines": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END"}
NULLED_SQL = "SELECT o_orderkey AS order_id, " + ", ".join(f"{e} AS {n}" for n, e in NULLED.items()) + " FROM orders"


def _nulled(spark, sf):
    src = read_parquet(spark, os.path.join(sf, "orders.parquet"))
    df = src.select(F.col("o_orderkey").alias("order_id"), *[X(e).alias(n) for n, e in NULLED.items()], "_source_file", "_source_row")
    return OrderedDict(orders_bronze=df)


@register("rules_silver_nulls", f"""
WITH d AS ({NULLED_SQL})
SELECT 'order_id' AS "column", '{RG.SILVER_ID_INT}' AS logic
UNION ALL SELECT 'price', CASE WHEN count(price) < count(*) THEN '{RG.SILVER_NUM_NULLS}' ELSE '{RG.SILVER_NUM}' END FROM d
UNION ALL SELECT 'placed_date', CASE WHEN count(placed_date) < count(*) THEN '{RG.SILVER_DATE_NULLS}' ELSE '{RG.SILVER_DATE}' END FROM d
UNION ALL SELECT 'priority', CASE WHEN count(priority) < count(*) THEN '{RG.SILVER_TEXT_NULLS}' ELSE '{RG.SILVER_TEXT}' END FROM d
UNION ALL SELECT 'lines', CASE WHEN count(lines) < count(*) THEN '{RG.SILVER_NUM_NULLS}' ELSE '{RG.SILVER_NUM}' END FROM d
""")
def rules_silver_nulls(spark, sf):
    rules = RG.silver_rules(RG.column_catalog(spark, _nulled(spark, sf)))
    return rules.where("source_column NOT IN ('', '_source_file')") \
        .select(F.col("source_column").alias("column"), F.col("transformation_logic").alias("logic"))


@register("silver_generated_rules", f"""
WITH d AS ({NULLED_SQL})
SELECT order_id, coalesce(price, (SELECT median(price) FROM d)) AS price,
       coalesce(placed_date, (SELECT placed_date FROM d WHERE placed_date IS NOT NULL
                              GROUP BY placed_date ORDER BY count(*) DESC, placed_date LIMIT 1)) AS placed_date,
       trim(lower(coalesce(priority, ''))) AS priority,
       round(CAST(coalesce(lines, (SELECT median(lines) FROM d)) AS DOUBLE), 4) AS lines
FROM d
""")
def silver_generated_rules(spark, sf):
    """RG-02 then RX-02: the rules generated for data with nulls, run on it
    (mode, median and default fills; a whole-number column takes a median
    with a fraction)."""
    tables = _nulled(spark, sf)
    rules = collect_rules(RG.silver_rules(RG.column_catalog(spark, tables)))
    out = run_silver(tables, rules).tables["orders_silver"]
    return out.select("order_id", "price", "placed_date", "priority", F.round(F.col("lines").cast("double"), 4).alias("lines"))


@register("lineage_columns", """
SELECT o_orderkey, 'orders.parquet' AS source_name, TRUE AS loaded,
       CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS pk
FROM orders
""")
def lineage_columns(spark, sf):
    """PR-03 and WN-01: source file and load time of every bronze row, kept
    through silver; the key follows the scan order without a sort."""
    src = OrderedDict(orders=read_parquet(spark, os.path.join(sf, "orders.parquet")))
    bronze = run_bronze(src, [], {"orders": "orders.parquet"}).tables
    keep = [Rule(source_table="orders_bronze", source_column="o_orderkey", target_column="o_orderkey", transformation_logic="Direct")]
    out = run_silver(bronze, keep).tables["orders_silver"]
    return out.select("o_orderkey", F.regexp_extract("_source_file", r"([a-z]+\.parquet)(/[^/]*)?$", 1).alias("source_name"),
                      F.col("_load_timestamp").isNotNull().alias("loaded"), F.col("pk_orders_bronze_silver_id").alias("pk"))


def _written_silver(spark, sf):
    """Customer and nation as a written and re-read silver layer."""
    root = stage_path(spark, "silver")
    frames = OrderedDict(
        customer_silver=T(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation_id"), "c_acctbal"),
        nation_silver=T(spark, sf, "nation").select(F.col("n_nationkey").alias("nation_id"), "n_name"))
    for name, df in frames.items():
        df.write.parquet(f"{root}/{name}")
    return OrderedDict((name, spark.read.schema(df.schema).parquet(f"{root}/{name}")) for name, df in frames.items())


@register("gold_generated_rules", """
SELECT 'customer_gold' AS "table", CAST(c_custkey AS BIGINT) AS key, CAST(c_nationkey AS BIGINT) AS nation_id, round(c_acctbal, 2) AS amount FROM customer
UNION ALL SELECT 'nation_gold', NULL, n_nationkey, NULL FROM nation
""")
def gold_generated_rules(spark, sf):
    """RG-03 then RX-03: pass-through gold rules generated from a written
    silver layer, run on it."""
    silver = _written_silver(spark, sf)
    rules = collect_rules(RG.gold_rules(RG.column_catalog(spark, silver, with_nulls=False)))
    gold = run_gold(OrderedDict((normalise_source_name(n), df) for n, df in silver.items()), rules).tables
    one = gold["customer_gold"].select(F.lit("customer_gold").alias("table"), F.col("cust").cast("long").alias("key"),
                                       F.col("nation_id").cast("long").alias("nation_id"), F.round("c_acctbal", 2).alias("amount"))
    two = gold["nation_gold"].select(F.lit("nation_gold").alias("table"), F.lit(None).cast("long").alias("key"),
                                     F.col("nation_id").cast("long").alias("nation_id"), F.lit(None).cast("double").alias("amount"))
    return one.unionByName(two)


L_KEY = "CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END"
R_KEY = "CASE WHEN c_custkey % 75 = 0 THEN NULL ELSE c_custkey + 40 END"


@register("outer_join_both_null", f"""
WITH l AS (SELECT {L_KEY} AS cust_id, c_name AS label, c_acctbal AS balance FROM customer),
     r AS (SELECT {R_KEY} AS cust_id, c_mktsegment AS label, c_nationkey AS nation FROM customer)
SELECT coalesce(l.cust_id, r.cust_id) AS cust_id, l.label, l.balance, r.nation
FROM l FULL JOIN r ON l.cust_id IS NOT DISTINCT FROM r.cust_id
""")
def outer_join_both_null(spark, sf):
    """JN-01/JN-02: null keys on both sides, and a shared column that is no
    key (the left side's is kept)."""
    c = T(spark, sf, "customer")
    left = c.select(X(L_KEY).alias("cust_id"), F.col("c_name").alias("label"), F.col("c_acctbal").alias("balance"))
    right = c.select(X(R_KEY).alias("cust_id"), F.col("c_mktsegment").alias("label"), F.col("c_nationkey").alias("nation"))
    return combine_sources([left, right])


@register("null_key_warning", f"""
WITH l AS (SELECT count(*) - count({L_KEY}) AS n FROM customer), r AS (SELECT count(*) - count({R_KEY}) AS m FROM customer)
SELECT 'cust_id' AS "column", n || ' and ' || m || ' rows without a key match each other: ' || (n * m) || ' rows' AS message
FROM l, r WHERE n > 0 AND m > 0
""")
def null_key_warning(spark, sf):
    """QL-06: both null counts of a gold join are reported beside it; all its
    rows are made, with their keys."""
    c = T(spark, sf, "customer")
    sources = OrderedDict(a=c.select(X(L_KEY).alias("cust_id"), "c_name"), b=c.select(X(R_KEY).alias("cust_id"), "c_acctbal"))
    rules = [Rule(source_table=s, source_column=col, target_table="joined", target_column=col, transformation_type="Direct")
             for s, col in (("a", "cust_id"), ("a", "c_name"), ("b", "c_acctbal"))]
    gold = run_gold(sources, rules)
    for table in gold.tables.values():
        table.write.format("noop").mode("overwrite").save()
    rows = [(col, text) for _, col, text in gold.warnings]
    return spark.createDataFrame(rows, "column string, message string")


# ===========================================================================
# profile columns that other queries leave out; previews
# ===========================================================================

@register("profile_samples", """
SELECT 'p_name' AS "column", count(*) AS row_count, count(DISTINCT p_name) AS unique_count, TRUE AS unique_exact, arg_min(p_name, p_partkey) AS sample_value FROM part
UNION ALL SELECT 'p_brand', count(*), count(DISTINCT p_brand), TRUE, arg_min(p_brand, p_partkey) FROM part
UNION ALL SELECT 'p_type', count(*), count(DISTINCT p_type), TRUE, arg_min(p_type, p_partkey) FROM part
UNION ALL SELECT 'p_partkey', count(*), count(DISTINCT p_partkey), TRUE, NULL FROM part
""")
def profile_samples(spark, sf):
    """AG-02, SL-05: row count, exactness flag and first text of a column."""
    prof, _ = PF.profile(OrderedDict(part=read_parquet(spark, os.path.join(sf, "part.parquet"))), with_lov=False)
    return prof.where("column IN ('p_name', 'p_brand', 'p_type', 'p_partkey')") \
        .select("column", "row_count", "unique_count", "unique_exact", "sample_value")


@register("preview_columns", f"""
WITH d AS ({NULLED_SQL})
SELECT 'order_id' AS "column", 'bigint' AS dtype, count(*) AS rows, 5 AS columns, count(*) - count(order_id) AS null_count, CAST(min(order_id) AS VARCHAR) AS sample_value FROM d
UNION ALL SELECT 'price', 'double', count(*), 5, count(*) - count(price), NULL FROM d
UNION ALL SELECT 'placed_date', 'timestamp_ntz', count(*), 5, count(*) - count(placed_date), NULL FROM d
UNION ALL SELECT 'priority', 'string', count(*), 5, count(*) - count(priority), arg_min(priority, order_id) FROM d
UNION ALL SELECT 'lines', 'bigint', count(*), 5, count(*) - count(lines), CAST(arg_min(lines, order_id) AS VARCHAR) FROM d
""")
def preview_columns(spark, sf):
    """PR-15: type, null count and first value of each previewed column."""
    pv = PF.preview("orders", _nulled(spark, sf)["orders_bronze"].drop("_source_file"))
    sample = F.when(~F.col("column").isin("price", "placed_date"), F.col("sample_value"))
    return pv.where("column <> '_source_row'").select("column", "dtype", "rows", "columns", "null_count", sample.alias("sample_value"))


@register("rules_preview", f"""
SELECT source_table, source_column, target_table, target_column FROM (
  SELECT *, row_number() OVER (PARTITION BY target_table ORDER BY rule_no) AS k FROM ({BRONZE_RULES_SQL}) r) t
WHERE k <= 4 ORDER BY rule_no LIMIT 7
""")
def rules_preview_query(spark, sf):
    """PR-16: at most four rules a target and seven in all, in rule order."""
    rows = rules_preview(_bronze_rules(spark, sf), total=7, per_target=4).collect()
    return spark.createDataFrame(rows).select("source_table", "source_column", "target_table", "target_column")


@register("table_preview", """
SELECT 'part' AS table_name, count(*) AS row_count, 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS columns,
       'bigint,string,string,string,int,double' AS dtypes, arg_min(p_name, p_partkey) AS first_name FROM part
""")
def table_preview_query(spark, sf):
    """PR-06, PR-17: shape and first row, of the approved columns only."""
    part = T(spark, sf, "part")
    pv = table_preview("part", part)
    one = approved_preview(part, [Rule(target_column="p_name")]).first()
    rows = [(pv["table_name"], pv["row_count"], ",".join(pv["columns"]), ",".join(pv["dtypes"].values()), one["p_name"])]
    return spark.createDataFrame(rows, "table_name string, row_count long, columns string, dtypes string, first_name string")


# ===========================================================================
# answers: catalog, fallback, records, shapes
# ===========================================================================

@register("answer_catalog_columns", """
SELECT 'lineitem' AS table_name, count(*) AS row_count,
       'l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double,l_discount:double,l_tax:double,l_returnflag:string,l_shipdate:timestamp_ntz' AS columns
FROM lineitem
UNION ALL
SELECT 'part', count(*), 'p_partkey:bigint,p_name:string,p_brand:string,p_type:string,p_size:int,p_retailprice:double' FROM part
""")
def answer_catalog_columns(spark, sf):
    """QS-04, PR-14: the columns a question is shown (ten at most) and their types."""
    tables = OrderedDict(lineitem=T(spark, sf, "lineitem"), part=T(spark, sf, "part"))
    cat = AN.catalog(spark, tables, "total quantity by returnflag and shipdate")
    named = F.transform("columns", lambda c: F.concat_ws(":", c, F.element_at("dtypes", c)))
    return cat.select("table_name", "row_count", F.array_join(named, ",").alias("columns"))


@register("answer_with_fallback", """
SELECT 'sql' AS origin, o_orderstatus AS segment, count(*) AS value FROM orders GROUP BY o_orderstatus
UNION ALL
SELECT * FROM (SELECT 'intent', o_orderpriority, count(*) AS value FROM orders GROUP BY o_orderpriority
               ORDER BY value DESC, o_orderpriority LIMIT 20) t
""")
def answer_with_fallback(spark, sf):
    """QS-03: the first SQL text with rows answers; after three without, the
    intent analysis does."""
    tables = _gold_tables(spark, sf)
    register_views(tables)
    bad = ["SELECT nothing FROM nowhere", "SELECT * FROM orders_gold WHERE order_id < 0"]
    good = "SELECT order_status AS segment, count(*) AS value FROM orders_gold GROUP BY order_status"
    out = None
    for texts in ([*bad, good], [*bad, bad[0], good]):
        origin, df, _ = AN.answer_with_fallback(spark, tables, "how many orders by order priority", texts)
        part = df.toDF("segment", "value").select(F.lit(origin).alias("origin"), "segment", "value")
        out = part if out is None else out.unionByName(part)
    return out


@register("sql_preview_rows", """
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice, n AS row_count FROM orders, (SELECT count(*) AS n FROM orders) c
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def sql_preview_rows(spark, sf):
    """QS-01, SL-04: the ten previewed rows of a query and its counted size."""
    T(spark, sf, "orders").createOrReplaceTempView("orders")
    out = AN.run_sql(spark, "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", count=True)
    rows = [(r["o_orderkey"], r["o_totalprice"], out.row_count) for r in out.rows]
    return spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, row_count long")


@register("answer_record", """
WITH g AS (SELECT o_orderpriority AS p, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_orderpriority ORDER BY v DESC, p LIMIT 1)
SELECT 'r1' AS run_id, 'total price by order priority' AS question,
       'Deterministic intent analysis completed using orders_gold. Top segment: ' || p || ' with value ' || format('{:,.2f}', v) || '.' AS answer,
       'bar' AS chart_type, 'Sum by order_priority' AS chart_title, 'order_priority' AS x_column, 'value' AS y_column
FROM g
""")
def answer_record(spark, sf):
    """FN-20, CH-03, SC-18: sentence and chart of an answer, written as the
    answer record and read back."""
    question = "total price by order priority"
    ans = AN.answer(_gold_tables(spark, sf), question)
    record = ART.answer_frame(spark, "r1", question, AN.answer_text(ans, ans.df.first()), "why", "how", ans.charts, ans.sql)
    back = ART.read_json(spark, ART.write_json(record, stage_path(spark, "answer")), record.schema)
    chart = F.col("charts")[0]
    return back.select("run_id", "direct_answer.question", "direct_answer.answer", chart["type"].alias("chart_type"),
                       chart["title"].alias("chart_title"), chart["x_column"].alias("x_column"), chart["y_column"].alias("y_column"))


SHAPES = ("CASE (conv_id + turn) % 5 WHEN 0 THEN '{\"charts\": {\"type\": \"bar\"}, \"direct_answer\": \"yes\"}' "
          "WHEN 1 THEN '{\"direct_answer\": 5, \"detailed_analysis\": 7}' "
          "WHEN 2 THEN '{\"charts\": [{\"type\": \"bar\"}, 3, \"x\"], \"direct_answer\": {\"answer\": \"a\"}, \"detailed_analysis\": \"d\"}' "
          "WHEN 3 THEN '[1, 2]' ELSE 'no json' END")


@register("answer_shapes", """
WITH c AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k FROM conversations)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'yes' WHEN 2 THEN 'a' ELSE 'No answer provided' END AS answer,
       k < 3 AS analysis_was_dict, k >= 2 AS direct_answer_was_dict, k = 0 AS direct_answer_was_string,
       CASE k WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 0 END AS charts_input_count,
       CASE k WHEN 0 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS charts_output_count,
       CASE k WHEN 2 THEN 2 ELSE 0 END AS invalid_chart_specs_dropped, k <> 1 AS detailed_analysis_was_string
FROM c
""")
def answer_shapes(spark, sf):
    """FN-21: answers of unexpected shape, with all seven counters and flags."""
    raw = T(spark, sf, "conversations").select("conv_id", "turn", X(SHAPES).alias("payload"))
    return LG.normalise_answers(raw, "q").select(
        "conv_id", "turn", F.col("direct_answer.answer").alias("answer"), "analysis_was_dict", "direct_answer_was_dict",
        "direct_answer_was_string", "charts_input_count", "charts_output_count", "invalid_chart_specs_dropped", "detailed_analysis_was_string")


# ===========================================================================
# rule headers, reports, value lists, traces
# ===========================================================================

@register("rule_headers", "SELECT o_orderkey AS order_key, CAST(o_custkey AS VARCHAR) AS customer FROM orders")
def rule_headers(spark, sf):
    """SC-07/SC-08: a rule file with other header spellings, read and run."""
    path = stage_path(spark, "rules-spelled")
    rows = [("orders", "o_orderkey", "order_key", "Direct", "Type cast to integer"),
            ("orders", "o_custkey", "customer", "Direct", "Convert to text")]
    spark.createDataFrame(rows, ["table", " Source", "TARGET", "type", "logic"]).coalesce(1).write.option("header", True).csv(path)
    rules = collect_rules(ART.read_rules(spark, path))
    out = run_bronze(OrderedDict(orders=T(spark, sf, "orders")), rules, {"orders": "orders.csv"}).tables["orders_bronze"]
    return out.select("order_key", "customer")


@register("quality_reports", """
SELECT 'bronze' AS layer_name, 'orders' AS "table", count(*) AS row_count, CAST(6 AS BIGINT) AS column_count, CAST(0 AS BIGINT) AS duplicate_row_count, '' AS warnings, TRUE AS was_missing FROM orders
UNION ALL SELECT 'silver', '', NULL, NULL, NULL, 'No Output File were provided for validation.', TRUE
UNION ALL SELECT 'gold', 'part_sizes', count(*), 1, count(*) - count(DISTINCT p_size), 'Duplicate rows detected : ' || (count(*) - count(DISTINCT p_size)), FALSE FROM part
""")
def quality_reports(spark, sf):
    """SC-13, QL-03, QL-05: the reports of a run's layers read back; missing
    ones are made first, one that exists stays, and a layer without tables
    gets a warning."""
    root = stage_path(spark, "reports")
    layers = OrderedDict(bronze={"orders": T(spark, sf, "orders")}, silver={}, gold={"part_sizes": T(spark, sf, "part").select("p_size")})
    ART.write_json(QL.validate_layer(spark, "gold", layers["gold"], "r1")[0], ART.quality_paths(root, "r1")["gold"])
    made = [layer for layer, tables in layers.items() if ART.ensure_report(spark, root, "r1", layer, tables)]
    return QL.flatten(ART.read_reports(spark, root, "r1")).withColumn("was_missing", F.col("layer_name").isin(made))


@register("lov_json_roundtrip", """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS freq FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority
""")
def lov_json_roundtrip(spark, sf):
    """SC-12: the lists of values written as JSON and read back."""
    _, lov = PF.profile(OrderedDict(orders=T(spark, sf, "orders").select(*[c for c, _, _ in ORDERS_COLS])))
    path = ART.write_json(lov, stage_path(spark, "lov"))
    return ART.read_json(spark, path, lov.schema).select("column", "value", "freq")


TOOLS = ("CASE WHEN event_id % 4 = 0 THEN array('read', event_type, 'read') WHEN event_id % 4 = 1 THEN array(event_type) "
         "WHEN event_id % 4 = 2 THEN array('plan', 'write', 'plan', event_type) END")


def _traces(spark, sf):
    """Events as trace records, appended to the trace store in two writes and
    read back (SC-15)."""
    call = "transform({}, t -> named_struct('tool', t, 'args', map('user', CAST(user_id AS STRING))))".format(TOOLS)
    e = T(spark, sf, "events").select(
        F.col("event_type").alias("agent"), F.col("event_id").cast("string").alias("run_id"), F.lit("p").alias("plan"),
        X("CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'success' END").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"), F.col("value").cast("double").alias("duration_seconds"),
        X(call).alias("tool_calls"), F.lit(None).cast("string").alias("error"))
    path = stage_path(spark, "traces")
    for half in ("CAST(run_id AS BIGINT) % 2 = 0", "CAST(run_id AS BIGINT) % 2 = 1"):
        ART.write_trace(e.where(half), path)
    return ART.read_json(spark, path, LG.TRACE_SCHEMA)


_TOOLS_DUCK = TOOLS.replace("array(", "list_value(")


@register("trace_tool_calls", f"""
WITH t AS (SELECT CAST(event_id AS VARCHAR) AS run_id, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status, {_TOOLS_DUCK} AS tools FROM events)
SELECT run_id, status, CAST(k - 1 AS INTEGER) AS call_no, tools[k] AS tool
FROM (SELECT run_id, status, tools, unnest(range(1, len(tools) + 1)) AS k FROM t) x
UNION ALL SELECT run_id, status, NULL, NULL FROM t WHERE tools IS NULL
""")
def trace_tool_calls(spark, sf):
    """LG-03: one row per tool call of a trace."""
    return LG.trace_tool_calls(_traces(spark, sf)).select("run_id", "status", "call_no", "tool")


@register("trace_tool_sequence", f"""
SELECT CAST(event_id AS VARCHAR) AS run_id, CASE event_id % 4 WHEN 0 THEN 'read,' || event_type WHEN 1 THEN event_type
       WHEN 2 THEN 'plan,write,' || event_type END AS tools FROM events
""")
def trace_tool_sequence(spark, sf):
    """SO-05: the distinct tools of a trace in order of first use."""
    return LG.tool_sequence(_traces(spark, sf)).select("run_id", F.array_join("tools", ",").alias("tools"))


# ===========================================================================
# CH-01 / CH-02: the branches that other queries leave out
# ===========================================================================

@register("chart_line", "SELECT o_orderdate, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def chart_line(spark, sf):
    o = T(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return CH.chart_frame(o, {"type": "line", "x_column": "o_orderdate", "y_column": "o_totalprice"}, ["o_orderdate", "o_totalprice"])


@register("chart_scatter", "SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'")
def chart_scatter(spark, sf):
    li = T(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return CH.chart_frame(li, {"type": "scatter", "x_column": "l_quantity", "y_column": "l_extendedprice"})


@register("chart_auto_numbers", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 200")
def chart_auto_numbers(spark, sf):
    """CH-02: two numbers make a scatter of the first 200 rows."""
    kind, frame = CH.auto_chart(T(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])
    assert kind == "scatter"
    return frame


@register("chart_auto_record", """
SELECT 'row_' || row_number() OVER (ORDER BY o_totalprice) AS record, o_totalprice
FROM (SELECT o_totalprice FROM orders ORDER BY o_totalprice LIMIT 20)
""")
def chart_auto_record(spark, sf):
    """CH-02: one number makes a bar of the first 20 rows with record labels."""
    kind, frame = CH.auto_chart(T(spark, sf, "orders").select("o_totalprice"), ["o_totalprice"])
    assert kind == "bar"
    return frame


@register("chart_auto_values", """
SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY c_mktsegment ORDER BY count DESC, c_mktsegment LIMIT 20
""")
def chart_auto_values(spark, sf):
    """CH-02: without numbers the most frequent values of the first column."""
    return CH.auto_chart(T(spark, sf, "customer").select("c_mktsegment", "c_name"), ["c_name"])[1]
