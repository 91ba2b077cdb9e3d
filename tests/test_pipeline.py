"""Full run (RX-06) from CSV files: profile -> rules -> bronze -> silver ->
gold -> answer, quality per layer, and a second run that keeps finished layers."""
import os
import tempfile

from strata.plans.pipeline import run_pipeline
from strata.sources.tables import read_csv


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def _inputs():
    d = tempfile.mkdtemp(prefix="strata-in-")
    stores = os.path.join(d, "stores.csv")
    sales = os.path.join(d, "sales.csv")
    _write(stores, "store_id,store_name,region\nS001,Alpha,East\nS002,Beta,West\nS003,Gamma,NA\n")
    _write(sales, "txn_id,store_id,quantity,unit_price,sale_date\n"
                  "1,S001,2,10.5,2024-01-05\n2,S002,1,,2024-01-06\n2,S002,1,,2024-01-06\n"
                  "3,S001,,3.0,06/01/2024\n4,,5,1.0,20240107\n")
    return [stores, sales]


def test_csv_inference_null_tokens_and_ids(spark):
    stores, sales = _inputs()
    s = read_csv(spark, sales)
    types = {f.name: f.dataType.simpleString() for f in s.schema.fields}
    assert types["quantity"] == "bigint" and types["unit_price"] == "double"
    assert types["txn_id"] == "string" and types["store_id"] == "string"   # id-like names stay text (D15)
    st = read_csv(spark, stores)
    assert st.where("region is null").count() == 1          # "NA" read as missing (D14)


def test_full_run_and_skip(spark):
    inputs = _inputs()
    root = tempfile.mkdtemp(prefix="strata-run-")
    res = run_pipeline(spark, inputs, "total quantity by store", root, "run1")
    assert set(res.outputs["bronze"]) == {"stores_bronze", "sales_bronze"}
    assert set(res.outputs["silver"]) == {"stores_silver", "sales_silver"}
    assert set(res.outputs["gold"]) == {"stores_gold", "sales_gold"}
    silver = spark.read.parquet(res.outputs["silver"]["sales_silver"])
    assert silver.columns[0] == "pk_sales_bronze_silver_id"
    assert sorted(r[0] for r in silver.select(silver.columns[0]).collect()) == [1, 2, 3, 4, 5]
    dups = {r.file_path: r.duplicate_row_count for r in res.quality["bronze"][0].collect()}
    assert dups["sales_bronze"] == 1
    assert res.answer is not None and res.answer.group_col == "store_id"
    again = run_pipeline(spark, inputs, "total quantity by store", root, "run1")
    assert set(again.skipped) == {"bronze", "silver", "gold"}


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_split_scans_keep_file_order(spark):
    """CSV read in splits (multi_line=False) and line-delimited JSON: files
    are cut into many splits, packed into partitions out of file order; the
    ordinal still sorts every row back into its file position."""
    from strata.sources.tables import read_csv_text, read_source
    root = tempfile.mkdtemp(prefix="strata-split-")
    sizes = {"a": 6000, "b": 1500, "c": 9000}
    for name, n in sizes.items():
        with open(os.path.join(root, f"{name}.csv"), "w") as fh:
            fh.write("seq,payload\n")
            fh.writelines(f"{i},{'x' * (i % 37)}\n" for i in range(n))
        with open(os.path.join(root, f"{name}.json"), "w") as fh:
            fh.writelines(f'{{"seq": {i}, "payload": "{"y" * (i % 23)}"}}\n' for i in range(n))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(16 * 1024))
    try:
        csv = read_csv_text(spark, os.path.join(root, "*.csv"), multi_line=False)
        jsn = read_source(spark, os.path.join(root, "*.json"))
        assert csv.rdd.getNumPartitions() > 6
        for df in (csv, jsn):
            rows = df.orderBy("_source_file", "_source_row").select("_source_file", "seq").collect()
            for name, n in sizes.items():
                seq = [int(r.seq) for r in rows if r._source_file.endswith(f"/{name}.csv")
                       or r._source_file.endswith(f"/{name}.json")]
                assert seq == list(range(n))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_row_counts_one_job(spark):
    from strata.sources.tables import row_counts
    a = spark.range(0, 1234)
    b = spark.range(0, 7).where("id < 0")
    c = spark.createDataFrame([("x",), ("y",)], "s string")
    assert row_counts({"a": a, "b": b, "c": c}) == {"a": 1234, "b": 0, "c": 2}
    assert row_counts({}) == {}
