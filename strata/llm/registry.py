"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fill_middle, language, lexical, licences, lines, mixing, neighbours, packing, quality, repeats, secrets, shingle_join, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql.strip()
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op2_line_windows", lines.ORACLE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))


@query("op5_water_filling", mixing.ORACLE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sizes(table(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def _kinds(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op6_blob_ledger")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_secrets(table(spark, sf_dir).select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return out.select("doc_id", *[_kinds(k) for k in secrets.BASE], F.sha2(_joined(base), 256).alias("base_sha256"),
                      _joined(F.col("spans")).alias("spans"), "blob")


@query("op7_cutting_stock")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir).select("doc_id", "text"), tokenizer_path())


@query("op4_cross_parsing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.train(docs, ~language.held_out(F.col("doc_id")))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"))


@query("op3_vantage_point")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_kneser_ney")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(table(spark, sf_dir).select("doc_id", "lang", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity")


@query("op1_cross_polytope")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


@query("op10_interval_tree")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_paragraph_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    out = licences.scan_licences(docs, licences.train(docs)).drop("text")
    found = F.transform("licences", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"], F.format_number(x["similarity"], 2)))
    return out.select("doc_id", "n_paragraphs", F.size("licences").cast("long").alias("n_licences"),
                      F.array_join(F.array_sort(F.array_distinct(F.col("licences.family"))), ",").alias("families"),
                      F.array_join(found, ",").alias("findings"))


@query("op13_chunk_memo", fill_middle.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(table(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op12_length_strata", lexical.ORACLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op11_token_groups", shingle_join.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.similar_documents(table(spark, sf_dir).select("doc_id", "text"))
