"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir), calls one
operator on all of ``docs`` and, but for the last, returns its columns.

Defined cases, beside those of the operators: a null or empty text goes with
language ID (it has no letter), so later stages only meet one where they are
run alone, and then keep it; a null doc_id or source is a value of its own; rows
that are repeated whole are documents that resemble each other, of which the
near-duplicate stage keeps one; ties in "first" go to the smaller doc_id, then
text, then the other columns; an empty table stays empty with its columns;
extra columns, whatever their names, pass through all stages but the last, and
a table without lang, source or n_chars runs through too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, lines, mixing, packing, simhash

#: A text that no learned language clearly fits is rejected below this score.
MIN_LANG_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter (``und``) and texts without a clear language."""
    names = docs.columns
    learn = docs if "lang" in names else docs.withColumn("lang", F.lit(None).cast("string"))
    model = language.train(learn)
    out = language.identify(docs, model)
    return out.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= MIN_LANG_SCORE)).select(*[F.col(f"`{c}`") for c in names])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated line windows out of the texts."""
    out = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of every near-duplicate group."""
    return simhash.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that sources meet their target weights."""
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens
    (``packing.pack`` adds the token ids where ``with_ids`` asks for them)."""
    from .registry import tokenizer_path
    return packing.pack(docs, tokenizer_path())
