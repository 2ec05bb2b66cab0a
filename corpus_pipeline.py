"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens; one table a stage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe_backtrack, line_chunks, parity_join, quality_rules, simhash_windows
from graphloom.llm.queries import SENTENCE_MODEL, table
from graphloom.llm.store import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; their columns travel in a struct, so none is taken for a count.

    Null and empty texts have no words and go. Null languages and sources are
    groups of their own. Repeated rows are judged each, texts of any length
    whole. An empty table stays empty.
    """
    row = F.struct(*(c for c in docs.columns if c != "text")).alias("row_")
    judged = quality_rules.judge(docs.select("text", "lang", "source", row), keep_text=True).where("kept")
    return judged.select(*(F.col("text") if c == "text" else F.col("row_")[c].alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines, as operator 5 cuts them, nor repeated passages of two or more lines beside those.

    n_chars follows the text, and documents of which nothing is left go.
    Null and empty texts have nothing to remove and stay. Of equal passages the
    one of the least document id stays, of rows that repeat an id that of the
    text with the least hash; equal rows are one text and are cut alike. Null
    ids come before all others. Other columns are kept.
    """
    out = line_chunks.dedup_passages(docs)
    rest = out.where((F.col("n_removed_") == 0) | F.col("text").rlike(r"\S"))
    columns = docs.columns
    if "n_chars" in columns:
        rest = rest.withColumn("n_chars", F.length("text").cast("long"))
    return rest.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least, of each group.

    Null and empty texts are linked with nothing and stay, as do rows with a
    null id. Rows that repeat the id of a document that stays are rows of that
    document, and stay. Texts are compared whole.
    """
    return parity_join.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null texts, and those of fewer than five words, match nothing and stay. Rows
    that repeat an id go together. Without benchmark items all documents stay.
    """
    return simhash_windows.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids and the text that these decode to; null and empty texts have no ids and an empty text."""
    return bpe_backtrack.round_trip(docs, public_tokenizers.path(SENTENCE_MODEL))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("tokenize", tokenize),
]

#: SQL can express neither the robust estimates nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
