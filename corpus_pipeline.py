"""Corpus pipeline over ``documents``: each stage is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tecflow.llm import decontaminate, language, lines, pieces, simhash
from tecflow.llm.common import drop_staged, staged, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language learned, go."""
    return language.accepted(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that equal or are similar to earlier ones; those that this leaves without a word go."""
    found = lines.deduplicated(docs)
    return found.where((F.col("n_removed") == 0) | lines.has_word("text")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return simhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the piece ids of its whole text."""
    return pieces.encoded(docs)


STAGES = [("language", known_language), ("line dedup", fresh_lines), ("near copies", near_copies), ("decontamination", without_benchmark), ("pieces", encoded)]

#: Language ID, SimHash and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, staged(stage(spark, docs, sf_dir), f"stage-{i}")
        drop_staged(before)
    return docs
