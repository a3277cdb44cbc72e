"""The thin queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import centroids, crossentropy, decontaminate, language, lines, manifest, pieces, quality, simhash, token_counts, toxicity, transducer, urls
from .common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return found.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every item that a document holds: documents without rows are clean."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents labelled as good; background: all documents."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return crossentropy.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.digest(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_line_dedup, op3_token_counts, op4_decontaminate, op5_lm_score, op6_quality_rules, op7_pieces, op8_toxicity, op9_simhash, op10_url_filter, op11_byte_bpe, op12_centroids, op13_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.SQL, "op12_centroids": centroids.SQL, "op13_manifest": manifest.SQL}
