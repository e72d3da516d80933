"""The queries of the operators in this subpackage: each over its whole table, with its production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runweave.llm import (
    bpe, decontaminate, licenses, lines, minhash, nearest, oracle, passages, quality, resampling, sharding, suffixes, toxicity, tries,
)
from runweave.llm.settings import bounded_batches, vocabulary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside 13-word windows of benchmark items."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's lines without those that more than a tenth of its host's pages carry."""
    return lines.digest(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-duplicates."""
    return minhash.classes(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labelled rows that are not held out."""
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place in it after a two-pass shuffle."""
    return sharding.digest(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base statistics and the verdict of cutoffs learned from labels."""
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's places of license names and the license templates it matches."""
    return licenses.digest(table(spark, sf_dir, "documents"))


def op1_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes that a 100-byte string covers which also starts earlier."""
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 and more words that an earlier document has too, whole or nearly."""
    return passages.near_passages(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance for the benchmark's distribution of words, and the rank of those drawn."""
    return resampling.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours of every hundredth vector."""
    return nearest.digest(table(spark, sf_dir, "embeddings"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return tries.digest(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_suffixes, op2_licenses, op3_decontaminate, op4_sharding, op5_line_dedup, op6_quality, op7_passages, op8_minhash, op9_toxicity, op10_bpe,
    op11_resampling, op12_neighbours, op13_trie)}
ORACLE_SQL: dict[str, str] = dict(oracle.SQL)
