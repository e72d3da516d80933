"""A corpus pipeline: stages over the documents table, each written as Parquet and read again for the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from runweave.llm import bpe, decontaminate, lines, minhash, toxicity
from runweave.llm.settings import bounded_batches, vocabulary


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the labels learned from are the table's."""
    bounded_batches(spark)
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that more than a tenth of their source's documents carry."""
    return lines.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that of the least id."""
    bounded_batches(spark)
    return minhash.kept_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages."""
    bounded_batches(spark)
    return decontaminate.removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    bounded_batches(spark)
    return bpe.digest(docs, vocabulary(), rows=256)


STAGES = [
    ("toxicity", reject_toxic), ("line dedup", drop_boilerplate), ("minhash", drop_near_copies),
    ("decontamination", drop_contaminated), ("bpe", encode_decode),
]
#: learned scores and hashed signatures have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on sf_dir's documents. Results between them go below spark.checkpoint.dir, or else the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
