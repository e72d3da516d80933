"""Where files that this subpackage needs are found, and how many rows a batch of texts has."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_ROWS = 2_000


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of a file of the installed vocabulary package, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches have at most `BATCH_ROWS` rows: texts are long, and a worker holds a batch several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
