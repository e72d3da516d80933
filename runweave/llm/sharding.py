"""Sharding of a table by a two-pass external shuffle, in DataFrame functions.

**First pass.** Rows are scattered by a seeded hash of all their columns into buckets of about `BUCKET_BYTES`; a count per
bucket (no text is moved for it) says where each bucket's rows begin in the whole order. **Second pass.** Each bucket
is brought together in one task's memory, put in a fixed order, shuffled by Spark's Fisher-Yates `shuffle`, and
dealt out: the row at place p of the whole order goes to shard p mod n as its slot p div n. So the shards' counts are at
most one apart (the law `rows`), slots have no gaps, and the order is a uniform random one for each seed.

**Scale.** One exchange of whole rows; the number of buckets follows the size of the table, so a bucket fits in
memory at any size. The hash takes in every column, so a hot source, text or id is scattered as anything else. Buckets are
sorted within a partition before they are shuffled and rows within a bucket too, so a task that runs again after a lost
executor deals the same.

**Cases.** Rows equal in all columns share a bucket and are dealt out like others; null and empty texts have size 1.
An empty table gives no rows. `shard` and `slot` take the place of columns of those names (and of `_bucket`, `_at`, `_tie`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.llm.columns import without
from runweave.llm.storage import checkpointed

BUCKET_BYTES = 16 << 20
SHARDS = 16
SEED = 20240611
OWN = ("_bucket", "_at", "shard", "slot", "_tie")


def text_size(text: str = "text") -> F.Column:
    """UTF-8 bytes and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def hashed(columns: list[str], seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), *(F.col(c) for c in columns))


def scattered(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """docs with `_bucket`, and a table of buckets: `_bucket`, `_before` (rows in the buckets before it)."""
    docs = without(docs, *OWN)
    total = docs.agg(F.sum(text_size(text) + 100)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = docs.withColumn("_bucket", F.pmod(hashed(plain, seed), F.lit(buckets)).cast("bigint"))
    counts = checkpointed(rows.groupBy("_bucket").count())
    # running totals in two levels: of groups of 4096 buckets (64 GB of text each), and within a group
    group = F.expr("_bucket DIV 4096")
    groups = counts.groupBy(group.alias("g")).agg(F.sum("count").alias("n"))
    earlier = groups.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("count").over(Window.partitionBy("g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("g", group).join(earlier, "g").select("_bucket", (F.col("base") + inside).cast("bigint").alias("_before"))
    return rows, starts


def dealt(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, text: str = "text") -> DataFrame:
    """The columns of docs, `shard` and `slot`."""
    docs = without(docs, *OWN)
    rows, starts = scattered(docs, bucket_bytes, seed, text)
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    held = F.struct(hashed(plain, seed + 1).alias("_tie"), F.struct(*docs.columns).alias("row"))
    full = rows.groupBy("_bucket").agg(F.sort_array(F.collect_list(held)).alias("rows") if len(plain) == len(docs.columns) else F.collect_list(held).alias("rows"))
    full = full.join(starts, "_bucket").sortWithinPartitions("_bucket")
    mixed = full.select("_before", F.shuffle("rows", seed).alias("rows"))
    out = mixed.select("_before", F.posexplode("rows").alias("_at", "r"))
    place = F.col("_before") + F.col("_at")
    return out.select("r.row.*", (place % shards).cast("int").alias("shard"), F.expr(f"CAST((_before + _at) DIV {shards} AS BIGINT)").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Each shard as files below path/shard=N, in the order of slots within each file."""
    dealt(docs, shards, **options).repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard (null: the law is that of equal counts)."""
    out = dealt(docs)
    return out.select(
        key, text_size().alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
