"""Importance resampling of documents towards the distribution of a target table.

**Scores.** A feature is a run of 1 to `longest` consecutive words; its bucket is its CRC-32 modulo `buckets`. Two passes over
the documents: the first counts features per bucket (an array a task, summed by bucket), and with the counts of the target
gives every bucket a gain, the floored log-ratio of its two smoothed shares. The second takes each text's gains from that
array of fixed length: a document's weight is the floored mean, its score the weight and a Gumbel variate of its id, so that
the highest scores are a sample without replacement, weighted by importance. Ranks come from `radix.ranked` over
(score descending, id ascending).

**Scale.** Texts are read twice and never shuffled; a task sends at most `buckets` counts. The gains, `buckets` longs, are the
only thing that the driver and all tasks hold. What is sorted has five numbers a document.

**Cases.** Null and empty texts have no features: weight 0, never drawn. Equal texts have equal weights, not equal scores. A null
id has the seed's own text as its key and ranks after other ids of its score. Rows with the same id and text have ranks next to
each other, in no fixed order. An empty target or an empty table is smoothed like any other. Columns of the operator take the
place of columns of these names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm import textbytes as tb
from runweave.llm.radix import ranked
from runweave.llm.storage import checkpointed

BUCKETS = 10_000
LONGEST = 1
SEED = 2024
LEAST_WORDS = 20
SHARE = 10  # per cent of the documents with LEAST_WORDS words
LONG_WORD = 64  # bytes; longer words are hashed one by one

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_ONES = np.uint32(0xFFFFFFFF)


def extended(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 registers after the bytes of each span; a register begins as all ones and is inverted at the end."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    state, starts, lengths = state[order], starts[order], lengths[order]
    long = int(np.searchsorted(-lengths, -LONG_WORD, side="left"))
    for i in range(long):
        span = data[starts[i]:starts[i] + lengths[i]].tobytes()
        state[i] = zlib.crc32(span, int(state[i] ^ _ONES)) ^ 0xFFFFFFFF
    for k in range(int(lengths[long]) if long < len(lengths) else 0):
        upto = int(np.searchsorted(-lengths, -k, side="left"))
        now = state[long:upto]
        state[long:upto] = _CRC[(now ^ data[starts[long:upto] + k]) & 255] ^ (now >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, borders: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of lower-cased texts, the text of each feature, and the number of words of each text."""
    starts, ends, firsts = tb.words(data, borders, tb.ALNUM)
    counts = np.diff(firsts)
    owner = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(firsts[1:], counts) - np.arange(len(starts))  # words of the text from this one on
    at = np.arange(len(starts))
    state = np.full(len(starts), _ONES, dtype=np.uint32)
    found, owners = [], []
    for n in range(1, longest + 1):
        goes_on = left[at] >= n
        at, state = at[goes_on], state[goes_on]
        if n > 1:
            state = _CRC[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8))
        state = extended(state, data, starts[at + n - 1], ends[at + n - 1])
        found.append((state ^ _ONES).astype(np.int64) % buckets)
        owners.append(owner[at])
    return np.concatenate(found), np.concatenate(owners), counts


def bucket_counts(table: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the table's texts each bucket has."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, dtype=np.int64)
        for _, data, borders in tb.pieces(batches, "text"):
            seen += np.bincount(features(tb.LOWER[data], borders, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["bucket", "n"])

    parts = table.select(F.col(text).alias("text")).mapInArrow(task, "bucket bigint, n bigint")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of target share over source share of each bucket, one added to each count, floored."""
    size = len(source)
    all_source, all_target = float(source.sum() + size), float(target.sum() + size)
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_target)))
        for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gumbel(seed: int, key: int | None) -> int:
    """A variate that depends on the seed and the key only, in floored thousandths."""
    drawn = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """key, n_words, n_features, weight, score of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, borders in tb.pieces(batches, "text"):
            found, owner, words = features(tb.LOWER[data], borders, longest, len(gains))
            n = np.bincount(owner, minlength=len(words))
            total = np.bincount(owner, weights=gains[found], minlength=len(words)).astype(np.int64)  # whole numbers far below 2^53
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            noise = np.array([gumbel(seed, k) for k in batch.column(0).to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (words, n, weight, weight + noise))],
                ["key", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(task, "key bigint, n_words bigint, n_features bigint, weight bigint, score bigint")
    return out.withColumnRenamed("key", key)


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS,
    seed: int = SEED, least_words: int = LEAST_WORDS, share: int = SHARE, **sort,
) -> DataFrame:
    """key, n_words, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Drawn are the highest scores, `share` per cent (rounded down) of the documents with `least_words` words or more.
    """
    gains = bucket_gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    rows = checkpointed(scored(docs, gains, key, text, longest, seed))
    eligible = F.col("n_words") >= least_words
    # higher scores first; the complement of a long turns its order round and cannot overflow
    order = {"_down": F.bitwise_not("score"), "_nameless": F.col(key).isNull().cast("bigint"), "_key": F.coalesce(key, F.lit(0).cast("bigint"))}
    placed = ranked(rows.filter(eligible).withColumns(order), list(order), **sort).drop(*order)
    n = rows.filter(eligible).count() * share // 100
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    rest = rows.filter(~eligible).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest)


def digest(docs: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_features, weight, score, rank."""
    return resampled(docs, target, key).select(key, "n_features", "weight", "score", "rank")
