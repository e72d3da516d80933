"""Nearest neighbours: inverted lists whose vectors are scanned in column blocks, most of them only for a block or two.

**Index.** Centroids are fitted to at most `SAMPLE` vectors; every vector goes to the list of its nearest centroid, next to its copy
turned by a random rotation. After a rotation, the squared distance over the first d of D dimensions, times D/d, estimates the
whole one, with a relative error that falls as 1/sqrt(d) whatever the data.

**Search.** A query goes to its nearest lists. In each, distances over the first block of columns are one matrix product; the nearest
k + 1 of these are measured in full, and the largest of their distances bounds the result. Then block by block the hypothesis "it
is no farther than the bound" is tested for each candidate: where the estimate exceeds the bound by more than
(1 + EPSILON/sqrt(d)) squared, it is abandoned. What is left is measured in double precision on the original vectors.

**Probes.** How many lists a query visits is found on the sample: the fewest that hold `TARGET` of the true neighbours of
`PROBED` vectors among the sample, whose neighbours are farther away than those in the whole table. Lists are added until they hold
k + 1 ids, so a query finds k neighbours where there are k.

**Scale.** Vectors move once to be grouped with their copies and once with their list. Equal vectors are one row with their k + 1
least ids: no other copy can be among anyone's k nearest, as ties go to smaller ids. A list is cut into parts of `PART_ROWS` vectors, and
the queries that visit it into blocks of `BLOCK_QUERIES`; every group of the search is one part and one block. Centroids and the
sizes of lists (at most `LISTS` rows) are all that the driver and all tasks hold.

**Cases.** Vectors that are null, empty, zero or hold null or non-finite components, ids that are null, and vectors of another length
than the most frequent one (the shorter of two) take no part. Repeated rows count once. Rows of one id are one
query by each of their vectors and one candidate by the nearest of them; none is its own query's candidate. With fewer than k candidates all of them are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.llm.storage import written

SAMPLE = 16_384     # vectors that centroids and probes are fitted to
LISTS = 4_096       # most lists
ROUNDS = 8          # of k-means
TARGET = 0.99       # share of true neighbours in the lists visited, on the sample
PROBED = 512        # sample vectors on which this is measured
COLUMNS = 16        # in a block
EPSILON = 3.0       # of the hypothesis test
PART_ROWS = 4_096
BLOCK_QUERIES = 512
PAIRS = 1 << 17     # candidates gathered at once in a block
SEED = 41


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v: the rows that take part."""
    kind = vectors.schema[vector].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast(T.ArrayType(kind)).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (lengths["n"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """An array column as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _unpacked(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=kind).reshape(len(column), -1).astype(np.float64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances between rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


@dataclass(frozen=True)
class Lists:
    """What the sample gave: centroids, how many lists a query visits, and the rotation."""

    centroids: np.ndarray
    probes: int
    rotation: np.ndarray

    def of(self, rows: np.ndarray) -> np.ndarray:
        return squared(rows, self.centroids).argmin(1) if len(rows) else np.zeros(0, np.int64)


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def fitted(sample: np.ndarray, rows: int, k: int, target: float = TARGET) -> Lists:
    """Lists for a table of so many distinct vectors from a sample of them."""
    rng = np.random.default_rng(SEED)
    count = max(1, min(LISTS, int(round(rows ** 0.5)), len(sample) // 4))
    centroids = sample[rng.choice(len(sample), count, replace=False)]
    for _ in range(ROUNDS):
        nearest = squared(sample, centroids).argmin(1)
        sizes = np.bincount(nearest, minlength=count)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    nearest = squared(sample, centroids).argmin(1)
    chosen = rng.choice(len(sample), min(PROBED, len(sample)), replace=False)
    apart = squared(sample[chosen], sample)
    apart[np.arange(len(chosen)), chosen] = np.inf
    near = np.argsort(apart, axis=1)[:, :min(k, len(sample) - 1)]
    places = np.argsort(np.argsort(squared(sample[chosen], centroids), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(places, nearest[near], axis=1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else count
    return Lists(centroids, probes, rotation(sample.shape[1]))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v and its k + 1 least ids, ascending. A vector with very many copies is cut down before it is shuffled."""
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    least = rows.withColumn("place", place).filter(F.col("place") <= k + 1)
    return least.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def indexed(vectors: DataFrame, lists: Lists) -> DataFrame:
    """list, ids, v and turned (both as bytes) of every distinct vector."""
    kind = np.float32 if isinstance(vectors.schema["v"].dataType.elementType, T.FloatType) else np.float64

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.of(v), pa.int32()), batch.column(1), _packed(v.astype(kind)), _packed((v @ lists.rotation).astype(np.float32))],
                    ["list", "ids", "v", "turned"])

    return vectors.select("v", "ids").mapInArrow(task, "list int, ids array<bigint>, v binary, turned binary")


def visits(queries: DataFrame, lists: Lists, held: np.ndarray, k: int) -> DataFrame:
    """query_id, lists (those to visit), v and turned of each query; `held` is how many ids each list has."""
    kind = np.float32 if isinstance(queries.schema["v"].dataType.elementType, T.FloatType) else np.float64

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            order = np.argsort(squared(v, lists.centroids), axis=1, kind="stable")
            enough = (held[order].cumsum(axis=1) < k + 1).sum(axis=1) + 1
            chosen = [order[i, :max(lists.probes, n)] for i, n in enumerate(enough.tolist())]
            chosen = [c[held[c] > 0].tolist() for c in chosen]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(chosen, pa.list_(pa.int32())), _packed(v.astype(kind)), _packed((v @ lists.rotation).astype(np.float32))],
                ["query_id", "lists", "v", "turned"])

    return queries.select("id", "v").mapInArrow(task, "query_id bigint, lists array<int>, v binary, turned binary")


def scanned(queries: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) of rotated vectors that no test abandons: with k + 1 nearest rows of each query among them."""
    size = queries.shape[1]
    width = min(COLUMNS, size)
    part = squared(queries[:, :width], candidates[:, :width])
    seeds = min(k + 1, len(candidates))
    near = np.argpartition(part, seeds - 1, axis=1)[:, :seeds]
    bound = ((candidates[near] - queries[:, None, :]) ** 2).sum(2).max(1)
    # room for rounding, as copies have a bound of zero
    bound = bound * (1 + 1e-6) + 1e-6 * ((queries ** 2).sum(1) + (candidates ** 2).sum(1).max())
    q, c = np.nonzero(part * (size / width) <= ((1 + EPSILON / width ** 0.5) ** 2 * bound)[:, None])
    part = part[q, c]
    for first in range(width, size, COLUMNS):
        upto = min(first + COLUMNS, size)
        for a in range(0, len(q), PAIRS):
            b = a + PAIRS
            part[a:b] += ((queries[q[a:b], first:upto] - candidates[c[a:b], first:upto]) ** 2).sum(1)
        allowed = (1 + EPSILON / upto ** 0.5) ** 2 if upto < size else 1.0
        stays = part * (size / upto) <= allowed * bound[q]
        q, c, part = q[stays], c[stays], part[stays]
    return q, c


def searched(index: DataFrame, queries: DataFrame, kind: str, k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each group (list, part, block)."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def group(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        if not candidates.num_rows or not asking.num_rows:
            return schema.empty_table()
        q, c = scanned(_unpacked(asking["turned"], "f4"), _unpacked(candidates["turned"], "f4"), k)
        have, want = _unpacked(candidates["v"], kind), _unpacked(asking["v"], kind)
        ids, names = candidates["ids"].to_pylist(), asking["query_id"].to_numpy()
        score = np.empty(len(q))
        for a in range(0, len(q), PAIRS):
            score[a:a + PAIRS] = np.sqrt(((want[q[a:a + PAIRS]] - have[c[a:a + PAIRS]]) ** 2).sum(1))
        least = np.array([i[0] for i in ids])
        order = np.lexsort((least[c], score, q))
        q, c, score = q[order], c[order], score[order]
        # k + 1 rows have k ids besides the query's own
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        rows = []
        for i in np.flatnonzero(rank <= k).tolist():
            own = names[q[i]]
            rows += [(own, j, score[i]) for j in ids[c[i]] if j != own]
        if not rows:
            return schema.empty_table()
        out = pa.table([pa.array(col) for col in zip(*rows)], schema=schema)
        return out

    keys = ("list", "part", "block")
    return index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(group, "query_id bigint, vec_id bigint, score double")


def nearest(
    vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 10, sample: int = SAMPLE, target: float = TARGET,
    part_rows: int = PART_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which the column `is_query` (over `key`) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    asked = rows.filter(is_query(F.col("id"))).distinct()
    distinct = written(distinct_vectors(rows, k))
    drawn = distinct.orderBy(F.xxhash64("v"), "v").limit(sample).select(F.col("v").cast("array<double>")).toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lists = fitted(_matrix(drawn["v"].combine_chunks()), distinct.count(), k, target)
    kind = "f4" if isinstance(distinct.schema["v"].dataType.elementType, T.FloatType) else "f8"
    index = written(indexed(distinct, lists))
    sizes, held = np.zeros(len(lists.centroids), np.int64), np.zeros(len(lists.centroids), np.int64)
    for at, n, ids in index.groupBy("list").agg(F.count("*"), F.sum(F.size("ids"))).collect():  # at most LISTS rows
        sizes[at], held[at] = n, ids
    visiting = written(visits(asked, lists, held, k))
    asking = np.zeros(len(sizes), np.int64)
    for at, n in visiting.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # at most LISTS rows
        asking[at] = n
    shape = F.broadcast(spark.createDataFrame(
        [(i, max(1, -(-int(n) // part_rows)), max(1, -(-int(a) // block_queries))) for i, (n, a) in enumerate(zip(sizes, asking))],
        "list int, parts int, blocks int"))
    zero = F.lit(0)
    there = index.join(shape, "list").select(
        "list", "ids", "v", "turned", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"),
        F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"))
    here = visiting.select("query_id", "v", "turned", F.explode("lists").alias("list")).join(shape, "list").select(
        "list", "query_id", "v", "turned", F.pmod(F.xxhash64("query_id", "v"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(zero, F.col("parts") - 1)).alias("part"))
    found = searched(there, here, kind, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)


def digest(vectors: DataFrame) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    return nearest(vectors, lambda key: key % 100 == 0)
