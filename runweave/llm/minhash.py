"""Near-duplicate documents: MinHash with tensored banding, every link confirmed on the full shingle sets.

A document's set is its distinct 5-word shingles; documents with |A and B| / |A or B| >= 0.75 are linked, and linked
documents form a component.

**Tensored banding.** 32 minhashes make 16 pieces of two. A table's key combines two pieces, so 120 tables come from 16
pieces: with separate bands of four, that takes 480 minhashes. Two documents share a table exactly if at least two
pieces agree; at similarity 0.75 that fails in 4 of 100,000 pairs, at 0.8 in 3 of a million.

**Steps.** (1) Sets are hashed; documents with equal sets are one from here on, so groups of copies cost one row. (2) The
keys of each set meet in a map-side minimum, and every set is tied to the least one of each of its tables: one row per
set and table, never pairs. (3) Components of these ties hold every pair that shares a table. (4) Whole texts of
components with two or more sets are brought together in tasks of at most `TASK_SHINGLES` shingles and `TASK_SETS` sets
and compared: size ratio first, then agreeing minhashes (12 of 32; at 0.75 fewer agree in 2 of a million pairs), then the
sets. Documents already connected are not compared again. A larger component is cut into blocks and every pair of blocks
is a task, so nothing is left out and no task grows; its links go through components again. (5) The least id of a
component is its name.

**Cases.** Null and empty texts have an empty set, are linked with nothing and are their own component; so is a row
with a null id (component_id null). A text of fewer words than five has one shingle. Rows with equal ids are one document
of that id and get one component. Other columns are kept by `kept_documents`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm import textbytes as tb
from runweave.llm.graph import components
from runweave.llm.storage import checkpointed

WIDTH = 5
PERCENT = 75
HASHES = 32
PIECES = 16
AGREE = 12
TASK_SHINGLES = 4_000_000
TASK_SETS = 1_000
BROADCAST_ROWS = 200_000

_random = np.random.default_rng(20240607)
FACTORS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2)

SKETCH = f"id bigint, n_shingles bigint, set_a bigint, set_b bigint, {', '.join(f'p{i} bigint' for i in range(PIECES))}"


def shingle_sets(data: np.ndarray, borders: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text; all shingles one after another, and where each text's begin (n + 1)."""
    data = tb.LOWER[data]
    starts, ends, firsts = tb.words(data, borders, tb.SPACED)
    runs, heads = tb.shingles(tb.span_hashes(data, starts, ends), firsts, WIDTH)
    sets = []
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
        own = np.sort(runs[a:b])
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if b > a else own)
    return sets, runs, heads


def minhashes(runs: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """text x HASHES; texts without shingles get zeros."""
    out = np.zeros((len(heads) - 1, HASHES), dtype=np.uint64)
    full = np.flatnonzero(np.diff(heads))
    if len(full):
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(runs * FACTORS[k] + TERMS[k], heads[:-1][full])
    return out


def pieces_of(mins: np.ndarray) -> np.ndarray:
    """text x PIECES: two minhashes each."""
    return tb.mix(tb.mix(mins[:, 0::2].copy()) + mins[:, 1::2] * np.uint64(tb.RADIX))


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, set size, 128 bits of the set, pieces."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, borders in tb.pieces(batches, "text"):
            sets, runs, heads = shingle_sets(data, borders)
            pieces = pieces_of(minhashes(runs, heads)).view(np.int64)
            hashes = np.zeros((len(sets), 2), dtype=np.uint64)
            for i, own in enumerate(sets):
                hashes[i, 0] = own.sum(dtype=np.uint64)
                hashes[i, 1] = tb.mix(own + np.uint64(tb.RADIX)).sum(dtype=np.uint64)
            hashes = hashes.view(np.int64)
            columns = [batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                       pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), *(pa.array(pieces[:, i]) for i in range(PIECES))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "set_a", "set_b", *(f"p{i}" for i in range(PIECES))])

    return docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(task, SKETCH)


def table_ties(sets: DataFrame) -> DataFrame:
    """u, v: every set with the least set of each table in which it is not alone."""
    keys = F.array(*(F.xxhash64(F.lit(a * PIECES + b), F.col(f"p{a}"), F.col(f"p{b}")) for a, b in combinations(range(PIECES), 2)))
    # many small parts: 120 rows come from each
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sets.repartition(parts, "id").select("id", F.explode(keys).alias("key"))
    least = rows.groupBy("key").agg(F.min("id").alias("v"), F.max("id").alias("last")).filter("v < last").select("key", "v")
    return rows.join(least, "key").filter("id <> v").select(F.col("id").alias("u"), "v").distinct()


class Forest:
    """Disjoint sets of the numbers below n; the root of a set is its least member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, one: int, other: int) -> None:
        a, b = self.root[one], self.root[other]
        if a != b:
            self.root[self.root == max(a, b)] = min(a, b)


def linked(sets: list[np.ndarray], mins: np.ndarray) -> np.ndarray:
    """Of each set the least set of its component; sets must be in the order of their ids."""
    sizes = np.array([len(s) for s in sets])
    forest, order = Forest(len(sets)), np.argsort(sizes, kind="stable")
    flat, heads = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])
    by_size = sizes[order]

    def confirm(i: int, others: np.ndarray) -> None:
        n = sizes[others]
        at = np.repeat(heads[others] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        values, own = flat[at], sets[i]
        found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        common = np.add.reduceat(found.astype(np.int64), np.concatenate([[0], np.cumsum(n)[:-1]]))
        for j in others[100 * common >= PERCENT * (n + sizes[i] - common)].tolist():
            forest.join(i, j)

    for place, i in enumerate(order.tolist()):
        last = np.searchsorted(by_size, by_size[place] * 100 // PERCENT, side="right")
        others = order[place + 1:last]
        others = others[forest.root[others] != forest.root[i]]
        if not len(others):
            continue
        agree = (mins[others] == mins[i]).sum(axis=1)
        others, agree = others[agree >= AGREE], agree[agree >= AGREE]
        ranked = others[np.argsort(-agree, kind="stable")]
        for some in (ranked[:1], ranked[1:9], ranked[9:]):  # what the most alike connect need not be compared
            some = some[forest.root[some] != forest.root[i]]
            if len(some):
                confirm(i, some)
    return forest.root


def confirmed(docs: DataFrame, clusters: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(clusters with their number of blocks, u and v of links confirmed on full sets), written to the shared folder.

    clusters: id, cluster, n_shingles of sets in clusters of two or more.
    """
    weight = clusters.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / TASK_SHINGLES), F.ceil(F.count("*") / TASK_SETS)).alias("blocks"))
    # one block is one task; beyond that half-size blocks, as a task holds two
    weight = weight.withColumn("blocks", F.when(F.col("blocks") > 1, 2 * F.col("blocks")).otherwise(1).cast("int"))
    placed = clusters.join(weight, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    placed = checkpointed(placed.select("id", "cluster", "blocks", "own"))
    size = placed.count()
    texts = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    members = texts.join(F.broadcast(placed) if size <= BROADCAST_ROWS else placed, "id")
    tasks = members.select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "own", "id", "text")
    tasks = tasks.select("cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id", "text")

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        ids = table["id"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))  # rows of one id: the first text in order
        column = table["text"].take(pa.array(first)).combine_chunks()
        data, borders = tb.packed(column if isinstance(column, pa.Array) else column.chunk(0))
        sets, runs, heads = shingle_sets(data, borders)
        root = linked(sets, minhashes(runs, heads))
        apart = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"u": ids[first][apart], "v": ids[first][root[apart]]})

    return placed, checkpointed(tasks.groupBy("cluster", "a", "b").applyInArrow(task, "u bigint, v bigint"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept of every row of docs."""
    made = checkpointed(sketches(docs, key, text))
    known = made.filter("id IS NOT NULL AND n_shingles > 0")
    # of rows with one id the last set in order stands for the document's name; all their sets carry that id
    sets = checkpointed(known.groupBy("set_a", "set_b").agg(
        F.min("id").alias("id"), *(F.first(c).alias(c) for c in ["n_shingles", *(f"p{i}" for i in range(PIECES))])))
    near = components(table_ties(sets))
    clusters = near.unionAll(near.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("id"), F.col("root").alias("cluster"))
    clusters = sets.select("id", "n_shingles").join(clusters, "id")
    placed, links = confirmed(docs, clusters, key, text)
    cut = placed.filter("blocks > 1")
    if not cut.isEmpty():  # links of components in several tasks have to be put together
        links = components(links).select(F.col("node").alias("u"), F.col("root").alias("v"))
    named = sets.select("set_a", "set_b", "id").join(links.groupBy("u").agg(F.min("v").alias("v")), F.col("id") == F.col("u"), "left")
    named = named.select("set_a", "set_b", F.coalesce("v", "id").alias("component"))
    out = made.join(named, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose id is the name of their component, with their columns."""
    dropped = checkpointed(classes(docs, key, text).filter("NOT kept").select(F.col(key).alias("_kept")).distinct())
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs[key].cast("bigint") == dropped["_kept"], "left_anti")
