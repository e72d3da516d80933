"""Benchmark decontamination by a distributed positional inverted index.

**Index.** The training documents stay where they are: each task turns a few MB of them at a time into one shard of the
index, the postings (term, position) of every token that a test item uses, sorted by term and position. No document
is shuffled, so no source, phrase or word can overload a task.

**Search.** Each test item gives its windows of 13 consecutive words (an item of fewer words gives one window). In a
shard a window starts from the postings of its rarest term, moved back by the term's place in the window; the other terms'
lists, moved likewise, are intersected with it in order of rarity. What is left after all terms is an exact phrase
match.

**Proximity.** The terms of a window are ranked by how often the whole corpus has them, counted in a pass before. Its
`NEAR_TERMS` rarest ones that occur at all have to stand within `SLOP` words of their places in one document, one of them may
be missing. Candidates start at each of the two rarest, so what is found does not depend on how documents are dealt.

**Blocks.** Test items are the query set. They reach the tasks in blocks of at most `BLOCK_WORDS` words, so each
broadcast has a fixed bound; every block is one more step over the same rows, in the same stage, without a shuffle.

**Cases.** Null and empty texts have no words and no hits; null or empty items have no windows. Repeated documents
are judged one by one; items with equal ids count once; an item with a null id is reported as "null". An empty
benchmark finds nothing. Other columns are passed on; `n_words` and `hits` take the place of columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.llm import textbytes as tb
from runweave.llm.columns import set_aside, without

WIDTH = 13
BLOCK_WORDS = 60_000
NEAR_TERMS = 5
SLOP = 3
CANDIDATES = 1_000_000  # that are looked at at once

HITS = pa.list_(pa.struct([("item", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("exact", pa.bool_())]))
HITS_DDL = "array<struct<item:string,start:bigint,words:bigint,exact:boolean>>"


@dataclass
class Block:
    """Windows of some test items: the terms, sorted by hash, and per window its term numbers (-1 beyond its end)."""

    items: list[str]
    terms: np.ndarray
    windows: np.ndarray  # window x WIDTH, term numbers
    lengths: np.ndarray
    owners: np.ndarray  # item number of each window
    sieve: np.ndarray  # which low bits of a hash any term has
    near: np.ndarray  # window x NEAR_TERMS, places of the terms rarest in the corpus (-1: too few occur)


def _block(ids: list[str], texts: list[str | None]) -> Block:
    data, borders = tb.packed(pa.array(texts, pa.string()))
    data = tb.LOWER[data]
    starts, ends, firsts = tb.words(data, borders, tb.ALNUM)
    terms, number = np.unique(tb.span_hashes(data, starts, ends), return_inverse=True)
    rows, lengths, owners = [], [], []
    for item in range(len(ids)):
        own = number[firsts[item]:firsts[item + 1]]
        n = min(len(own), WIDTH)
        for at in range(len(own) - n + 1 if n else 0):
            rows.append(np.pad(own[at:at + n], (0, WIDTH - n), constant_values=-1))
            lengths.append(n)
            owners.append(item)
    sieve = np.zeros(1 << 20, dtype=bool)
    sieve[(terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    windows = np.array(rows, dtype=np.int64).reshape(-1, WIDTH)
    return Block(ids, terms, windows, np.array(lengths, dtype=np.int64), np.array(owners, dtype=np.int64), sieve,
                 np.full((len(windows), NEAR_TERMS), -1, dtype=np.int64))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", limit: int = BLOCK_WORDS) -> Iterator[Block]:
    """The query set in blocks of at most `limit` words, or one item."""
    ids, texts, total = [], [], 0
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).filter("t is not null")
    for row in rows.toLocalIterator():
        words = len(row.t) // 2 + 1  # at most
        if ids and total + words > limit:
            yield _block(ids, texts)
            ids, texts, total = [], [], 0
        ids.append("null" if row.i is None else row.i)
        texts.append(row.t)
        total += words
    if ids:
        yield _block(ids, texts)


def known_terms(block_terms: np.ndarray, sieve: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of tokens that are terms, and the numbers of their terms."""
    at = np.flatnonzero(sieve[(hashes & np.uint64(len(sieve) - 1)).astype(np.int64)])
    term = np.searchsorted(block_terms, hashes[at])
    term[term == len(block_terms)] = 0
    known = block_terms[term] == hashes[at]
    return at[known], term[known]


def rank_terms(docs: DataFrame, found: list[Block], text: str) -> None:
    """Give each block's windows the places of their terms that are rarest in all of docs."""
    for block in found:
        if not len(block.terms):
            continue
        shared = docs.sparkSession.sparkContext.broadcast((block.terms, block.sieve))

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, sieve = shared.value
            total = np.zeros(len(terms), dtype=np.int64)
            for _, data, borders in tb.pieces(batches, text):
                data = tb.LOWER[data]
                starts, ends, _ = tb.words(data, borders, tb.ALNUM)
                total += np.bincount(known_terms(terms, sieve, tb.span_hashes(data, starts, ends))[1], minlength=len(terms))
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

        counts = np.zeros(len(block.terms), dtype=np.int64)
        for row in docs.select(F.col(f"`{text}`")).mapInArrow(task, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
            counts[row.term] = row.n
        never = np.iinfo(np.int64).max
        rarity = np.where((block.windows >= 0) & (counts[block.windows] > 0), counts[block.windows], never)
        order = np.argsort(rarity, axis=1, kind="stable")[:, :NEAR_TERMS]
        enough = np.take_along_axis(rarity, order[:, -1:], axis=1) < never
        block.near = np.where(enough, order, -1)


def near_matches(block: Block, at: np.ndarray, heads: np.ndarray, postings: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) where all of the window's rarest terms but one stand near their places in one document."""
    counts = np.diff(heads)
    found = [np.zeros(0, dtype=np.int64)]
    for anchor in range(2):
        window = np.flatnonzero(block.near[:, anchor] >= 0)
        first = block.windows[window, block.near[window, anchor]]
        window, first = window[counts[first] > 0], first[counts[first] > 0]
        total = np.cumsum(counts[first])
        for part in np.split(np.arange(len(window)), np.flatnonzero(np.diff(total // CANDIDATES)) + 1):
            own, term = window[part], first[part]
            n = counts[term]
            position = at[np.repeat(heads[term] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(n.sum())]
            own = np.repeat(own, n)
            start = position - block.near[own, anchor]
            low, high = np.searchsorted(owner, owner[position]), np.searchsorted(owner, owner[position], side="right") - 1
            stand = np.zeros(len(own), dtype=np.int64)
            for k in range(NEAR_TERMS):
                place = block.near[own, k]
                number = block.windows[own, place] << 32
                least, most = np.maximum(start + place - SLOP, low), np.minimum(start + place + SLOP, high)
                next_one = np.searchsorted(postings, number | least)
                stand += (least <= most) & (next_one < len(postings)) & (postings[np.minimum(next_one, len(postings) - 1)] <= (number | most))
            keep = stand >= NEAR_TERMS - 1
            # starts before the document are its first word
            found.append((own[keep] << 32) | np.maximum(start[keep], low[keep]))
    both = np.unique(np.concatenate(found))
    return both >> 32, both & 0xFFFFFFFF


def search_shard(block: Block, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, exact) of the matches in one shard; `owner` is the document of each token."""
    none = np.zeros(0, dtype=np.int64)
    if not len(block.windows) or not len(hashes):
        return none, none, none.astype(bool)
    # postings: term and position in one number, sorted
    at, term = known_terms(block.terms, block.sieve, hashes)
    if not len(at):
        return none, none, none.astype(bool)
    order = np.argsort(term, kind="stable")
    postings = (term[order].astype(np.int64) << 32) | at[order]
    counts = np.bincount(term, minlength=len(block.terms))
    heads = np.concatenate([[0], np.cumsum(counts)])

    wide = np.where(block.windows >= 0, counts[block.windows], np.iinfo(np.int64).max)
    rarity = np.argsort(wide, axis=1, kind="stable")  # places of the window from its rarest term on
    alive = np.flatnonzero(wide.min(axis=1) > 0)
    place = rarity[alive, 0]
    first = block.windows[alive, place]
    n = counts[first]
    window = np.repeat(alive, n)
    start = at[order][np.repeat(heads[first] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] - np.repeat(place, n)
    inside = (start >= 0) & (start + block.lengths[window] <= len(hashes))
    window, start = window[inside], start[inside]
    inside = owner[start] == owner[start + block.lengths[window] - 1]
    window, start = window[inside], start[inside]

    exact = np.ones(len(window), dtype=bool)
    for k in range(1, WIDTH):
        left = np.flatnonzero(exact)
        if not len(left):
            break
        place = rarity[window[left], k]
        left, place = left[block.windows[window[left], place] >= 0], place[block.windows[window[left], place] >= 0]
        wanted = (block.windows[window[left], place] << 32) | (start[left] + place)
        found = np.searchsorted(postings, wanted)
        exact[left] &= postings[np.minimum(found, len(postings) - 1)] == wanted
    window, start = window[exact], start[exact]
    near, begin = near_matches(block, at[order], heads, postings, owner)
    # a window that matches exactly is no proximity match beside that place
    whole = np.sort((window << 32) | start)
    if len(whole):
        wanted = (near << 32) | begin
        next_one = np.searchsorted(whole, np.maximum(wanted - SLOP, near << 32))
        alone = (next_one == len(whole)) | (whole[np.minimum(next_one, len(whole) - 1)] > wanted + SLOP)
        near, begin = near[alone], begin[alone]
    return np.concatenate([window, near]), np.concatenate([start, begin]), np.arange(len(window) + len(near)) < len(window)


def _runs(block: Block, window, start, exact, owner, firsts) -> dict[int, list[dict]]:
    """Matches of each document, runs of windows of one item put together."""
    item = block.owners[window]
    order = np.lexsort((start, item, ~exact))
    out: dict[int, list[dict]] = {}
    before = None
    for w, s, e, i in zip(window[order].tolist(), start[order].tolist(), exact[order].tolist(), item[order].tolist()):
        doc = int(owner[s])
        n = min(int(block.lengths[w]), int(firsts[doc + 1]) - s)
        if before and before[0] == (doc, i, e) and s <= before[1]["start"] + before[1]["words"]:
            before[1]["words"] = max(before[1]["words"], s + n - before[1]["start"])
            continue
        hit = {"item": block.items[i], "start": s, "words": n, "exact": e}
        out.setdefault(doc, []).append(hit)
        before = ((doc, i, e), hit)
    for doc, hits in out.items():
        for hit in hits:
            hit["start"] -= int(firsts[doc])
    return out


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
            item_id: str = "item_id", item_text: str = "text", limit: int = BLOCK_WORDS) -> DataFrame:
    """The columns `keep` of docs (default all), `n_words` and `hits`: item, first word, words, exact or near."""
    docs = without(docs, "n_words", "hits")
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    found = list(blocks(benchmark, item_id, item_text, limit)) or [_block([], [])]
    rank_terms(docs, found, text)
    out = docs.select(*docs.columns, F.lit(0).cast("bigint").alias("n_words"), F.expr(f"CAST(array() AS {HITS_DDL})").alias("hits"))
    for number, block in enumerate(found):
        shared = spark.sparkContext.broadcast(block)
        names = [*(keep if number == len(found) - 1 else docs.columns), "n_words", "hits"]

        def task(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch, data, borders in tb.pieces(batches, text):
                data = tb.LOWER[data]
                starts, ends, firsts = tb.words(data, borders, tb.ALNUM)
                owner = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
                hits = _runs(block, *search_shard(block, tb.span_hashes(data, starts, ends), owner), owner, firsts)
                lists = batch.column(batch.schema.get_field_index("hits")).to_pylist()
                for i, own in hits.items():
                    lists[i] = lists[i] + own
                made = {"n_words": pa.array(np.diff(firsts), pa.int64()), "hits": pa.array(lists, HITS)}
                yield pa.RecordBatch.from_arrays(
                    [made[c] if c in made else batch.column(batch.schema.get_field_index(c)) for c in names], names=names)

        out = out.mapInArrow(task, T.StructType([out.schema[c] for c in names]))
    return out


def hit_words(hits) -> F.Column:
    """Words of a document inside any exact hit: length of the union of its spans."""
    spans = F.array_sort(F.transform(F.filter(hits, lambda h: h["exact"]), lambda h: F.struct(h["start"].alias("s"), (h["start"] + h["words"]).alias("e"))))
    state = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("total"))
    return F.aggregate(spans, state, lambda a, x: F.struct(
        F.greatest(a["end"], x["e"]).alias("end"),
        (a["total"] + F.greatest(F.lit(0).cast("bigint"), x["e"] - F.greatest(a["end"], x["s"]))).alias("total")))["total"]


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items, contaminated to what `matches` returns: contaminated from one word in 20 on."""
    items = F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: h["exact"]), lambda h: h["item"])))
    return (
        found.withColumn("n_hit", hit_words(F.col("hits"))).withColumn("items", items)
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = judged(matches(docs.select(key, "text"), benchmark, keep=[key]))
    return found.select(
        key, "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated")


def removed(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    rows, restored = set_aside(docs, "text")
    return restored(judged(matches(rows, benchmark)).filter(~F.col("contaminated")))

