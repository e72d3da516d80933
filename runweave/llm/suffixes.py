"""Substring dedup by suffix arrays: bytes covered by a 100-byte string that also starts earlier in the corpus.

**Two-stage sorting** (`suffix_order`). Suffixes smaller than their successor are sorted directly. All others are
induced by scanning buckets of first bytes in order: whoever stands before a suffix just placed and is greater than it takes the
next place at the head of its own bucket. Adjacent common prefixes then show which 100-byte strings are equal.

**Distribution.** A corpus-wide array would take a row per byte. So the places that can matter are found first: the least hash
among the 37-byte strings inside a 100-byte string is the same for equal strings. Runs of starts that share one place of the least hash are
segments, one for about 33 bytes; two equal strings are never in one segment. (1) Segments whose hash occurs once are let go (`repeats`: one shuffle, dealt by ranges, so hot
hashes are cut up). (2) Segments with equal bytes are aggregated to the earliest: groups of copies cost one row here. (3) Hashes with
two or more different segments are brought together, about `TASK_STARTS` starts a task, and a suffix array over them finds equal strings. A
hash with more than `HOT_SEGMENTS` different segments (the borders of a passage that very many texts share) is cut
into its single strings, which are aggregated by their own hashes. (4) Marks return to
their segments, those of hot ones without moving rows (`spread.py`), and with them to their documents, where spans are cut out.

**Cases.** Null texts are empty; nothing shorter than 100 bytes is removed. Bytes are judged on the input, overlaps count,
also within a document. Rows with a null id come last in order. Rows with equal ids, or without one, and equal texts do not remove each
other, as neither starts earlier; of those with unlike texts the order is that of a hash of the text, so what they share stays in one of
them. An empty table gives no rows.
Strings are compared byte by byte within a task and by 64 or 128 bits of hashes across tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm import textbytes as tb
from runweave.llm.repeats import repeated
from runweave.llm.spread import spread_join
from runweave.llm.storage import written

LENGTH = 100
GRAM = 37
RUN = LENGTH - GRAM + 1  # starts of one segment at most, so that a mark fits in 64 bits
TASK_STARTS = 200_000
HOT_SEGMENTS = 5_000
PIECE_BYTES = 1 << 20  # of text that is hashed at once, some 100 bytes of memory each
SHARED_IDS = 200_000  # ids of several rows that are broadcast; with more of them all rows are told apart by their texts too
LAST_ID = (1 << 63) - 1
ALL = -1  # a mark with all bits


def run_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbouring values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def segments_of(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first start, number of starts, least hash and content hash of each segment."""
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < LENGTH:
        return none
    up, down = tb.powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(tb.BYTE_VALUES[data] * up[:-1], out=total[1:])
    grams = tb.mix((total[GRAM:] - total[:-GRAM]) * down[:len(data) - GRAM + 1])
    least = run_minima(grams, RUN)  # of each start of a 100-byte string
    n = len(least)
    text = np.repeat(np.arange(len(borders) - 1), np.diff(borders))[:n]
    inside = np.arange(n) + LENGTH <= borders[1:][text]
    new = np.ones(n, dtype=bool)
    # a start at which the least string begins is the last with that very place
    new[1:] = (least[1:] != least[:-1]) | (grams[:n - 1] == least[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    first, size = first[inside[first]], size[inside[first]]
    last = first + size + LENGTH - 1
    content = tb.mix((total[last] - total[first]) * down[first] + size.astype(np.uint64))
    return text[first], first - borders[:-1][text[first]], size, least[first].view(np.int64), content.view(np.int64)


def segments(docs: DataFrame) -> DataFrame:
    """h: least hash, s: content, d, c: document, at: first start * 256 + number of starts. docs: d, c, text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, borders in tb.pieces(batches, "text", PIECE_BYTES):
            text, first, size, h, s = segments_of(data, borders)
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(s), pa.array(ids[text]), pa.array(hashes[text]), pa.array(first * 256 + size)], names=["h", "s", "d", "c", "at"])

    return docs.mapInArrow(task, "h bigint, s bigint, d bigint, c bigint, at bigint")


def suffix_order(text: np.ndarray, borders: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of all bytes of the texts in the order of their suffixes, each suffix ending with its text.

    Suffixes are told apart by at least `depth` bytes, so equal strings of that length stand together; beyond, the order is arbitrary.
    """
    n = len(text)
    end = np.zeros(n, dtype=bool)
    end[borders[1:][np.diff(borders) > 0] - 1] = True
    # smaller than the successor? the last byte of a text is greater than the empty suffix behind it
    following = np.append(text[1:], 0)
    known = end | (text != following)
    smaller = (text < following) & ~end
    where = np.flatnonzero(known)
    smaller = smaller[where[np.searchsorted(where, np.arange(n))]] if n else smaller  # a run of one byte decides as its last does
    direct = np.flatnonzero(smaller)
    limit = np.repeat(borders[1:], np.diff(borders))
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    if len(direct):
        rows = padded[direct[:, None] + np.arange(depth)]
        short = np.flatnonzero(limit[direct] - direct < depth)
        rows[short] *= (np.arange(depth) < (limit[direct[short]] - direct[short])[:, None]).astype(np.uint8)
        direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    # buckets by first byte; per bucket what is induced comes first
    by_byte = np.concatenate([[0], np.cumsum(np.bincount(text[direct], minlength=256))])
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(placed: np.ndarray) -> None:
        """Greater suffixes right before placed ones, in order, to the buckets of their first bytes."""
        before = placed[(placed > 0)] - 1
        before = before[~smaller[before] & ~end[before]]
        for byte in np.unique(text[before]).tolist():
            waiting[byte].append(before[text[before] == byte])

    order = []
    last = np.flatnonzero(end)  # before the empty suffixes, which come first of all
    for byte in np.unique(text[last]).tolist():
        waiting[byte].append(last[text[last] == byte])
    for byte in range(256):
        while waiting[byte]:  # a suffix may put one into its own bucket, behind itself
            placed = waiting[byte].pop(0)
            order.append(placed)
            induce(placed)
        placed = direct[by_byte[byte]:by_byte[byte + 1]]
        order.append(placed)
        induce(placed)
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Equal bytes, `depth` at most, of each suffix and the one before it in the order; the first has 0.

    All suffixes must have `depth` bytes.
    """
    out = np.zeros(len(order), dtype=np.int64)
    left = np.arange(1, len(order))
    for k in range(depth):
        left = left[text[order[left] + k] == text[order[left - 1] + k]]
        if not len(left):
            break
        out[left] = k + 1
    return out


def equal_strings(text: np.ndarray, borders: np.ndarray, sizes: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mark of each segment: bit o is set if its string at o also starts earlier, in another segment or in this one.

    doc: numbers that ascend with the documents' order.
    """
    owner = np.repeat(np.arange(len(sizes)), np.diff(borders))
    offset = np.arange(len(text)) - borders[:-1][owner]
    order = suffix_order(text, borders)
    order = order[offset[order] < sizes[owner[order]]]
    group = np.cumsum(common_prefixes(text, order) < LENGTH)
    o = owner[order]
    ranked = np.lexsort((first[o] + offset[order], doc[o], group))
    group, o, place = group[ranked], o[ranked], offset[order][ranked]
    start = first[o] + place
    # equal places are one string of two rows, of which neither is earlier
    new = np.concatenate([[True], group[1:] != group[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    later = (doc[o] != doc[o][head]) | (start != start[head])
    marks = np.zeros(len(sizes), dtype=np.uint64)
    np.bitwise_or.at(marks, o[later], np.uint64(1) << place[later].astype(np.uint64))
    return marks.view(np.int64)


CODEC = "zstd"


def packed_texts(docs: DataFrame) -> DataFrame:
    """The keys of documents with z, their packed bytes, as they are to be shuffled. docs: whole numbers, then the text."""
    keys = docs.columns[:-1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC)
        for batch in batches:
            rows = [(t or "").encode("utf-8") for t in batch.column(len(keys)).to_pylist()]
            z = [len(b).to_bytes(8, "little") + codec.compress(b, asbytes=True) for b in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(z, pa.binary())], names=[*keys, "z"])

    return docs.mapInArrow(task, ", ".join(f"{k} bigint" for k in keys) + ", z binary")


def unpacked(z: bytes) -> bytes:
    return pa.Codec(CODEC).decompress(z[8:], int.from_bytes(z[:8], "little"), asbytes=True)


def segment_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `wanted` (h, s, d, c, at) with the bytes of their segments; of rows with equal ids and texts, those of each."""
    lists = wanted.groupBy("d", "c").agg(F.collect_list(F.struct("h", "s", "at")).alias("own"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(3)
            heads, flat = own.offsets.to_numpy(), own.flatten()
            at = flat.field("at").to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(heads))
            first, size, base = at >> 8, at & 255, heads[0]
            cut = []
            for i, z in enumerate(batch.column(2).to_pylist()):
                text = unpacked(z)
                for j in range(heads[i] - base, heads[i + 1] - base):
                    cut.append(text[first[j]:first[j] + size[j] + LENGTH - 1])
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [flat.field("h"), flat.field("s"), batch.column(0).take(take), batch.column(1).take(take), flat.field("at"), pa.array(cut, pa.binary())],
                names=["h", "s", "d", "c", "at", "cut"])

    return texts.join(lists, ["d", "c"]).select("d", "c", "z", "own").mapInArrow(task, "h bigint, s bigint, d bigint, c bigint, at bigint, cut binary")


def array_marks(cuts: DataFrame, tasks: int) -> DataFrame:
    """h, s, mark from one suffix array a task."""

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("d", "ascending"), ("c", "ascending"), ("at", "ascending")])
        column = table["cut"].combine_chunks()
        text, borders = tb.packed(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks))
        at = table["at"].to_numpy()
        d, c = table["d"].to_numpy(), table["c"].to_numpy()
        doc = np.concatenate([[0], np.cumsum((d[1:] != d[:-1]) | (c[1:] != c[:-1]))])
        marks = equal_strings(text, borders, at & 255, doc, at >> 8)
        return pa.table({"h": table["h"], "s": table["s"], "mark": marks})

    return cuts.groupBy(F.pmod(F.xxhash64("h"), F.lit(tasks)).alias("task")).applyInArrow(task, "h bigint, s bigint, mark bigint")


def string_marks(cuts: DataFrame) -> DataFrame:
    """h, s, mark of segments with hot hashes: their strings, one row each, aggregated by 128 bits of hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                batch = whole.slice(i, 4096)
                text, borders = tb.packed(batch.column(5))
                at = batch.column(4).to_numpy()
                size, first = at & 255, at >> 8
                owner = np.repeat(np.arange(batch.num_rows), size)
                o = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                start = borders[:-1][owner] + o
                one = tb.span_hashes(text, start, start + LENGTH)
                other = tb.span_hashes(255 - text, start, start + LENGTH)
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(one.view(np.int64)), pa.array(other.view(np.int64)),
                     batch.column(2).take(take), batch.column(3).take(take), pa.array(first[owner] + o), pa.array(o.astype(np.int32))],
                    names=["h", "s", "a", "b", "d", "c", "p", "o"])

    rows = cuts.mapInArrow(task, "h bigint, s bigint, a bigint, b bigint, d bigint, c bigint, p bigint, o int")
    least = rows.groupBy("a", "b").agg(F.min(F.struct("d", "c", "p")).alias("x"), F.count("*").alias("n")).filter("n > 1")
    later = rows.join(least, ["a", "b"]).filter("d <> x.d OR c <> x.c OR p <> x.p")
    return later.groupBy("h", "s").agg(F.expr("bit_or(shiftleft(1L, o))").alias("mark"))


def marks(docs: DataFrame) -> DataFrame:
    """d, c, at, mark: starts of strings that also start earlier. docs: d, c, text."""
    spark = docs.sparkSession
    found = written(repeated(segments(docs), "h", "d", "c", "at"))
    firsts = written(found.groupBy("h", "s").agg(F.min(F.struct("d", "c", "at")).alias("x"), F.count("*").alias("n")))
    several = written(firsts.groupBy("h").agg(F.count("*").alias("segments")).filter("segments > 1"))
    wanted = firsts.join(several, "h").select("h", "s", "x.d", "x.c", "x.at", "segments")
    small = wanted.filter(F.col("segments") <= HOT_SEGMENTS)
    starts = small.agg(F.sum(F.expr("at & 255"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-starts // TASK_STARTS))
    cuts = written(segment_texts(packed_texts(docs), wanted.select("h", "s", "d", "c", "at")))
    hot = several.filter(F.col("segments") > HOT_SEGMENTS).select("h")
    own = array_marks(cuts.join(hot, "h", "left_anti"), parts)
    if not hot.isEmpty():
        own = own.unionAll(string_marks(cuts.join(hot, "h", "left_semi")))
    own = own.filter("mark <> 0").groupBy("h", "s").agg(F.expr("bit_or(mark)").alias("mark"))  # once for rows that are repeated
    named = firsts.join(own, ["h", "s"], "left").select("h", "s", "x", "n", F.coalesce("mark", F.lit(0)).cast("bigint").alias("mark"))
    named = written(named.filter("n > 1 OR mark <> 0"))
    is_first = (F.col("d") == F.col("x.d")) & (F.col("c") == F.col("x.c")) & (F.col("at") == F.col("x.at"))
    marked = spread_join(found, named, ["h", "s"], "n").select("d", "c", "at", F.when(is_first, F.col("mark")).otherwise(F.lit(ALL)).cast("bigint").alias("mark"))
    return marked.filter("mark <> 0")


def removed_spans(length: int, at: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the removed runs of a text."""
    first, size = at >> 8, at & 255
    bits = (mark.view(np.uint64)[:, None] >> np.arange(RUN, dtype=np.uint64)) & np.uint64(1)
    row, o = np.nonzero(bits.astype(bool) & (np.arange(RUN) < size[:, None]))
    edge = np.zeros(length + 2, dtype=np.int64)
    start = first[row] + o
    start = start[start + LENGTH <= length]
    np.add.at(edge, start, 1)
    np.add.at(edge, start + LENGTH, -1)
    inside = np.concatenate([[False], np.cumsum(edge)[:length] > 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[0::2], turns[1::2]


def ordered_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """d, c, text: the rows in the order of (d, c). c is 0 where the id is the row's own, else a hash of its text.

    Only ids are read to find the shared ones; all rows without an id share one.
    """
    own = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LAST_ID)).alias("d"), F.col(text).alias("text"))
    shared = written(own.groupBy("d").agg(F.count("*").alias("rows")).filter("rows > 1").select("d", F.lit(True).alias("shared")))
    hashed = F.xxhash64("text")
    if shared.count() > SHARED_IDS:
        return own.select("d", hashed.alias("c"), "text")
    told = F.when(F.col("shared"), hashed).otherwise(F.lit(0)).cast("bigint")
    return own.join(F.broadcast(shared), "d", "left").select("d", told.alias("c"), "text")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, spans (begin, end of removed runs of bytes), kept (bytes that are left) of every row."""
    own = ordered_rows(docs, key, text)
    lists = marks(own).groupBy("d", "c").agg(F.collect_set(F.struct("at", "mark")).alias("own"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, runs, kept = [], [], []
            for z, own in zip(batch.column(2), batch.column(3)):
                data = unpacked(z.as_py())
                sizes.append(len(data))
                begins = ends = np.zeros(0, np.int64)
                if own.is_valid:
                    begins, ends = removed_spans(len(data), own.values.field("at").to_numpy(), own.values.field("mark").to_numpy())
                runs.append([{"begin": b, "end": e} for b, e in zip(begins.tolist(), ends.tolist())])
                kept.append(b"".join(data[b:e] for b, e in zip([0, *ends.tolist()], [*begins.tolist(), len(data)])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["d", "n_bytes", "spans", "kept"])

    out = packed_texts(own).join(lists, ["d", "c"], "left").select("d", "c", "z", "own").mapInArrow(task, "d bigint, n_bytes bigint, spans array<struct<begin:bigint,end:bigint>>, kept binary")
    return out.select(F.when(F.col("d") == LAST_ID, None).otherwise(F.col("d")).alias(key), "n_bytes", "spans", "kept")


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["begin"])
    return spans(docs, key).select(key, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
