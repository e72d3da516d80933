"""Whole Arrow batches of text as byte arrays, and their words as arrays of positions and 64-bit hashes.

Everything here works inside a task on one batch at a time, cut into pieces of a few MB; a single longer text
makes a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20
U64 = np.uint64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bytes of words: everything but white space (0x20, 0x09-0x0D)
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: bytes of words: digits, letters a-z of the lower-cased text, and all of UTF-8 beyond ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; a bijection."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


#: one random value per byte, so that sums over positions do not cancel
BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
RADIX = 0x9DDFEA08EB382D69  # odd, so it has an inverse modulo 2^64
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX**i and RADIX**-i for i < n, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", RADIX), ("down", pow(RADIX, -1, 1 << 64))):
            out = np.full(max(n, PIECE_BYTES + 1), base, dtype=U64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column one after another, and where each begins (n + 1 borders). Null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    borders = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[borders[0]:borders[-1]], borders - borders[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[tuple]:
    """(piece of the batch, its bytes, borders) with at most `limit` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, borders = packed(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(borders, borders[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield (batch.slice(first, last - first), data[borders[first]:borders[last]],
                   borders[first:last + 1] - borders[first])
            first = last


def words(data: np.ndarray, borders: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes, and the number of the first word of each text (n + 1)."""
    inside = kind[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    # texts stand next to each other: a word never runs over a border
    edge = borders[(borders > 0) & (borders < len(data))]
    opens[edge] = inside[edge]
    closes[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, borders)


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words of each text, and the first run of each text (n + 1).

    A text with fewer words, but not none, has one run: all its words.
    """
    counts = np.diff(firsts)
    n = len(hashes)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    heads = np.concatenate([[0], np.cumsum(runs)])
    owner = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(heads[-1]) - heads[owner] + firsts[owner]
    factors = [U64(pow(RADIX, 2 * k + 3, 1 << 64)) for k in range(width)]
    full = max(0, len(hashes) - width + 1)
    sums = np.zeros(len(hashes), dtype=U64)
    for k in range(width):
        sums[:full] += hashes[k:k + full] * factors[k]
    out = sums[at] + U64(width)
    short = np.flatnonzero(counts[owner] < width)
    for i in short.tolist():  # one run of all words
        own = hashes[at[i]:at[i] + counts[owner[i]]]
        out[i] = (own * np.array(factors[:len(own)], dtype=U64)).sum(dtype=U64) + U64(len(own))
    return mix(out), heads
