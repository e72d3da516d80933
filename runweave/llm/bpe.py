"""BPE encoding and decoding as a bounded-lookahead streaming transducer, for byte-level vocabularies.

`encode` turns each text into the ids that merging by rank gives, and `decode` turns ids into text again.

**Why a stream can be encoded.** In the encoding of a text the tokens before a border are the encoding of the bytes
before that border, and a sequence of tokens is an encoding exactly if every two neighbours are one. So the encodings
of all prefixes form a tree: each position has one last token, whose start is the position it hangs from. Any
longer text's encoding passes through one of the last L positions, where L is the length of the longest token the
merge list can make: that is the sufficient lookahead. Tokens before the point where the branches of those positions
meet never change again and are emitted; only the positions after that point are kept. A position that no longer
has a branch among the last L is let go.

**Words.** Positions depend on the bytes before them only. So the pre-tokens of a batch that have not been seen are taken in sorted
order, and each starts from the positions that it shares with the one before it: `Transducer.word`.

**Parts.** `MergeList` is read from the vocabulary's JSON file. `Transducer` takes bytes of one pre-token in any
chunks. `TextDecoder` is the other direction: bytes go in, text comes out as soon as a character is complete, and
malformed bytes become U+FFFD by the usual rule of maximal parts. Pre-tokens (the file's split pattern) that have been
seen are kept in a table of a fixed number of entries.

Null texts encode as empty ones; other columns are passed on, and an output column takes the place of one of its name.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.columns import without

#: fixed values: the split pattern of this kind of vocabulary
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
KNOWN_PAIRS = 300_000  # pairs of tokens of which it is remembered whether they may be neighbours
DECODED = 16_384  # ids that are decoded at once
KNOWN_WORDS = 120_000  # entries of each of two tables of seen pre-tokens; the older one is dropped when the newer is full
#: the same pattern for texts of code points below 256, where the classes can be written out
_LETTERS, _NUMBERS, _SPACES = (
    "".join(re.escape(chr(c)) for c in range(256) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
SPLIT_LATIN = re.compile(
    f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+"
    f"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
LATIN = re.compile(r"[\x00-\xff]*\Z")
CHUNK = 1024  # bytes of a pre-token read at once; after each chunk what is stable is emitted
ROWS = 2_000  # of a batch that are encoded and decoded at once
PIECE_CHARS = 4_000_000  # of texts whose unseen pre-tokens are encoded together


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 byte values in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pre_tokens(text: str) -> list[str]:
    return (SPLIT_LATIN if LATIN.match(text) else SPLIT).findall(text)


class MergeList:
    """Tokens, merges and their ranks; what the transducer has to know about them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, byte_of = spec["model"], byte_alphabet()
        raw = {token: bytes(byte_of[c] for c in token) for token in model["vocab"]}
        self.ids = {raw[token]: i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.text_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, (left, right) in enumerate(pairs):
            a, b = model["vocab"][left], model["vocab"][right]
            token = self.ids[raw[left] + raw[right]]
            self.rank.setdefault((a, b), rank)
            if token not in self.parts:
                self.parts[token], self.born[token] = (a, b), rank
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.born |= dict.fromkeys(self.single, -1)
        # only what the merges can make is ever a token of a text
        usable = set(self.single)
        for token, (a, b) in sorted(self.parts.items(), key=lambda x: self.born[x[0]]):
            if a in usable and b in usable and self.neighbours(a, b, self.born[token]):
                usable.add(token)
        self.lookahead = max(len(self.text_of[t]) for t in usable)
        self.pairs: dict[int, bool] = {}
        #: every end of a usable token, with the token that it is, if it is one: a walk backwards stops early
        self.ends: dict[bytes, int | None] = {}
        for token in usable:
            data = self.text_of[token]
            for k in range(1, len(data)):
                self.ends.setdefault(data[k:], None)
            self.ends[data] = token
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def neighbours(self, left: int, right: int, before: int = 1 << 60) -> bool:
        """Whether no merge of a rank below `before` joins the two tokens, side by side, across their border.

        Undoes merges from the latest on. What stands at the border in between would have been joined if its rank
        came before the merge just undone; of equal ranks the left one comes first.
        """
        rank, born, parts = self.rank, self.born, self.parts
        while True:
            joined = rank.get((left, right))
            if joined is not None and joined < before:
                return False
            made_left, made_right = born[left], born[right]
            if made_left > made_right:
                before, left = made_left, parts[left][1]
            elif made_right >= 0:
                before, right = made_right + 1, parts[right][0]
            else:
                return True


    def fits(self, left: int, right: int) -> bool:
        """`neighbours` of two whole tokens, remembered for a fixed number of pairs."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.neighbours(left, right)
        return known


class Transducer:
    """Bytes of one pre-token in, stable tokens out. Keeps the positions that a later byte can still branch from."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.kept = b""  # bytes after the last emitted token
        self.last: list[tuple[int, int] | None] = [None]  # of each kept position: last token, where it starts
        self.before: int | None = None  # the last emitted token

    def feed(self, data: bytes) -> list[int]:
        """Take in bytes; return the tokens that no further byte can change."""
        self._extend(data)
        return self._stable()

    def _extend(self, data: bytes) -> None:
        """Add the position of each byte: the one token that fits there, and where it starts."""
        last, ends, fits, before = self.last, self.merges.ends, self.merges.fits, self.before
        begin = len(self.kept)
        self.kept += data
        kept, size = self.kept, self.merges.lookahead
        for end in range(begin + 1, len(kept) + 1):
            if before is None and end <= size:
                # nothing stands before: what is a token by itself is its own encoding
                token = ends.get(kept[:end])
                if token is not None:
                    last.append((token, 0))
                    continue
            # tokens that end here, the longest first: exactly one fits what stands before it
            start, found = end - 1, []
            while start >= 0:
                token = ends.get(kept[start:end], -1)
                if token == -1:
                    break
                if token is not None and (start == 0 or last[start] is not None):
                    found.append((token, start))
                start -= 1
            for token, start in reversed(found):
                # the first token after emitted ones still has to fit the last of those
                earlier = last[start][0] if start else before
                if earlier is None or fits(earlier, token):
                    last.append((token, start))
                    break

    def word(self, data: bytes) -> list[int]:
        """All tokens of a pre-token. Positions of what its first chunk shares with that of the last one are taken over."""
        head, kept = data[:CHUNK], self.kept
        same, most = 0, min(len(kept), len(head))
        while same < most and kept[same] == head[same]:
            same += 1
        del self.last[same + 1:]
        self.kept = kept[:same]
        if len(data) <= CHUNK:
            self._extend(head[same:])
            return [self.last[p][0] for p in self._path(len(self.kept))[1:]]
        out = self.feed(head[same:])
        for i in range(CHUNK, len(data), CHUNK):
            out += self.feed(data[i:i + CHUNK])
        return out + self.finish()

    def _path(self, position: int) -> list[int]:
        out = [position]
        while position:
            position = self.last[position][1]
            out.append(position)
        return out[::-1]

    def _stable(self) -> list[int]:
        """Tokens common to the branches of the last positions within the lookahead."""
        end = len(self.kept)
        first = max(0, end - self.merges.lookahead + 1)
        live = set(range(first, end + 1))
        # walk all live branches back, always the furthest position, until one is left
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(self.last[far][1])
        return self._emit(live.pop())

    def _emit(self, border: int) -> list[int]:
        if not border:
            return []
        path = self._path(border)
        tokens = [self.last[p][0] for p in path[1:]]
        self.before = tokens[-1]
        self.kept = self.kept[border:]
        self.last = [None] + [(t, s - border) if s >= border else None for t, s in self.last[border + 1:]]
        return tokens

    def finish(self) -> list[int]:
        """The rest of the tokens; the transducer is then as new."""
        tokens = self._emit(len(self.kept))
        self.before, self.kept, self.last = None, b"", [None]
        return tokens


class TextDecoder:
    """Bytes in, text out: a state machine over UTF-8 that holds at most three bytes of an unfinished character.

    A byte that cannot continue the character begun so far ends it; what was begun becomes one U+FFFD.
    """

    def __init__(self):
        self.begun = b""
        self.need = 0  # bytes still to come
        self.low, self.high = 0x80, 0xBF  # range of the next one

    def feed(self, data: bytes, final: bool = False) -> str:
        if not self.need:
            try:  # whole characters only: nothing to carry
                return data.decode("utf-8")
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        for b in data:
            if self.need:
                if self.low <= b <= self.high:
                    self.begun += bytes([b])
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(self.begun.decode("utf-8"))
                        self.begun = b""
                    continue
                out.append("�")
                self.begun, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.begun, self.need = bytes([b]), 1 + (b >= 0xE0) + (b >= 0xF0)
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
            else:
                out.append("�")
        if final and self.need:
            out.append("�")
            self.begun, self.need, self.low, self.high = b"", 0, 0x80, 0xBF
        return "".join(out)


class Words(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers; filled as words come up."""

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges = merges
        self.machine = Transducer(merges)
        self.older: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that have not been seen, in sorted order."""
        for word in sorted(words):  # code points are in the order of their bytes
            data = word.encode("utf-8")
            packed = self.older.get(word)
            if packed is None:
                tokens = self.machine.word(data)
                packed = struct.pack(f"<{len(tokens)}I", *tokens)
            if len(data) <= CHUNK:  # the table is for words that come again, not for whole texts without a space
                if len(self) >= KNOWN_WORDS:
                    self.older = dict(self)
                    self.clear()
                self[word] = packed

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            tokens = self.machine.word(word.encode("utf-8"))
            packed = np.array(tokens, dtype="<u4").tobytes()
        return packed


@lru_cache(maxsize=2)
def machine(path: str) -> tuple[MergeList, Words]:
    """Read once per worker process and reused by its tasks."""
    merges = MergeList(path)
    return merges, Words(merges)


def encode_text(text: str, path: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers. Strings of special tokens become their ids."""
    merges, words = machine(path)
    if merges.split_special is None or not any(s in text for s in merges.special):
        return b"".join(map(words.__getitem__, pre_tokens(text)))
    out = []
    for part in merges.split_special.split(text):
        if part in merges.special:
            out.append(np.array([merges.special[part]], dtype="<u4").tobytes())
        elif part:
            out.append(b"".join(map(words.__getitem__, pre_tokens(part))))
    return b"".join(out)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """As `encode_text` of each, with the unseen pre-tokens of a few MB of text taken in sorted order."""
    merges, words = machine(path)
    out: list[bytes] = []
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= PIECE_CHARS):
            size += len(texts[last])
            last += 1
        piece = texts[first:last]
        split = [None if merges.split_special and any(s in t for s in merges.special) else pre_tokens(t) for t in piece]
        words.learn({w for found in split if found for w in found if len(w) <= CHUNK}.difference(words))
        out += [encode_text(t, path) if found is None else b"".join(map(words.__getitem__, found)) for t, found in zip(piece, split)]
        first = last
    return out


def decode_ids(packed: bytes, path: str) -> str:
    """Text of ids, in runs of some thousand ids."""
    token = machine(path)[0].text_of
    decoder, out = TextDecoder(), []
    ids = np.frombuffer(packed, dtype="<u4")
    for i in range(0, len(ids), DECODED):
        out.append(decoder.feed(b"".join([token[t] for t in ids[i:i + DECODED].tolist()])))
    out.append(decoder.feed(b"", final=True))
    return "".join(out)


def _added(df: DataFrame, names: dict[str, str]) -> str:
    return ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} {t}" for n, t in names.items())])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and `ids`: binary, little-endian unsigned 32-bit integers. Empty and null texts have none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            packed = encode_texts([t or "" for t in column.to_pylist()], path)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], names=[*batch.schema.names, ids])

    docs = without(docs, ids)
    return docs.mapInArrow(task, _added(docs, {ids: "binary"}))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns and the text of `ids`."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [decode_ids(v.as_py() or b"", path) for v in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    df = without(df, text)
    return df.mapInArrow(task, _added(df, {text: "string"}))


def round_trip(docs: DataFrame, path: str, text: str = "text", rows: int = ROWS) -> DataFrame:
    """All columns and `ids`, `decoded`, in one pass over the table. Fewer `rows` at once take less memory and more time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i in range(0, batch.num_rows, rows):
                packed = encode_texts([t or "" for t in column.slice(i, rows).to_pylist()], path)
                texts = [decode_ids(p, path) for p in packed]
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(i, rows).columns, pa.array(packed, pa.binary()), pa.array(texts, pa.string())],
                    names=[*batch.schema.names, "ids", "decoded"])

    docs = without(docs, "ids", "decoded")
    return docs.mapInArrow(task, _added(docs, {"ids": "binary", "decoded": "string"}))


def digest(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", rows: int = ROWS) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each text, encoded and decoded as by `round_trip`."""
    both = round_trip(docs.select(F.col(key), F.col(text).alias("text")), path, rows=rows)
    return both.select(
        F.col(key),
        F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
