"""License scans by template markup: optional and replaceable regions compiled into token automata.

**Markup.** A template is wording with two kinds of marks: `[[ ... ]]` may be left out (and may be nested), and `{{name:2-8}}`
stands for any two to eight words. Everything else is mandatory and has to stand in the text word for word, in order.
Words are what is left after lower-casing A-Z and dropping punctuation, so layout and commas do not matter.

**Automata.** Each template becomes a nondeterministic automaton over word hashes, which is made deterministic state by
state as texts reach it. A text is accepted from a word on if some end state is reached; the longest match counts.
Automata start only where a template's first two words stand; that is looked up for all words of a piece at once. The four
base phrases are templates without marks and run in the same way.

**Scale.** One pass over whole texts, no shuffle; what a task holds is a few MB of text and the automata.

**Cases.** Null and empty texts have no words and no labels. Copies, ties and repeated rows are judged one by one. Other
columns are passed on; `n_words` and `matches` take the place of columns of those names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.llm import textbytes as tb
from runweave.llm.columns import without

#: fixed values: names of licenses
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: fixed values: wording of public licenses and of the notices that name them
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license [[version]] 2.0"),
    ("apache-2.0", "[[licensed under the apache license version 2.0 the license]] you may not use this {{file:1-3}} except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the [[terms of the]] mit license"),
    ("mit", "licensed under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this {{software:1-3}} and associated documentation files the {{software:1-3}} to deal in the {{software:1-3}} without restriction"),
    ("mit", "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the {{software:1-3}}"),
    ("gpl-3.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 3 [[only]] [[or later]]"),
    ("gpl-2.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] version 2 [[only]] [[or later]]"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability [[or]] fitness for a particular purpose"),
    ("lgpl", "gnu [[lesser]] [[library]] general public license [[version]] 2.1"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] cc by 4.0 [[international]] [[license]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] cc by sa 4.0 [[international]] [[license]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc 4.0 [[international]] [[license]]"),
    ("cc-by-nd-4.0", "licensed under [[a]] [[the]] cc by nd 4.0 [[international]] [[license]]"),
    ("cc-by-nc-sa-4.0", "licensed under [[a]] [[the]] cc by nc sa 4.0 [[international]] [[license]]"),
    ("cc-by-nc-nd-4.0", "licensed under [[a]] [[the]] cc by nc nd 4.0 [[international]] [[license]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] creative commons attribution 4.0 international [[public]] license"),
    ("cc0-1.0", "creative commons zero [[v]] 1.0 universal"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3-clause", "neither the name of {{holder:1-8}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile(r"\[\[|\]\]|\{\{[^{}:]*:(\d+)-(\d+)\}\}|[^\[\]{}\s]+")
MATCHES = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("words", pa.int64())]))
MATCHES_TYPE = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("template", T.IntegerType()),
    T.StructField("start", T.LongType()), T.StructField("words", T.LongType())]))
KNOWN_SETS = 50_000


def parsed(template: str) -> list:
    """Words, (least, most) of replaceable regions, and lists for optional ones."""
    stack: list[list] = [[]]
    for m in MARK.finditer(template):
        if m[0] == "[[":
            stack.append([])
        elif m[0] == "]]":
            inner = stack.pop()
            stack[-1].append(inner)
        elif m[0].startswith("{{"):
            stack[-1].append((int(m[1]), int(m[2])))
        else:
            stack[-1].extend(WORD.findall(m[0].lower()))
    if len(stack) != 1:
        raise ValueError(f"optional region not closed: {template}")
    return stack[0]


def word_hashes(words: list[str]) -> np.ndarray:
    data, borders = tb.packed(pa.array(words, pa.string()))
    return tb.span_hashes(data, borders[:-1], borders[1:])


class Automaton:
    """States 0 to end; `on` by word, `free` by any word, `skip` without one."""

    def __init__(self, items: list):
        self.on: list[dict[str, int]] = [{}]
        self.free: list[int | None] = [None]
        self.skip: list[set[int]] = [set()]
        self.end = self._add(items, 0)
        self.words = {w for step in self.on for w in step}
        self.known: dict[tuple[frozenset, int], frozenset] = {}
        self.hashes: list[dict[int, int]] = []

    def _state(self) -> int:
        self.on.append({})
        self.free.append(None)
        self.skip.append(set())
        return len(self.on) - 1

    def _add(self, items: list, at: int) -> int:
        for item in items:
            if isinstance(item, str):
                to = self._state()
                self.on[at][item] = to
            elif isinstance(item, tuple):
                to, leave = at, []
                for k in range(item[1]):
                    if k >= item[0]:
                        leave.append(to)
                    self.free[to] = step = self._state()
                    to = step
                for s in leave:
                    self.skip[s].add(to)
            else:
                # a state of its own before and behind, so that words of one region are not taken for another's
                inner, to = self._state(), self._state()
                self.skip[at] |= {inner, to}
                self.skip[self._add(item, inner)].add(to)
            after = self._state()
            self.skip[to].add(after)
            at = after
        return at

    def closed(self, states: set[int]) -> frozenset:
        out, todo = set(states), list(states)
        while todo:
            for s in self.skip[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return frozenset(out)

    def first_words(self, states: frozenset) -> set[str]:
        if any(self.free[s] is not None for s in states):
            raise ValueError("a template has to begin with two words")
        return {w for s in states for w in self.on[s]}

    def hashed(self, number: dict[str, int]) -> None:
        self.hashes = [{number[w]: to for w, to in step.items()} for step in self.on]
        self.begin = self.closed({0})

    def after(self, states: frozenset, word: int) -> frozenset:
        key = (states, word)
        found = self.known.get(key)
        if found is None:
            if len(self.known) > KNOWN_SETS:
                self.known.clear()
            to = {self.hashes[s][word] for s in states if word in self.hashes[s]}
            to |= {self.free[s] for s in states if self.free[s] is not None}
            found = self.known[key] = self.closed(to)
        return found

    def longest(self, numbers: list[int]) -> int:
        """Words of the longest match at the beginning; 0 for none."""
        states, best = self.begin, 0
        for n, word in enumerate(numbers, 1):
            states = self.after(states, word)
            if not states:
                break
            if self.end in states:
                best = n
        return best


class Scanner:
    """All templates: numbers of their words, where they can begin, their automata."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        self.automata = [Automaton(parsed(text)) for _, text in templates]
        words = sorted(set().union(*(a.words for a in self.automata)))
        hashes = word_hashes(words)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {words[j]: i for i, j in enumerate(order.tolist())}
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.starts: dict[int, list[int]] = {}
        n = len(words)
        for i, a in enumerate(self.automata):
            a.hashed(number)
            for one in a.first_words(a.begin):
                for two in a.first_words(a.after(a.begin, number[one])):
                    self.starts.setdefault(number[one] * n + number[two], []).append(i)
        self.opening = np.zeros(n * n, dtype=bool)
        self.opening[list(self.starts)] = True
        self.reach = max(len(a.on) for a in self.automata)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        at = np.flatnonzero(self.sieve[(hashes & np.uint64(len(self.sieve) - 1)).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        known = self.hashes[found] == hashes[at]
        out[at[known]] = found[known]
        return out

    def scan(self, hashes: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, template, first word in the text, words) of all matches."""
        numbers = self.numbers(hashes)
        n = len(self.hashes)
        at = np.flatnonzero((numbers[:-1] >= 0) & (numbers[1:] >= 0))
        at = at[self.opening[numbers[at] * n + numbers[at + 1]]]
        text = np.searchsorted(firsts, at, side="right") - 1
        for i, t in zip(at.tolist(), text.tolist()):
            last = int(firsts[t + 1])
            if i + 1 >= last:
                continue
            words = numbers[i:min(last, i + self.reach)].tolist()
            for k in self.starts[words[0] * n + words[1]]:
                if size := self.automata[k].longest(words):
                    yield t, k, i - int(firsts[t]), size


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner([*((label, phrase) for phrase, label in BASE.items()), *TEMPLATES])


def scanned(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (default all), `n_words`, and `matches`: label, template (the first ones are BASE), start, words."""
    keep = without(docs, "n_words", "matches").columns if keep is None else keep
    names = [*keep, "n_words", "matches"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner()
        for batch, data, borders in tb.pieces(batches, text):
            data = tb.LOWER[data]
            starts, ends, firsts = tb.words(data, borders, tb.ALNUM)
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            if len(starts):
                for t, k, start, size in machine.scan(tb.span_hashes(data, starts, ends), firsts):
                    found[t].append({"label": machine.labels[k], "template": k, "start": start, "words": size})
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(np.diff(firsts), pa.int64()), pa.array(found, MATCHES)], names=names)

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("matches", MATCHES_TYPE)])
    return docs.mapInArrow(task, schema)


def digest(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: 1 if a template's wording is there, 0.5 if only a license's name is, else 0.
    """
    found = scanned(docs.select(key, "text"), keep=[key])
    base = F.filter("matches", lambda m: m["template"] < len(BASE))
    joined = lambda of: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))))
    starts = F.transform(base, lambda m: m["start"])
    return found.select(
        key, "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined("matches").alias("labels"),
        F.when(F.size(base) < F.size("matches"), 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"))
