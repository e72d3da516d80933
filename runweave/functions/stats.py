"""Statistics as aggregate column expressions, by name."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Statistic = Callable[[Column], Column]
MOST_VALUES = 1_000_000  # of one group that a Python function of whole groups is given
MOST_GROUPS = 10_000     # whose states a task holds at once


def gmean(v: Column) -> Column:
    """Geometric mean: 0 when any value is 0, null when any is negative or none is there."""
    positive = F.exp(F.avg(F.when(v > 0, F.ln(v))))
    return F.when(F.min(v) < 0, None).when(F.min(v) == F.max(v), F.min(v)).when(F.min(v) == 0, 0.0).otherwise(positive)


def sem(v: Column) -> Column:
    return F.stddev_samp(v) / F.sqrt(F.count(v))


STATISTICS: dict[str, Statistic] = {"gmean": gmean, "std": F.stddev_samp, "sem": sem}


def statistics(value: str, stats: dict[str, Statistic] | None = None) -> list[Column]:
    """Named aggregates of a column; own statistics are functions of a column to an aggregate."""
    v = F.col(value).cast("double")
    return [make(v).alias(name) for name, make in (stats or STATISTICS).items()]


@dataclass(frozen=True)
class Whole:
    """A Python function of all values of a group (a numpy array of doubles, without nulls) to a number.

    A group is in one task's memory, so one with more than ``MOST_VALUES`` values is an error: give a ``Mergeable`` then.
    """

    of: Callable[[np.ndarray], float | None]


@dataclass(frozen=True)
class Mergeable:
    """A Python aggregate that is fed in batches and merged, for groups of any size.

    ``start()`` gives a state, ``add(state, values)`` and ``merge(state, state)`` return the new one, ``finish(state)`` the number.
    States are pickled and should be small: a group has one per task that saw it.
    """

    start: Callable[[], Any]
    add: Callable[[Any, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


def split_statistics(stats: Mapping[str, Any] | None) -> tuple[dict[str, Statistic], dict[str, Whole | Mergeable]]:
    """Aggregates of columns, and those in Python: what does not make a column of a column is a function of values."""
    columns, python = {}, {}
    for name, make in (stats or {}).items():
        if not isinstance(make, (Whole, Mergeable)):
            try:
                is_column = isinstance(make(F.col("value")), Column)
            except Exception:  # a function of numbers may fail in any way when it is given a column
                is_column = False
            if is_column:
                columns[name] = make
                continue
            make = Whole(make)
        python[name] = make
    return columns, python


def python_statistics(df: DataFrame, keys: Sequence[str], value: str, stats: Mapping[str, Whole | Mergeable]) -> DataFrame:
    """``keys`` and a double per statistic, of the values of each group that are not null.

    Mergeable statistics are taken in each task first and their states are shuffled, as with built-in ones; values are
    shuffled only for functions of whole groups. Groups of null keys are groups.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_value"))
    folded = {n: s for n, s in stats.items() if isinstance(s, Mergeable)}
    whole = {n: s for n, s in stats.items() if isinstance(s, Whole)}
    parts = [p for p in (_folded(rows, keys, folded) if folded else None, _of_whole(rows, keys, whole) if whole else None) if p is not None]
    if len(parts) == 1:
        return parts[0]
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys] or [F.lit(True)]
    return parts[0].alias("a").join(parts[1].alias("b"), same).select("a.*", *[F.col(f"b.{n}") for n in whole])


def _result(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> str:
    typed = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys]
    return ", ".join([*typed, *[f"`{n}` double" for n in names]])


def _of_whole(rows: DataFrame, keys: Sequence[str], stats: Mapping[str, Whole]) -> DataFrame:
    names = list(stats)

    def task(key: tuple, table: pa.Table) -> pa.Table:
        if table.num_rows > MOST_VALUES:
            raise ValueError(f"{table.num_rows} values of {[k.as_py() for k in key]}: more than {MOST_VALUES} need a Mergeable")
        values = table["_value"].drop_null().to_numpy()
        made = [stats[n].of(values) if len(values) else None for n in names]
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], *[pa.array([m], pa.float64()) for m in made]], names=[*keys, *names])

    return rows.groupBy(*keys).applyInArrow(task, _result(rows, keys, names))


def _folded(rows: DataFrame, keys: Sequence[str], stats: Mapping[str, Mergeable]) -> DataFrame:
    names = list(stats)

    def told(states: dict, types: list) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in states], t) for i, t in enumerate(types)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [*keys, "_state"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}
        types: list = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            table = pa.table({**{k: batch.column(i) for i, k in enumerate(keys)}, "v": batch.column(len(keys))})
            grouped = table.group_by(list(keys)).aggregate([("v", "list")]) if keys else None
            groups = zip(*[grouped[k].to_pylist() for k in keys]) if keys else [()]
            lists = grouped["v_list"].combine_chunks() if keys else None
            for i, key in enumerate(groups):
                values = (lists[i].values if keys else table["v"].combine_chunks()).drop_null().to_numpy(zero_copy_only=False)
                state = states.get(key) or [stats[n].start() for n in names]
                states[key] = [stats[n].add(s, values) if len(values) else s for n, s in zip(names, state)]
            if len(states) >= MOST_GROUPS:
                yield told(states, types)
                states = {}
        if states:
            yield told(states, types)

    def unite(key: tuple, table: pa.Table) -> pa.Table:
        states = [stats[n].start() for n in names]
        for packed in table["_state"]:
            states = [stats[n].merge(a, b) for n, a, b in zip(names, states, pickle.loads(packed.as_py()))]
        made = [stats[n].finish(s) for n, s in zip(names, states)]
        return pa.table([*[pa.array([k.as_py()], k.type) for k in key], *[pa.array([m], pa.float64()) for m in made]], names=[*keys, *names])

    typed = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys]
    states = rows.mapInArrow(fold, ", ".join([*typed, "_state binary"]))
    return states.groupBy(*keys).applyInArrow(unite, _result(rows, keys, names))
