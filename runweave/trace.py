"""The trace model: one table per event of all runs, and the windows of the iterations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.config import Options
from runweave.errors import MissingEvent
from runweave.operators.ordered import GRID, SKETCH, follow, kept_once, sketch_quantiles, staged, with_slice

RUN_KEYS = ("wa_path", "iteration")
NS = 1_000_000_000
SLICE = "time_slice"
PLACED = (*RUN_KEYS, SLICE)
WINDOW = ("min(t_ns) as start_ns", "max(t_ns) as end_ns", "count(t_ns) as events")

_SLICES: dict[tuple, DataFrame] = {}  # tables of slices already written, by application, origin and size

# A (run, iteration) row of the window table is under 100 bytes: this many stay far below the
# 8 GB a broadcast may hold, and at a size every executor can keep.
MAX_BROADCAST_ITERATIONS = 500_000


class Tables(Mapping[str, DataFrame]):
    """Event tables by name, each planned only when it is asked for."""

    def __init__(self, makers: Mapping[str, Callable[[], DataFrame]]):
        self._makers = dict(makers)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass(frozen=True)
class Trace:
    """Event tables keyed by ``wa_path, iteration`` with ``t_ns`` and the file order ``seq``.

    ``runs`` has a row per run (``wa_path, kernel, label, tag, run_order``) and is made from the
    list of runs the driver was given. ``iterations`` is an upper bound of the number of
    (run, iteration) pairs, when it is known. ``clock`` may name a cheaper table that covers the
    times of all events. ``prepared`` holds shared steps already written out. Traces of one ``origin``, which
    stands for data that does not change, share their table of slices.
    """

    spark: SparkSession
    tables: Mapping[str, DataFrame]
    runs: DataFrame
    options: Options = field(default_factory=Options)
    iterations: int | None = None
    clock: DataFrame | None = None
    origin: str | None = None
    prepared: Mapping[str, DataFrame] = field(default_factory=dict)

    def event(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise MissingEvent(f"no run has the event {name}")
        return self.tables[name]

    def has(self, name: str) -> bool:
        return name in self.tables

    def _times(self) -> DataFrame:
        if self.clock is not None:
            return self.clock.select(*RUN_KEYS, "t_ns")
        tables = [t for t in self.tables.values() if "t_ns" in t.columns]
        times = tables[0].select(*RUN_KEYS, "t_ns")
        for table in tables[1:]:
            times = times.unionByName(table.select(*RUN_KEYS, "t_ns"))
        return times

    @cached_property
    def windows(self) -> DataFrame:
        """First and last time of each iteration over all of its events, and how many there are."""
        for kept in ("windows", "slices"):
            if kept in self.prepared:
                return self.prepared[kept].select(*RUN_KEYS, "start_ns", "end_ns", "events")
        known = self._known_slices()
        return known.drop("borders") if known is not None else self._times().groupBy(*RUN_KEYS).agg(*map(F.expr, WINDOW))

    def _slices_key(self) -> tuple | None:
        return self.origin and (self.spark.sparkContext.applicationId, self.origin, self.options.rows_per_slice)

    def _known_slices(self) -> DataFrame | None:
        if "slices" in self.prepared:
            return self.prepared["slices"]
        return _SLICES.get(self._slices_key())

    @cached_property
    def slices(self) -> DataFrame:
        """Windows with the ``borders`` of the iteration's time slices; a slice lasts from its border to the next.

        Borders are quantiles of the times of all events, so slices have about ``rows_per_slice`` rows wherever
        in the iteration these are. They come from a mergeable sketch, whose answers may differ between two
        runs of one plan: so they are written once, and all ordered steps of the trace read them.
        """
        known = self._known_slices()
        if known is not None:
            return known
        sketch = F.expr(f"kll_sketch_agg_bigint(t_ns, {SKETCH})").alias("sketch")
        told = self._times().groupBy(*RUN_KEYS).agg(*map(F.expr, WINDOW), sketch)
        pieces = F.least(F.lit(GRID), F.ceil(F.col("events") / F.lit(self.options.rows_per_slice))).cast("int")
        places = F.sequence(F.lit(1), F.col("pieces") - 1)
        # the times are bound by a lambda of their own: named in the inner one, they would be asked of the sketch once for each place
        chosen = F.get(F.transform(F.array("times"), lambda times: F.transform(places, lambda i: F.get(times, F.floor(i * GRID / F.col("pieces")).cast("int") - 1))), F.lit(0))
        times = F.when(F.col("pieces") > 1, F.expr(sketch_quantiles("sketch")))
        cut = told.withColumn("pieces", pieces).withColumn("times", times)
        # many rows of one instant stay in one slice: their border is named once
        borders = F.when(F.col("pieces") > 1, F.array_distinct(chosen)).otherwise(F.array().cast("array<bigint>"))
        made = kept_once(cut.select(*RUN_KEYS, "start_ns", "end_ns", "events", borders.alias("borders")))
        if self.origin:
            _SLICES[self._slices_key()] = made
        return made

    def _small(self, windows: DataFrame) -> DataFrame:
        few = self.iterations is not None and self.iterations <= MAX_BROADCAST_ITERATIONS
        return F.broadcast(windows) if few else windows

    def with_window(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with the window of its iteration (``start_ns``, ``end_ns`` unless others are named)."""
        windows = self.windows.select(*RUN_KEYS, *(columns or ("start_ns", "end_ns")))
        return df.join(self._small(windows), list(RUN_KEYS), "left")

    def with_run(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with columns of the run (the kernel unless others are named)."""
        return df.join(F.broadcast(self.runs.select("wa_path", *(columns or ("kernel",)))), "wa_path", "left")

    def follow(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t_ns", "seq"), time: str = "t_ns", **asks
    ) -> DataFrame:
        """``operators.ordered.follow`` per iteration and ``keys``, in time slices unless the options say otherwise."""
        group = [*RUN_KEYS, *keys]
        if not self.options.sliced:
            return follow(df, group, order, **asks)
        if SLICE in df.columns:  # a store's table, dealt out by run, iteration and slice
            return follow(df, group, order, slice_col=SLICE, placed=PLACED, **asks)
        return follow(self.cut(df, time), group, order, slice_col=SLICE, **asks).drop(SLICE)

    def cut(self, df: DataFrame, time: str = "t_ns", *columns: str) -> DataFrame:
        """``df`` with the time slice of each row, and columns of its window."""
        borders = self.slices.select(*RUN_KEYS, "borders", *columns)
        return with_slice(df.join(self._small(borders), list(RUN_KEYS), "left"), SLICE, "borders", time).drop("borders")

    def staged(self, df: DataFrame) -> DataFrame:
        """An ordered step that another ordered step builds on: kept once where a checkpoint folder is named."""
        return staged(df) if self.options.sliced and SLICE not in df.columns else df

    def spans(
        self, df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("t_ns", "seq"), **asks
    ) -> DataFrame:
        """Rows as intervals: each lasts to the next row of its key, the last one to the end of its iteration."""
        look = {"ahead": {"_next": "t_ns"}, **asks}
        if self.options.sliced and SLICE not in df.columns:
            after = follow(self.cut(df, "t_ns", "end_ns"), [*RUN_KEYS, *keys], order, slice_col=SLICE, **look).drop(SLICE)
        else:
            after = self.with_window(self.follow(df, keys, order, **look), "end_ns")
        return after.withColumn("t_end_ns", F.coalesce("_next", "end_ns")).drop("_next", "end_ns")


def place(df: DataFrame) -> list[str]:
    """The keys of a trace's rows, with the slice where a store has it."""
    return [*RUN_KEYS, *([SLICE] if SLICE in df.columns else [])]


def seconds(ns: str | Column) -> Column:
    """Seconds as a double; ``ns`` is a column or the text of an expression."""
    if isinstance(ns, str):
        return F.expr(f"cast({ns} as double) / 1e9D")
    return ns.cast("double") / F.lit(float(NS))
