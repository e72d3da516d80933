"""Checks of what was read: what is missing, and whether times are in order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.config import Options
from runweave.operators.ordered import cut_by, follow
from runweave.operators.tasks import task_names
from runweave.sources.scan import Runs, scan_event
from runweave.sources.schema import EVENT_FIELDS, EXPECTED_EVENTS
from runweave.trace import RUN_KEYS, Trace


def missing_events(iterations: DataFrame, found: DataFrame, expected: Sequence[str] = EXPECTED_EVENTS) -> DataFrame:
    """Events that iterations should have and do not; ``found`` has ``wa_path, iteration, event``."""
    wanted = iterations.select(*RUN_KEYS, F.explode(F.array(*[F.lit(e) for e in expected])).alias("event"))
    return wanted.join(found.select(*RUN_KEYS, "event").distinct(), [*RUN_KEYS, "event"], "left_anti")


def missing_iterations(iterations: DataFrame, dataset: DataFrame) -> DataFrame:
    """Iterations that gave no row of a dataset."""
    return iterations.select(*RUN_KEYS).join(dataset.select(*RUN_KEYS).distinct(), list(RUN_KEYS), "left_anti")


def unread_files(runs: Runs, trace: Trace) -> DataFrame:
    """Event files that gave no row: they could not be read, or hold none."""
    listed = runs.files.filter("event is not null").filter(F.col("event").isin(list(EVENT_FIELDS)))
    events = [e for e in EVENT_FIELDS if trace.has(e)]
    # The listing and the scan write a path differently (file:/ and file:///), so files are told by their keys.
    read = reduce(DataFrame.unionByName, [
        scan_event(trace.spark, runs, e, skip_unreadable=True).select(*RUN_KEYS, F.lit(e).alias("event")).distinct() for e in events
    ])
    return listed.join(read, [*RUN_KEYS, "event"], "left_anti")


def missing_tasks(trace: Trace) -> DataFrame:
    """Tasks of a workload's list that an iteration of it never ran."""
    listed = F.lit(None).cast("array<string>")
    for label, comms in trace.options.important_tasks.items():
        listed = F.when(F.col("label") == label, F.array(*[F.lit(c) for c in comms])).otherwise(listed)
    wanted = trace.with_run(trace.windows.select(*RUN_KEYS), "label").select(*RUN_KEYS, F.explode(listed).alias("comm"))
    seen = task_names(trace).select(*RUN_KEYS, "comm").distinct()
    return wanted.join(seen, [*RUN_KEYS, "comm"], "left_anti")


def time_checks(df: DataFrame, options: Options | None = None) -> DataFrame:
    """Per iteration: first and last time, rows without a time, rows earlier than the row before them."""
    options = options or Options()
    cut, part = cut_by(df, F.floor(F.col("seq") / options.rows_per_slice))
    rows = follow(cut, RUN_KEYS, ["seq"], slice_col=part, behind={"was_ns": "t_ns"})
    return rows.groupBy(*RUN_KEYS).agg(
        F.min("t_ns").alias("start_ns"), F.max("t_ns").alias("end_ns"),
        F.count_if(F.col("t_ns").isNull()).alias("without_time"),
        F.count_if(F.col("t_ns") < F.col("was_ns")).alias("out_of_order"),
    )
