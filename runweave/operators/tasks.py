"""What tasks do: CPU time, wakeup latency, activations, membership of cgroups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.operators import sweep
from runweave.trace import RUN_KEYS, Trace, place, seconds

TASK = ("pid", "comm")
IDLE_TASKS = "swapper"


def switch_ins(trace: Trace) -> DataFrame:
    """Each time a task is given a CPU."""
    events = trace.event("sched_switch")
    return events.select(
        *place(events), "t_ns", "seq", "cpu", F.col("next_pid").alias("pid"), F.col("next_comm").alias("comm")
    )


def switch_intervals(trace: Trace) -> DataFrame:
    """Who runs on each CPU from when to when; ``prepared`` may hold it already written out."""
    if "switch_intervals" in trace.prepared:
        return trace.prepared["switch_intervals"]
    return trace.spans(switch_ins(trace), ["cpu"])


def task_cpu_ns(trace: Trace) -> DataFrame:
    """CPU time in ns per task and CPU."""
    if "timeline" in trace.prepared:
        return sweep.task_cpu_ns(trace)
    return switch_intervals(trace).groupBy(*RUN_KEYS, *TASK, "cpu").agg(
        F.sum(F.col("t_end_ns") - F.col("t_ns")).alias("ns")
    )


def residency_columns(trace: Trace) -> list[Column]:
    """Aggregates of (``cpu``, ``ns``) rows: seconds per CPU, per cluster and ``Total``."""
    cpus = {f"cpu{cpu}": [cpu] for cpu in trace.options.cpus}
    groups = cpus | {cluster: list(members) for cluster, members in trace.options.clusters.items()}
    sums = {name: f"cpu in ({', '.join(map(str, members))})" for name, members in groups.items()}
    columns = [
        F.expr(f"cast(coalesce(sum(ns) filter (where {which}), 0) as double) / 1e9D as `{name}`")
        for name, which in sums.items()
    ]
    return [*columns, F.expr("cast(sum(ns) as double) / 1e9D as Total")]


def task_names(trace: Trace) -> DataFrame:
    """Distinct (pid, comm) seen as switched in or out, or renamed to."""
    switches = trace.event("sched_switch")
    seen = switches.select(*RUN_KEYS, F.col("next_pid").alias("pid"), F.col("next_comm").alias("comm"))
    if "prev_pid" in switches.columns:
        seen = seen.unionByName(
            switches.select(*RUN_KEYS, F.col("prev_pid").alias("pid"), F.col("prev_comm").alias("comm"))
        )
    if trace.has("task_rename"):
        seen = seen.unionByName(
            trace.event("task_rename").select(*RUN_KEYS, "pid", F.col("newcomm").alias("comm"))
        )
    return seen.filter("pid is not null and comm is not null").distinct()


def names_by_pid(trace: Trace) -> DataFrame:
    """All names of a pid as one text, in order of the alphabet."""
    return task_names(trace).groupBy(*RUN_KEYS, "pid").agg(
        F.array_join(F.array_sort(F.collect_set("comm")), " ").alias("task")
    )


def only_important(trace: Trace, df: DataFrame) -> DataFrame:
    """Rows of the tasks listed for the workload of their run."""
    lists = trace.options.important_tasks
    wanted = F.lit(False)
    for label, comms in lists.items():
        wanted = wanted | ((F.col("label") == label) & F.col("comm").isin(list(comms)))
    # The names of all lists first: unlike the look at the label, this reaches the scan.
    listed = df.filter(F.col("comm").isin(sorted({c for comms in lists.values() for c in comms})))
    return trace.with_run(listed, "label").filter(wanted).drop("label")


Keep = Callable[[Trace, DataFrame], DataFrame]


def all_tasks(trace: Trace, df: DataFrame) -> DataFrame:
    return df


def wakeup_latency(trace: Trace, keep: Keep = all_tasks) -> DataFrame:
    """Time from each wakeup of a task to its next switch-in, for the tasks that ``keep`` leaves.

    Wakeups and switch-ins of a pid are put in one order; a wakeup counts when the next row is a
    switch-in, so of several wakeups only the last does, and one that is never followed gives no row.
    """
    wakeups = trace.event("sched_wakeup")
    if trace.has("sched_wakeup_new"):
        wakeups = wakeups.unionByName(trace.event("sched_wakeup_new"), allowMissingColumns=True)
    woken = keep(trace, wakeups).select(
        *place(wakeups), "t_ns", "seq", F.lit(0).alias("kind"), "pid", "comm", F.col("target_cpu").alias("cpu")
    )
    ran = keep(trace, switch_ins(trace)).select(
        *place(wakeups), "t_ns", "seq", F.lit(1).alias("kind"), "pid", F.lit(None).cast("string").alias("comm"), "cpu"
    )
    rows = trace.follow(
        woken.unionByName(ran), ["pid"], ["t_ns", "kind", "seq"], ahead={"then": F.struct("t_ns", "kind", "cpu")}
    )
    latency = F.col("then.t_ns") - F.col("t_ns")
    return rows.filter("kind = 0 and then.kind = 1").select(
        *RUN_KEYS, "t_ns", *TASK,
        latency.alias("latency_ns"), seconds(latency).alias("wakeup_latency"),
        F.col("then.cpu").alias("cpu"), F.col("cpu").alias("target_cpu"),
    )


def mean_latency() -> Column:
    """Mean latency in s from the whole ns, so the result does not depend on the order of the rows."""
    return (seconds(F.sum("latency_ns")) / F.count("latency_ns")).alias("wakeup_latency")


def activations(trace: Trace, keep: Keep = all_tasks) -> DataFrame:
    """Alternating rows of a task: ``active`` 1 while it runs, 0 while it waits for its next run.

    ``duration`` is the length of the row; ``duty_cycle`` of a run is its share of the time up to
    the task's next run and is null for the last one. The last wait lasts to the end of the
    iteration. A wait of no length gives no row.
    """
    intervals = keep(trace, switch_intervals(trace))
    if "switch_intervals" not in trace.prepared:
        intervals = trace.staged(intervals)
    runs = trace.follow(intervals, ["pid"], ahead={"next_ns": "t_ns"})
    runs = trace.with_window(runs, "end_ns")
    active = F.col("t_end_ns") - F.col("t_ns")
    waits_to = F.coalesce("next_ns", "end_ns")
    rows = F.array(
        F.struct(
            F.col("t_ns").alias("t_ns"), F.lit(1.0).alias("active"), active.alias("ns"),
            F.try_divide(active.cast("double"), (F.col("next_ns") - F.col("t_ns")).cast("double")).alias("duty_cycle"),
        ),
        F.struct(
            F.col("t_end_ns").alias("t_ns"), F.lit(0.0).alias("active"), (waits_to - F.col("t_end_ns")).alias("ns"),
            F.lit(None).cast("double").alias("duty_cycle"),
        ),
    )
    return runs.select(*RUN_KEYS, *TASK, "cpu", F.explode(rows).alias("row")).filter(
        "row.active = 1 or row.ns > 0"
    ).select(
        *RUN_KEYS, *TASK, "cpu", "row.t_ns", "row.active", seconds("row.ns").alias("duration"), "row.duty_cycle"
    )


def cgroup_members(trace: Trace) -> DataFrame:
    """Tasks ever attached to one of the cgroups of the settings."""
    path_of = F.expr("substring(dst_path, 2)")
    wanted = [f"/{cgroup}" for cgroup in trace.options.cgroups]
    return trace.event("cgroup_attach_task").filter(F.col("dst_path").isin(wanted)).select(
        *RUN_KEYS, path_of.alias("cgroup"), *TASK
    ).distinct()


def only_members(trace: Trace, df: DataFrame) -> DataFrame:
    """Rows of pids that were ever attached to one of the cgroups, whatever their name was then."""
    return df.join(cgroup_members(trace).select(*RUN_KEYS, "pid").distinct(), [*RUN_KEYS, "pid"], "left_semi")


def by_cgroup(trace: Trace, df: DataFrame) -> DataFrame:
    """Rows of tasks of a cgroup, once for each cgroup the task was ever attached to.

    The cgroups of a task are folded into one row first, so the join matches a busy task's many
    rows with a single one.
    """
    member_of = cgroup_members(trace).groupBy(*RUN_KEYS, *TASK).agg(F.collect_set("cgroup").alias("cgroups"))
    joined = df.join(member_of, [*RUN_KEYS, *TASK])
    return joined.withColumn("cgroup", F.explode("cgroups")).drop("cgroups")
