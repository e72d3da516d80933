"""The metrics of a trace: each metric gives one or more named datasets.

A dataset is a function from a trace to a DataFrame. All runs and iterations are computed at once;
``kernel`` and the other columns of a run are joined from the manifest at the end.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.errors import EmptyMetric, RunweaveError
from runweave.functions.text import UNKNOWN
from runweave.operators import cpus, samples, tasks
from runweave.sources.sink import read_table, write_dataset, write_table
from runweave.trace import RUN_KEYS, Trace, seconds

log = logging.getLogger(__name__)

TAGS = ("wa_path", "kernel", "iteration")


def _timed(trace: Trace, df: DataFrame, *columns: str) -> DataFrame:
    """Tagged rows with ``Time`` in seconds in place of the internal time and order."""
    return trace.with_run(df).select(*TAGS, seconds("t_ns").alias("Time"), *columns)


def _tagged(trace: Trace, df: DataFrame, *columns: str) -> DataFrame:
    return trace.with_run(df).select(*TAGS, *columns)


def pixel6_emeter(trace):
    return _timed(trace, samples.power_samples(trace), "channel", "power")


def pixel6_emeter_mean(trace):
    means = samples.power_samples(trace).groupBy(*RUN_KEYS, "channel").agg(F.avg("power").alias("power"))
    return _tagged(trace, means, "channel", "power")


def cpu_idle(trace):
    return _timed(trace, cpus.idle_events(trace), "cpu", "state", "cluster")


def idle_residency(trace):
    return _tagged(trace, cpus.cluster_idle_residency(trace), "cluster", "idle_state", "time")


def _idle_miss(trace):
    cluster = trace.options.cluster_of("cpu_id").alias("cluster")
    return trace.event("cpu_idle_miss").select(*RUN_KEYS, "t_ns", "cpu_id", "below", cluster)


def cpu_idle_miss(trace):
    return _timed(trace, _idle_miss(trace), "cpu_id", "below", "cluster")


def cpu_idle_miss_counts(trace):
    counts = _idle_miss(trace).groupBy(*RUN_KEYS, "cluster", "below").agg(F.count(F.lit(1)).alias("count"))
    return _tagged(trace, counts, "cluster", "below", "count")


def freqs(trace):
    return _timed(trace, cpus.frequency_events(trace), "frequency", "cluster", "cpu")


def freqs_mean(trace):
    means = cpus.domain_frequency_events(trace).groupBy(*RUN_KEYS, "cluster").agg(
        (F.avg("frequency") / 1000).alias("frequency")
    )
    return _tagged(trace, means, "cluster", "frequency")


def freqs_residency(trace):
    return _tagged(trace, cpus.frequency_residency(trace), "cluster", "frequency", "total_time", "active_time")


def overutilized(trace):
    return _tagged(trace, cpus.overutilized_time(trace), "time", "total_time", "percentage")


def overutilized_mean(trace):
    means = cpus.overutilized_time(trace).groupBy("wa_path").agg(
        *[F.round(F.avg(c), 2).alias(c) for c in ("time", "total_time", "percentage")]
    )
    return means.select(F.lit("overutilized").alias("metric"), "wa_path", "time", "total_time", "percentage")


def sched_pelt_cfs(trace):
    return _timed(trace, samples.load_signals(trace), "cpu", "path", "load", "util", "cluster")


def sched_pelt_cfs_root(trace):
    return sched_pelt_cfs(trace).filter(F.col("path") == "/")


def sched_pelt_cfs_mean(trace):
    root = samples.load_signals(trace).filter(F.col("path") == "/")
    means = root.groupBy(*RUN_KEYS, "cluster").agg(F.avg("load").alias("load"), F.avg("util").alias("util"))
    return _tagged(trace, means, "cluster", "load", "util")


def capacity(trace):
    events = trace.event("sched_cpu_capacity").select(*RUN_KEYS, "t_ns", "cpu", "capacity")
    return _timed(trace, samples.relative_time(trace, events), "cpu", "capacity", "time_it")


def uclamp_updates(trace):
    """Clamp updates with the names of the pid, looked up among all tasks of the iteration."""
    updates = trace.event("uclamp_update_tsk").select(*RUN_KEYS, "t_ns", "pid", "uclamp_id", "value")
    named = updates.join(tasks.names_by_pid(trace), [*RUN_KEYS, "pid"], "left").withColumn(
        "task", F.coalesce("task", F.lit(UNKNOWN))
    )
    return _timed(trace, samples.relative_time(trace, named), "pid", "uclamp_id", "value", "task", "time_it")


def adpf(trace):
    reports = trace.event("adpf")
    values = [f"`{c}`" for c in reports.columns if c not in RUN_KEYS and c not in ("seq", "t_ns")]
    return _tagged(trace, reports, *values)


def adpf_totals(trace):
    totals = trace.event("adpf").groupBy(*RUN_KEYS).agg(
        F.avg("average fps").alias("average fps"), F.max_by("# frame count", "time").alias("frame count")
    )
    return trace.with_run(totals).select("average fps", "frame count", "iteration", "kernel", "wa_path")


def thermal(trace):
    zones = trace.options.thermal_zones
    polled = trace.event("thermal").withColumnsRenamed({"time": "Time", **zones})
    return _tagged(trace, polled, "Time", *zones.values())


def fps(trace):
    columns = ("ts", "ts_iter", "desired_ts", "ready_ts", "render_time", "render_ready_time")
    return _tagged(trace, samples.frame_times(trace), *columns)


def _latency(trace):
    return tasks.wakeup_latency(trace, keep=tasks.only_important)


def wakeup_latency(trace):
    return _timed(trace, _latency(trace), "pid", "comm", "wakeup_latency", "cpu", "target_cpu")


def wakeup_latency_mean(trace):
    means = _latency(trace).filter(~F.col("comm").startswith("Hw")).groupBy(*RUN_KEYS, "comm").agg(
        tasks.mean_latency()
    )
    return means.select("wa_path", "iteration", "comm", "wakeup_latency")


def _activations(trace):
    return tasks.activations(trace, keep=tasks.only_important)


def task_activations(trace):
    return _timed(trace, _activations(trace), "pid", "comm", "cpu", "active", "duration", "duty_cycle")


def _runs_of_tasks(trace, *keys):
    """Activations are the runs themselves, so counts and sums need no look at the waits."""
    runs = tasks.only_important(trace, tasks.switch_intervals(trace))
    return runs.withColumn("cluster", trace.options.cluster_of("cpu")).groupBy(*RUN_KEYS, *keys).agg(
        F.count(F.lit(1)).alias("count"), seconds(F.sum(F.col("t_end_ns") - F.col("t_ns"))).alias("duration")
    )


def task_activations_stats(trace):
    stats = _runs_of_tasks(trace, "cpu", "cluster", "comm")
    return _tagged(trace, stats, "cpu", "cluster", "comm", "count", "duration")


def task_activations_stats_cluster(trace):
    return _tagged(trace, _runs_of_tasks(trace, "cluster", "comm"), "cluster", "comm", "count", "duration")


def perf_counters(trace):
    return _timed(trace, samples.counter_deltas(trace), "cpu", "variable", "value")


def _residency(trace, keys, rows=None):
    rows = tasks.task_cpu_ns(trace) if rows is None else rows
    return _tagged_all(trace, rows.groupBy(*RUN_KEYS, *keys).agg(*tasks.residency_columns(trace)))


def _tagged_all(trace, df):
    return _tagged(trace, df, *[c for c in df.columns if c not in RUN_KEYS])


def tasks_residency(trace):
    return _residency(trace, ["pid", "comm"])


def tasks_residency_total(trace):
    return _residency(trace, ["comm"])


def tasks_residency_cpu_total(trace):
    return _residency(trace, [], tasks.task_cpu_ns(trace).filter(~F.col("comm").startswith(tasks.IDLE_TASKS)))


def cgroup_attach_task(trace):
    return _timed(trace, trace.event("cgroup_attach_task"), "dst_path", "pid", "comm")


def _latency_by_cgroup(trace):
    # other tasks' wakeups and runs are left out before the order, not after it
    return tasks.by_cgroup(trace, tasks.wakeup_latency(trace, tasks.only_members))


def wakeup_latency_cgroup(trace):
    return _timed(
        trace, _latency_by_cgroup(trace), "cgroup", "pid", "comm", "wakeup_latency", "cpu", "target_cpu"
    )


def wakeup_latency_cgroup_mean(trace):
    means = _latency_by_cgroup(trace).groupBy(*RUN_KEYS, "cgroup").agg(
        tasks.mean_latency()
    )
    return means.select("wa_path", "iteration", "cgroup", "wakeup_latency")


def tasks_residency_cgroup(trace):
    return _residency(trace, ["cgroup", "comm"], tasks.by_cgroup(trace, tasks.task_cpu_ns(trace)))


def tasks_residency_cgroup_total(trace):
    return _residency(trace, ["cgroup"], tasks.by_cgroup(trace, tasks.task_cpu_ns(trace)))


def energy_estimate(trace):
    estimate = cpus.energy_estimate(trace)
    return _timed(trace, estimate, *[c for c in estimate.columns if c not in (*RUN_KEYS, "t_ns")])


def energy_estimate_mean(trace):
    estimate = cpus.energy_estimate(trace)
    powers = [c for c in estimate.columns if c not in (*RUN_KEYS, "t_ns")]
    means = estimate.groupBy(*RUN_KEYS).agg(*[F.avg(c).alias(c) for c in powers])
    return _tagged(trace, means, *powers).withColumn("metric", F.lit("energy-estimate"))


Dataset = Callable[[Trace], DataFrame]

METRICS: dict[str, tuple[Dataset, ...]] = {
    "power": (pixel6_emeter, pixel6_emeter_mean),
    "idle": (cpu_idle, idle_residency),
    "idle-miss": (cpu_idle_miss, cpu_idle_miss_counts),
    "freq": (freqs, freqs_mean, freqs_residency),
    "overutil": (overutilized, overutilized_mean),
    "pelt": (sched_pelt_cfs, sched_pelt_cfs_root, sched_pelt_cfs_mean),
    "capacity": (capacity,),
    "uclamp": (uclamp_updates,),
    "adpf": (adpf, adpf_totals),
    "thermal": (thermal,),
    "fps": (fps,),
    "wakeup-latency": (wakeup_latency, wakeup_latency_mean),
    "tasks-activations": (task_activations, task_activations_stats, task_activations_stats_cluster),
    "perf-trace-event": (perf_counters,),
    "tasks-residency": (tasks_residency, tasks_residency_total, tasks_residency_cpu_total),
    "cgroup-attach": (cgroup_attach_task,),
    "wakeup-latency-cgroup": (wakeup_latency_cgroup, wakeup_latency_cgroup_mean),
    "tasks-residency-cgroup": (tasks_residency_cgroup, tasks_residency_cgroup_total),
    "energy-estimate": (energy_estimate, energy_estimate_mean),
}
DATASETS: dict[str, Dataset] = {make.__name__: make for made in METRICS.values() for make in made}

# Datasets that only filter and project what a scan reads.
STRAIGHT = (
    "cpu_idle", "cpu_idle_miss", "freqs", "sched_pelt_cfs", "sched_pelt_cfs_root", "capacity", "adpf", "thermal",
    "cgroup_attach_task",
)

NEEDS_TASK_LIST = ("wakeup-latency", "tasks-activations")
USE_INTERVALS = ("tasks-activations", "tasks-residency", "tasks-residency-cgroup")

# Order of the rows where a dataset has one; applied by whoever shows it, not before a write.
CLUSTER_SORT = ("iteration", "order_cluster")


def sort_by_clusters(trace: Trace, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows by iteration and rank of the cluster, with the tags, the cluster and ``columns``."""
    return df.withColumn("order_cluster", trace.options.cluster_order("cluster")).orderBy(*CLUSTER_SORT).select(
        *TAGS, "cluster", *columns
    )


def sort_by_total(df: DataFrame, *keys: str, total: str = "Total") -> DataFrame:
    """Rows with the largest ``total`` first, within ``keys``: the order in which totals are shown."""
    return df.orderBy(*keys, F.desc(total))


def run_metrics(
    trace: Trace, path: str, metrics: Sequence[str] | None = None, stage: str | None = None
) -> dict[str, str]:
    """Write the datasets of the metrics below ``path``; one that fails does not stop the others.

    A metric fails when Spark raises, and when a dataset has no row of any run in hand; rows of
    these runs from an earlier call are then read no more. A run without rows beside others is logged.

    Steps shared by several metrics are written once below ``stage``, when it is given. Returns
    the message of each metric that failed.
    """
    wanted = list(metrics or METRICS)
    unknown = [m for m in wanted if m not in METRICS]
    if unknown:
        raise RunweaveError(f"unknown metrics: {', '.join(unknown)}")
    if stage:
        trace = _prepared(trace, stage, len([m for m in wanted if m in USE_INTERVALS]) > 1)
    runs = [r.wa_path for r in trace.runs.select("wa_path").distinct().collect()]
    failed = {}
    for metric in wanted:
        try:
            if metric in NEEDS_TASK_LIST:
                _require_task_lists(trace)
            for make in METRICS[metric]:
                rows = write_dataset(make(trace), path, make.__name__, make.__name__ not in STRAIGHT, runs)
                if not any(rows.values()):
                    raise EmptyMetric(f"{make.__name__} has no row for any iteration")
                if without := [run for run, n in rows.items() if not n]:
                    log.warning("%s has no row for %s", make.__name__, ", ".join(without))
        except (RunweaveError, PySparkException, Py4JJavaError) as error:
            log.error("%s: %s", metric, error)
            failed[metric] = str(error)
    return failed


def _prepared(trace: Trace, stage: str, intervals: bool) -> Trace:
    """The trace with its windows, and the switch intervals if asked, written out once."""

    def kept(trace, name, df):
        write_table(df, f"{stage}/{name}")
        return replace(trace, prepared={**trace.prepared, name: read_table(trace.spark, f"{stage}/{name}")})

    trace = kept(trace, "slices", trace.slices)
    if intervals and trace.has("sched_switch"):
        trace = kept(trace, "switch_intervals", tasks.switch_intervals(trace))
    return trace


def _require_task_lists(trace: Trace) -> None:
    """Runs of workloads without a task list give no rows; an error when no run has one."""
    known = list(trace.options.important_tasks)
    if trace.runs.filter(F.col("label").isin(known)).isEmpty():
        raise RunweaveError("no run's workload has a list of important tasks")
