"""The table behind each view of an analysis. Drawing is left to the reader's own tools."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.functions.text import human_number
from runweave.operators.distribution import ecdf, histogram
from runweave.plans.compare import compare_runs, series
from runweave.plans.datasets import TARGET_FPS, Analysis, frame_target_counts


def _bar(ana: Analysis, df: DataFrame, facets: Sequence[str], value="value", compare=compare_runs, **how):
    """``compare=asked`` leaves the comparison to ``compare_stacked``."""
    return compare(df, ana.tags, facets, value, options=ana.options, **how)


def _line(ana: Analysis, df: DataFrame, facets: Sequence[str] = (), value="value", x="iteration") -> DataFrame:
    return series(df, ana.tags, value, x, facets)


def _in(column: str, wanted) -> F.Column:
    return F.col(column).isin(list(wanted))


# Benchmark results

def results_line(ana, metrics):
    return _line(ana, ana.dataset("results").filter(_in("metric", metrics)), ["metric"])


def _result_facets(df: DataFrame) -> list[str]:
    """Scores of different tests are never pooled."""
    return ["metric", *(["test_name"] if "test_name" in df.columns else [])]


def results_bar(ana, metrics, **how):
    rows = ana.dataset("results").filter(_in("metric", metrics))
    return _bar(ana, rows, _result_facets(rows), **how)


def perf_line(ana, counters=None):
    return _line(ana, ana.dataset("results_perf").filter(_in("metric", counters or ana.options.perf_counters)), ["metric"])


def perf_bar(ana, counters=None, **how):
    wanted = _in("metric", counters or ana.options.perf_counters)
    rows = ana.dataset("results_perf").filter(wanted)
    return _bar(ana, rows, _result_facets(rows), **how)


# Frames of the jank benchmark

def jankbench_max_frame_durations(ana, **how):
    return _bar(ana, ana.dataset("jb_max_frame_duration"), ["variable"], **how)


def jankbench_mean_frame_durations_line(ana):
    return _line(ana, ana.dataset("jb_mean_frame_duration"))


def jankbench_mean_frame_durations_bar(ana, **how):
    return _bar(ana, ana.dataset("jb_mean_frame_duration"), ["variable"], **how)


def jankbench_frame_durations_hist(ana, bins=40):
    return histogram(ana.dataset("jankbench").filter("variable = 'total_duration'"), ["tag"], "value", bins)


def jankbench_frame_durations_ecdf(ana):
    return ecdf(ana.dataset("jankbench").filter("variable = 'total_duration'"), ["tag"], "value")


def jankbench_jank_percentage_line(ana):
    return _line(ana, ana.dataset("jankbench_percs"), value="perc")


def jankbench_jank_percentage_bar(ana, **how):
    return _bar(ana, ana.dataset("jankbench_percs"), ["variable"], "perc", **how)


def jankbench_metric_line(ana):
    return _line(ana, ana.dataset("results"), ["test_name", "metric"])


def _per_test(ana, metric, how):
    return _bar(ana, ana.dataset("results").filter(F.col("metric") == metric), ["metric", "test_name"], **how)


def jankbench_jank_percentage_metric_bar(ana, **how):
    return _per_test(ana, "jank_p", how)


def jankbench_mean_duration_metric_bar(ana, **how):
    return _per_test(ana, "mean", how)


# ADPF reports

def drarm_adpf_fps_line(ana):
    return _line(ana, ana.dataset("adpf_totals_melt"), ["variable"])


def drarm_adpf_fps_bar(ana, **how):
    return _bar(ana, ana.dataset("adpf_totals_melt"), ["variable"], **how)


def drarm_adpf_metric_line(ana, metrics):
    """The points of each of the named columns, each under its own name."""
    rows = ana.dataset("ds_adpf")
    named = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics
    ])
    return _line(ana, rows.select("ts", "tag", F.inline(named)), ["metric"], x="ts")


# Trace metrics

def power_meter_line(ana):
    return _line(ana, ana.dataset("pixel6_emeter_mean"), ["channel"], "power")


def power_meter_bar(ana, channels=None, **how):
    power = ana.dataset("pixel6_emeter_mean")
    return _bar(ana, power.filter(_in("channel", channels)) if channels else power, ["channel"], "power", **how)


def overutilized_table(ana):
    return ana.dataset("overutilized_mean").select("metric", "tag", "time", "total_time", "percentage")


def overutilized_line(ana):
    return _line(ana, ana.dataset("overutilized"), value="percentage")


def frequency_line(ana):
    return _line(ana, ana.dataset("freqs_mean"), ["cluster"])


def frequency_bar(ana, **how):
    return _bar(ana, ana.dataset("freqs_mean"), ["metric", "cluster"], **how)


def thermal_line(ana):
    return _line(ana, ana.dataset("thermal_melt"), ["cluster"])


def thermal_bar(ana, **how):
    return _bar(ana, ana.dataset("thermal_melt"), ["cluster"], **how)


def idle_residency_bar(ana):
    return ana.dataset("idle_residency")


def idle_miss_bar(ana):
    """Misses as a percentage of all wakeups, by kind."""
    return ana.dataset("cpu_idle_miss_counts").groupBy("tag", "type").agg(F.sum("count_perc").alias("count_perc"))


def energy_estimate_line(ana):
    return _line(ana, ana.dataset("energy_estimate_melt"), ["cluster"])


def energy_estimate_bar(ana, **how):
    return _bar(ana, ana.dataset("energy_estimate_melt"), ["cluster"], **how)


def sched_pelt_cfs_line(ana):
    return _line(ana, ana.dataset("sched_pelt_cfs_melt"), ["cluster", "variable"])


def sched_pelt_cfs_bar(ana, **how):
    return _bar(ana, ana.dataset("sched_pelt_cfs_melt"), ["cluster", "variable"], **how)


def wakeup_latency_line(ana):
    return _line(ana, ana.dataset("wakeup_latency_mean"), ["comm"])


def wakeup_latency_bar(ana, **how):
    return _bar(ana, ana.dataset("wakeup_latency_mean"), ["comm"], digits=0, **how)


def wakeup_latency_quantiles_bar(ana, **how):
    found = ana.dataset("wakeup_latency_quantiles")
    return _bar(ana, found, ["comm", "quantile"], "wakeup_latency", digits=0, **how)


def _labelled(df, value):
    return df.withColumn("label", human_number(value))


def wakeup_latency_execution_cluster_bar(ana):
    return _labelled(ana.dataset("wakeup_latency_execution_cluster"), "wakeup_latency")


def wakeup_latency_target_cluster_bar(ana):
    return _labelled(ana.dataset("wakeup_latency_target_cluster"), "wakeup_latency")


def wakeup_latency_cgroup_line(ana):
    return _line(ana, ana.dataset("wakeup_latency_cgroup_mean"), ["cgroup"])


def wakeup_latency_cgroup_bar(ana, **how):
    return _bar(ana, ana.dataset("wakeup_latency_cgroup_mean"), ["cgroup"], digits=0, **how)


def wakeup_latency_cgroup_quantiles_bar(ana, **how):
    return _bar(ana, ana.dataset("wakeup_latency_cgroup_quantiles"), ["cgroup", "quantile"], digits=0, **how)


def tasks_cpu_residency_cluster_line(ana):
    return _line(ana, ana.dataset("tasks_residency_cpu_total_cluster_melt"), ["cluster"])


def tasks_cpu_residency_cluster_bar(ana, **how):
    return _bar(ana, ana.dataset("tasks_residency_cpu_total_cluster_melt"), ["cluster"], **how)


def tasks_cpu_residency_per_task_bar(ana, **how):
    return _bar(ana, ana.dataset("tasks_residency_total_cluster_melt"), ["comm", "cluster"], **how)


def tasks_cpu_residency_cpu_bar(ana, **how):
    return _bar(ana, ana.dataset("tasks_residency_total_melt"), ["comm", "cpu"], **how)


def cgroup_cpu_residency_cluster_bar(ana, **how):
    return _bar(ana, ana.dataset("cgroup_residency_total_cluster_melt"), ["cgroup", "cluster"], **how)


def cgroup_cpu_residency_cpu_bar(ana, **how):
    return _bar(ana, ana.dataset("cgroup_residency_total_melt"), ["cgroup", "cpu"], **how)


def _of_tasks(ana, df, tasks):
    return df.filter(_in("comm", tasks or ana.options.tasks_of(ana.label)))


def task_activations_stats_count_line(ana, tasks=None):
    return _line(ana, _of_tasks(ana, ana.dataset("task_activations_stats_cluster"), tasks), ["comm", "cluster"], "count")


def task_activations_stats_duration_line(ana, tasks=None):
    stats = _of_tasks(ana, ana.dataset("task_activations_stats_cluster"), tasks)
    return _line(ana, stats, ["comm", "cluster"], "duration")


def _activation_bar(ana, variable, tasks):
    long = _of_tasks(ana, ana.dataset("task_activations_stats_cluster_melt"), tasks)
    return _bar(ana, long.filter(F.col("variable") == variable), ["comm", "cluster"], percentage=False)


def task_activations_stats_count_bar(ana, tasks=None):
    return _activation_bar(ana, "count", tasks)


def task_activations_stats_duration_bar(ana, tasks=None):
    return _activation_bar(ana, "duration", tasks)


def task_activations_detailed(ana, tag_a, tag_b, iteration, comm):
    """The activations of one task in one iteration of two runs."""
    rows = ana.dataset("task_activations")
    return rows.filter(_in("tag", [tag_a, tag_b]) & (F.col("iteration") == iteration) & (F.col("comm") == comm))


def uclamp_per_task_line(ana):
    """Clamp values over time; each holds until the task's next one."""
    updates = ana.dataset("uclamp_updates")
    return _line(ana, updates, ["task", "iteration", "uclamp_id"], x="time_it")


def frame_rendering_line(ana, target_fps: float = TARGET_FPS):
    frames = _line(ana, ana.dataset("fps"), ["iteration"], "render_time", "ts_iter")
    return frames.withColumn("target_render_time", F.lit(1000.0 / target_fps))


def frame_target_count_line(ana, target_fps: float = TARGET_FPS):
    return _line(ana, frame_target_counts(ana, target_fps), ["on_target"], "count")


def frame_target_count_bar(ana, target_fps: float = TARGET_FPS):
    return _bar(ana, frame_target_counts(ana, target_fps), ["on_target"], "count")


def capacity_line(ana, iteration, cpu):
    """Capacity of one CPU over the time of one iteration."""
    rows = ana.dataset("capacity").filter((F.col("iteration") == iteration) & (F.col("cpu") == cpu))
    return _line(ana, rows, ["iteration", "cpu"], "capacity", "time_it")


View = Callable[..., DataFrame]
VIEWS: dict[str, View] = {
    name: made for name, made in list(globals().items())
    if callable(made) and getattr(made, "__module__", None) == __name__ and not name.startswith("_")
}
