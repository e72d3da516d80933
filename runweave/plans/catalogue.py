"""All queries by name, as functions of a session and a directory of the given tables.

Plain names are datasets of a metric, ``runs_`` ones datasets across runs, ``view_`` ones the tables
behind views, ``step_`` ones single building blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.functions import text
from runweave.functions.stats import Mergeable, python_statistics, statistics
from runweave.operators.ordered import follow
from runweave.operators import cpus, distribution, matching, tasks
from runweave.plans import adapter, datasets, metrics, summary, views
from runweave.plans.compare import compare_runs
from runweave.sources import quality
from runweave.sources.scan import unique_times
from runweave.trace import RUN_KEYS

Query = Callable[[SparkSession, str], DataFrame]

EXACT_DIGITS = 6
TEST_DIGITS = 9


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _metric(make, *inexact) -> Query:
    """A metric's dataset; columns whose last digits depend on the order of summing are rounded."""

    def query(spark, sf_dir):
        df = make(adapter.trace(spark, sf_dir))
        return rounded(df, EXACT_DIGITS, *inexact) if inexact else df

    return query


def _runs(name, inexact=(), digits=EXACT_DIGITS) -> Query:
    def query(spark, sf_dir):
        df = adapter.analysis(spark, sf_dir).dataset(name)
        return rounded(df, digits, *inexact) if inexact else df

    return query


def _view(make, *args, inexact=(), **how) -> Query:
    def query(spark, sf_dir):
        df = make(adapter.analysis(spark, sf_dir), *args, **how)
        return rounded(df, EXACT_DIGITS, *inexact) if inexact else df

    return query


def _compared(make, *args, exact=True, **how) -> Query:
    """A comparison; where it does not round the value itself, that is done here (not ``exact``)."""

    def query(spark, sf_dir):
        df = make(adapter.analysis(spark, sf_dir), *args, **how)
        inexact = [c for c in ("std", "sem", "perc_diff") if c in df.columns]
        if not exact:
            df = rounded(df, EXACT_DIGITS, "value")
        df = rounded(df, EXACT_DIGITS, *inexact)
        return rounded(df, TEST_DIGITS, "ks_p") if "ks_p" in df.columns else df

    return query


QUERIES: dict[str, Query] = {name: _metric(make) for name, make in metrics.DATASETS.items()}
QUERIES["pixel6_emeter"] = _metric(metrics.pixel6_emeter, "power")
QUERIES["pixel6_emeter_mean"] = _metric(metrics.pixel6_emeter_mean, "power")

QUERIES |= {
    "runs_results": _runs("results"),
    "runs_results_perf": _runs("results_perf"),
    "runs_jankbench": _runs("jankbench"),
    "runs_jb_max_frame_duration": _runs("jb_max_frame_duration"),
    "runs_jb_mean_frame_duration": _runs("jb_mean_frame_duration", ["value"]),
    "runs_jankbench_percs": _runs("jankbench_percs"),
    "runs_adpf": _runs("adpf"),
    "runs_adpf_totals_melt": _runs("adpf_totals_melt"),
    "runs_ds_adpf": _runs("ds_adpf"),
    "runs_pixel6_emeter_mean": _runs("pixel6_emeter_mean", ["power"]),
    "runs_overutilized": _runs("overutilized"),
    "runs_overutilized_mean": _runs("overutilized_mean"),
    "runs_freqs_mean": _runs("freqs_mean"),
    "runs_thermal": _runs("thermal"),
    "runs_thermal_melt": _runs("thermal_melt"),
    "runs_idle_residency": _runs("idle_residency"),
    "runs_cpu_idle_miss_counts": _runs("cpu_idle_miss_counts"),
    "runs_energy_estimate_melt": _runs("energy_estimate_melt"),
    "runs_sched_pelt_cfs_melt": _runs("sched_pelt_cfs_melt"),
    "runs_wakeup_latency_mean": _runs("wakeup_latency_mean"),
    "runs_wakeup_latency": _runs("wakeup_latency"),
    "runs_wakeup_latency_quantiles": _runs("wakeup_latency_quantiles", ["wakeup_latency"], TEST_DIGITS),
    "runs_wakeup_latency_execution_cluster": _runs("wakeup_latency_execution_cluster"),
    "runs_wakeup_latency_target_cluster": _runs("wakeup_latency_target_cluster"),
    "runs_wakeup_latency_cgroup": _runs("wakeup_latency_cgroup"),
    "runs_wakeup_latency_cgroup_mean": _runs("wakeup_latency_cgroup_mean"),
    "runs_wakeup_latency_cgroup_quantiles": _runs("wakeup_latency_cgroup_quantiles", ["value"], TEST_DIGITS),
    "runs_tasks_residency_cpu_total_melt": _runs("tasks_residency_cpu_total_melt"),
    "runs_tasks_residency_cpu_total_cluster_melt": _runs("tasks_residency_cpu_total_cluster_melt"),
    "runs_tasks_residency_total": _runs("tasks_residency_total"),
    "runs_tasks_residency_total_melt": _runs("tasks_residency_total_melt"),
    "runs_tasks_residency_total_cluster_melt": _runs("tasks_residency_total_cluster_melt"),
    "runs_tasks_residency_cluster_melt": _runs("tasks_residency_cluster_melt"),
    "runs_tasks_residency_cgroup_total": _runs("tasks_residency_cgroup_total"),
    "runs_cgroup_residency_total_melt": _runs("cgroup_residency_total_melt"),
    "runs_cgroup_residency_total_cluster_melt": _runs("cgroup_residency_total_cluster_melt"),
    "runs_task_activations_stats_cluster_melt": _runs("task_activations_stats_cluster_melt"),
    "runs_uclamp_updates": _runs("uclamp_updates"),
    "runs_fps": _runs("fps"),
    "runs_frame_target_counts": _view(datasets.frame_target_counts, target_fps=adapter.TARGET_FPS),
    "runs_capacity": _runs("capacity"),
}

SCORES = ("jank_p", "mean")
ADPF_SHOWN = ("average fps", "thermal status", "Adaptive LOD")

QUERIES |= {
    "view_results_line": _view(views.results_line, SCORES),
    "view_results_bar": _compared(views.results_bar, SCORES),
    "view_perf_line": _view(views.perf_line),
    "view_perf_bar": _compared(views.perf_bar),
    "view_jankbench_max_frame_durations": _compared(views.jankbench_max_frame_durations),
    "view_jankbench_mean_frame_durations_line": _view(
        views.jankbench_mean_frame_durations_line, inexact=["value"]
    ),
    "view_jankbench_mean_frame_durations_bar": _compared(views.jankbench_mean_frame_durations_bar),
    "view_jankbench_frame_durations_hist": _view(views.jankbench_frame_durations_hist),
    "view_jankbench_frame_durations_ecdf": _view(views.jankbench_frame_durations_ecdf),
    "view_jankbench_jank_percentage_line": _view(views.jankbench_jank_percentage_line),
    "view_jankbench_jank_percentage_bar": _compared(views.jankbench_jank_percentage_bar),
    "view_jankbench_metric_line": _view(views.jankbench_metric_line),
    "view_jankbench_jank_percentage_metric_bar": _compared(views.jankbench_jank_percentage_metric_bar),
    "view_jankbench_mean_duration_metric_bar": _compared(views.jankbench_mean_duration_metric_bar),
    "view_drarm_adpf_fps_line": _view(views.drarm_adpf_fps_line),
    "view_drarm_adpf_fps_bar": _compared(views.drarm_adpf_fps_bar),
    "view_drarm_adpf_metric_line": _view(views.drarm_adpf_metric_line, ADPF_SHOWN),
    "view_power_meter_line": _view(views.power_meter_line, inexact=["value"]),
    "view_power_meter_bar": _compared(views.power_meter_bar),
    "view_overutilized_table": _view(views.overutilized_table),
    "view_overutilized_line": _view(views.overutilized_line),
    "view_frequency_line": _view(views.frequency_line),
    "view_frequency_bar": _compared(views.frequency_bar),
    "view_thermal_line": _view(views.thermal_line),
    "view_thermal_bar": _compared(views.thermal_bar),
    "view_idle_miss_bar": _view(views.idle_miss_bar, inexact=["count_perc"]),
    "view_energy_estimate_line": _view(views.energy_estimate_line),
    "view_energy_estimate_bar": _compared(views.energy_estimate_bar),
    "view_sched_pelt_cfs_line": _view(views.sched_pelt_cfs_line),
    "view_sched_pelt_cfs_bar": _compared(views.sched_pelt_cfs_bar),
    "view_wakeup_latency_line": _view(views.wakeup_latency_line),
    "view_wakeup_latency_bar": _compared(views.wakeup_latency_bar, exact=False),
    "view_wakeup_latency_quantiles_bar": _compared(views.wakeup_latency_quantiles_bar, exact=False),
    "view_wakeup_latency_execution_cluster_bar": _view(views.wakeup_latency_execution_cluster_bar),
    "view_wakeup_latency_target_cluster_bar": _view(views.wakeup_latency_target_cluster_bar),
    "view_wakeup_latency_cgroup_line": _view(views.wakeup_latency_cgroup_line),
    "view_wakeup_latency_cgroup_bar": _compared(views.wakeup_latency_cgroup_bar, exact=False),
    "view_wakeup_latency_cgroup_quantiles_bar": _compared(views.wakeup_latency_cgroup_quantiles_bar, exact=False),
    "view_tasks_cpu_residency_cluster_line": _view(views.tasks_cpu_residency_cluster_line),
    "view_tasks_cpu_residency_cluster_bar": _compared(views.tasks_cpu_residency_cluster_bar),
    "view_tasks_cpu_residency_per_task_bar": _compared(views.tasks_cpu_residency_per_task_bar),
    "view_tasks_cpu_residency_cpu_bar": _compared(views.tasks_cpu_residency_cpu_bar),
    "view_cgroup_cpu_residency_cluster_bar": _compared(views.cgroup_cpu_residency_cluster_bar),
    "view_cgroup_cpu_residency_cpu_bar": _compared(views.cgroup_cpu_residency_cpu_bar),
    "view_task_activations_stats_count_line": _view(views.task_activations_stats_count_line),
    "view_task_activations_stats_duration_line": _view(views.task_activations_stats_duration_line),
    "view_task_activations_stats_count_bar": _compared(views.task_activations_stats_count_bar),
    "view_task_activations_stats_duration_bar": _compared(views.task_activations_stats_duration_bar),
    "view_task_activations_detailed": _view(
        views.task_activations_detailed, *adapter.TAGS, iteration=1, comm="RenderThread"
    ),
    "view_uclamp_per_task_line": _view(views.uclamp_per_task_line),
    "view_frame_rendering_line": _view(views.frame_rendering_line, target_fps=adapter.TARGET_FPS),
    "view_frame_target_count_line": _view(views.frame_target_count_line, target_fps=adapter.TARGET_FPS),
    "view_frame_target_count_bar": _compared(views.frame_target_count_bar, target_fps=adapter.TARGET_FPS),
    "view_capacity_line": _view(views.capacity_line, iteration=1, cpu=2),
    "view_idle_residency_bar": _view(views.idle_residency_bar),
    "view_summary": _view(
        summary.summary, ("results", "jb_mean_frame_duration", "jankbench_percs", "jb_max_frame_duration",
                          "power_usage", "overutilized_mean", "thermal", "wakeup_latency", "tasks_cpu_residency_per_task"),
        SCORES,
    ),
}


def _trace(make, *inexact) -> Query:
    def query(spark, sf_dir):
        df = make(adapter.trace(spark, sf_dir))
        return rounded(df, EXACT_DIGITS, *inexact) if inexact else df

    return query


HOUR_NS = 3_600_000_000_000
SLICE_ROWS = 500  # as the adapter's slices: the tables at hand are cut as large ones are


def step_unique_times(spark, sf_dir):
    """Events put on the hour, so many share an instant."""
    ev = adapter.base_events(spark, sf_dir)
    return unique_times(ev.select(*RUN_KEYS, (F.col("t_ns") - F.col("t_ns") % HOUR_NS).alias("t_ns"), "seq"))


def step_time_checks(spark, sf_dir):
    """Times moved by the value, so some rows are earlier than the one before."""
    ev = adapter.base_events(spark, sf_dir)
    moved = F.when(F.col("cents") % 10 != 0, F.col("t_ns") + F.col("whole") * HOUR_NS)
    return quality.time_checks(ev.select(*RUN_KEYS, moved.alias("t_ns"), "seq"))


def step_missing_events(spark, sf_dir):
    """Kinds of events an iteration has none of with a large value, and one that none has at all."""
    trace = adapter.trace(spark, sf_dir)
    found = trace.clock.filter("whole > 150").select(*RUN_KEYS, F.col("type").alias("event"))
    return quality.missing_events(trace.windows, found, ("click", "error", "purchase", "signup", "view", "logout"))


def step_missing_iterations(spark, sf_dir):
    trace = adapter.trace(spark, sf_dir)
    return quality.missing_iterations(trace.windows, trace.clock.filter("whole > 300"))


def step_missing_tasks(spark, sf_dir):
    """The task list with a name that is in no run."""
    longer = {"synth": (*adapter.OPTIONS.tasks_of("synth"), "decon0_kthread")}
    return quality.missing_tasks(adapter.trace(spark, sf_dir, adapter.OPTIONS.overridden({"important_tasks": longer})))


def step_held_mean(trace):
    """Mean frequency per CPU, each value weighted by how long it holds."""
    spans = trace.spans(cpus.frequency_events(trace), ["cpu"]).withColumn("held", F.expr("t_end_ns - t_ns"))
    return distribution.signal_mean(spans, [*RUN_KEYS, "cpu"], "frequency", "held")


def step_frequency_as_of(trace):
    """The frequency of a task's CPU at each of its switch-ins, 0 before the first change."""
    held = matching.asof(tasks.switch_ins(trace), cpus.frequency_events(trace), [*RUN_KEYS, "cpu"], order=["seq"], rows_per_slice=SLICE_ROWS)
    return held.select(*RUN_KEYS, "cpu", "t_ns", "pid", F.coalesce("match.frequency", F.lit(0)).alias("frequency"))


def step_next_run(trace):
    """The next switch-in of each woken task that comes within two days."""
    woken = trace.event("sched_wakeup").select(*RUN_KEYS, "t_ns", "pid", "comm")
    found = matching.asof(woken, tasks.switch_ins(trace), [*RUN_KEYS, "pid"], direction="forward", tolerance=48 * HOUR_NS, order=["seq"], rows_per_slice=SLICE_ROWS)
    ran = F.coalesce(F.col("match.t_ns"), F.lit(-1).cast("long"))
    return found.select(*RUN_KEYS, "pid", "t_ns", ran.alias("ran_ns"), F.coalesce("match.cpu", F.lit(-1)).alias("cpu"))


def step_nearest_change(trace):
    """The frequency change of the same CPU that is nearest to each capacity change, before or after it."""
    found = matching.asof(trace.event("sched_cpu_capacity"), cpus.frequency_events(trace), [*RUN_KEYS, "cpu"], direction="nearest", order=["seq"], rows_per_slice=SLICE_ROWS)
    return found.select(*RUN_KEYS, "cpu", "t_ns", F.coalesce("match.t_ns", F.lit(-1).cast("long")).alias("change_ns"),
                        F.coalesce("match.frequency", F.lit(-1)).alias("frequency"))


def step_overlapping_runs(trace):
    """Times at which two tasks run on CPUs of one cluster at once, of intervals lengthened by six hours so that they overlap their own side's too."""
    intervals = tasks.switch_intervals(trace).select(
        *RUN_KEYS, trace.options.cluster_of("cpu").alias("cluster"), "comm", "cpu", "seq", "t_ns", (F.col("t_end_ns") + 6 * HOUR_NS).alias("t_end_ns"))
    one, other = intervals.filter("comm = 'RenderThread'"), intervals.filter("comm = 'GameThread'")
    pairs = matching.overlaps(one, other, [*RUN_KEYS, "cluster"], rows_per_slice=SLICE_ROWS)
    return pairs.select(*RUN_KEYS, "cluster", F.col("left.seq").alias("seq"), F.col("right.seq").alias("other"), "overlap")


def step_burst_intervals(spark, sf_dir):
    """Who runs on each CPU from when to when, where most events of an iteration are in a small part of it."""
    intervals = tasks.switch_intervals(adapter.burst_trace(spark, sf_dir))
    return intervals.select(*RUN_KEYS, "cpu", "t_ns", "t_end_ns", "seq")


def _stored(make, *tables) -> Query:
    """A metric's dataset from the event store, of which it reads these tables."""
    return lambda spark, sf_dir: make(adapter.stored_trace(spark, sf_dir, tables))


STORED = {
    "tasks_residency_total": ["timeline"], "idle_residency": ["timeline"], "freqs_residency": ["timeline"], "energy_estimate_mean": ["timeline"],
    "overutilized": ["sched_overutilized"], "perf_counters": ["perf_counter"], "wakeup_latency": ["sched_wakeup", "sched_switch"],
    "task_activations": ["sched_switch"],
}
QUERIES |= {f"store_{name}": _stored(metrics.DATASETS[name], *tables) for name, tables in STORED.items()}


def step_cluster_residency(trace):
    """CPU time per task name and cluster, in long form."""
    cluster = trace.options.cluster_of("cpu").alias("cluster")
    per = tasks.task_cpu_ns(trace).groupBy(*RUN_KEYS, "comm", cluster).agg(F.sum("ns").alias("ns"))
    return per.withColumns({"time": F.expr("cast(ns as double) / 1e9D")}).drop("ns")


def step_human_labels(spark, sf_dir):
    orders = adapter.read(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", text.human_number("o_totalprice").alias("plain"),
        text.human_number("o_totalprice * 1000").alias("large"), text.human_number("o_totalprice * -1000").alias("negative"),
        text.human_number("o_totalprice * 1e12D").alias("huge"), text.human_number("o_custkey / 1e6D").alias("small"),
        text.signed_percent("o_custkey / 7 - 100").alias("change"),
        text.marked_change("o_custkey", "o_custkey / 7 - 100", "o_orderkey % 10 / 100").alias("marked"),
    )


def step_names(spark, sf_dir):
    """Run names, event files and task labels made of the customers', taken apart again."""
    customers = adapter.read(spark, sf_dir, "customer")
    run = "concat('wl_', lower(c_mktsegment), '_k', c_nationkey, '_10_0101')"
    label = F.concat(F.lit("["), F.col("c_custkey"), F.lit(":"), F.col("c_name"), F.lit(":x]"))
    file = F.concat(F.when(F.col("c_custkey") % 2 == 0, "lisa__").otherwise(""), F.lower("c_mktsegment"), F.lit(".pq"))
    return customers.select(
        "c_custkey", text.run_tag(run).alias("tag"), text.run_workload(run).alias("workload"),
        text.run_tag("c_mktsegment").alias("no_tag"), text.task_comm(label).alias("comm"),
        text.event_name(file).alias("event"), text.perf_name("c_name").alias("perf"),
        text.miss_type(F.col("c_custkey") % 3).alias("miss"),
    )


def step_price_quantiles(spark, sf_dir):
    lines = adapter.read(spark, sf_dir, "lineitem")
    found = distribution.quantiles(
        lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", datasets.QUANTILES,
    )
    return rounded(found, EXACT_DIGITS, "l_extendedprice")


def step_frame_test(spark, sf_dir):
    """The two-sample test on all frame durations of both runs: tens of thousands of values each."""
    ana = adapter.analysis(spark, sf_dir)
    frames = ana.dataset("jankbench").filter("variable = 'total_duration'")
    return rounded(distribution.two_sample_test(frames, ["variable"], "value", ana.tags), TEST_DIGITS, "ks_p")


def step_near_equal_test(spark, sf_dir):
    """The two-sample test on samples that hardly differ: all prices, and the same with the first order's once more."""
    lines = adapter.read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("value"), "l_orderkey")
    first = lines.agg(F.min("l_orderkey")).scalar()
    copies = F.when(F.col("l_orderkey") == first, F.array(*map(F.lit, ("base", "more", "more"))))
    tags = copies.otherwise(F.array(F.lit("base"), F.lit("more")))
    samples = lines.select("value", F.explode(tags).alias("tag"), F.lit("price").alias("facet"))
    return rounded(distribution.two_sample_test(samples, ["facet"], "value", ["base", "more"]), TEST_DIGITS, "ks_p", "ks_d")


def step_null_keys(spark, sf_dir):
    """Next value, running total and number in groups of which one has a null key, in slices."""
    lines = adapter.read(spark, sf_dir, "lineitem").select(
        F.nullif("l_returnflag", F.lit("A")).alias("flag"), "l_linestatus", "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("line"), F.expr("l_orderkey div 500").alias("piece"),
    ).distinct()
    looked = follow(
        lines, ["flag", "l_linestatus"], ["l_orderkey", "line"], slice_col="piece",
        ahead={"next_order": "l_orderkey"}, total={"upto": "line"}, number="row",
    )
    return looked.drop("piece").na.fill(-1, ["next_order"])


def step_nan_values(spark, sf_dir):
    """Shares of values up to each one, with infinities and NaN among them."""
    lines = adapter.read(spark, sf_dir, "lineitem")
    value = F.expr("case l_linenumber when 7 then double('NaN') when 6 then double('Infinity') when 5 then double('-Infinity') else l_quantity end")
    shares = distribution.ecdf(lines.select("l_returnflag", value.alias("v")), ["l_returnflag"], "v")
    label = F.expr("case when isnan(v) then 'NaN' when abs(v) = double('Infinity') then if(v > 0, 'inf', '-inf') else cast(cast(v as bigint) as string) end")
    return rounded(shares.select("l_returnflag", label.alias("v"), "ecdf"), EXACT_DIGITS, "ecdf")


def step_own_statistics(spark, sf_dir):
    """A comparison of results with a user's own statistics: a function of all values, and one that is merged from parts."""
    ana = adapter.analysis(spark, sf_dir)
    rows = ana.dataset("results").filter(F.col("metric").isin(list(SCORES)))
    spread = Mergeable(lambda: None, lambda s, v: (min(v.min(), s[0] if s else v.min()), max(v.max(), s[1] if s else v.max())),
                       lambda a, b: (min(a[0], b[0]), max(a[1], b[1])) if a and b else a or b, lambda s: float(s[1] - s[0]) if s else None)
    own = {"trimmed": lambda v: float(np.sort(v)[1:-1].mean()) if len(v) > 2 else None, "spread": spread, "largest": F.max}
    table = compare_runs(rows, ana.tags, ["metric", "test_name"], percentage=False, stats=own)
    return rounded(table.select("tag", "metric", "test_name", "n", *own), EXACT_DIGITS, *own)


def step_merged_statistics(spark, sf_dir):
    """Mean and share of values above 50,000, merged from parts, of all prices."""
    lines = adapter.read(spark, sf_dir, "lineitem")
    parts = Mergeable(lambda: (0, 0), lambda s, v: (s[0] + len(v), s[1] + int((v > 50_000).sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[1] / s[0] if s[0] else None)
    return rounded(python_statistics(lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"above": parts}), EXACT_DIGITS, "above")


def step_value_statistics(spark, sf_dir):
    """Statistics per user, zeros among the values."""
    ev = adapter.base_events(spark, sf_dir).withColumn("value", F.col("whole").cast("double"))
    return rounded(ev.groupBy("pid").agg(F.count("value").alias("n"), *statistics("value")), EXACT_DIGITS,
                   "gmean", "std", "sem")


QUERIES |= {
    "step_trace_windows": _trace(lambda trace: trace.windows),
    "step_switch_intervals": _trace(tasks.switch_intervals),
    "step_cluster_residency": _trace(step_cluster_residency),
    "step_power_spans": _trace(cpus.power_spans),
    "step_task_names": _trace(tasks.task_names),
    "step_names_by_pid": _trace(tasks.names_by_pid),
    "step_cgroup_members": _trace(tasks.cgroup_members),
    "step_held_mean": _trace(step_held_mean, "frequency"),
    "step_frequency_as_of": _trace(step_frequency_as_of),
    "step_next_run": _trace(step_next_run),
    "step_nearest_change": _trace(step_nearest_change),
    "step_overlapping_runs": _trace(step_overlapping_runs),
    "step_burst_intervals": step_burst_intervals,
    "step_unique_times": step_unique_times,
    "step_time_checks": step_time_checks,
    "step_missing_events": step_missing_events,
    "step_missing_iterations": step_missing_iterations,
    "step_missing_tasks": step_missing_tasks,
    "step_human_labels": step_human_labels,
    "step_names": step_names,
    "step_price_quantiles": step_price_quantiles,
    "step_frame_test": step_frame_test,
    "step_near_equal_test": step_near_equal_test,
    "step_null_keys": step_null_keys,
    "step_nan_values": step_nan_values,
    "step_value_statistics": step_value_statistics,
    "step_own_statistics": step_own_statistics,
    "step_merged_statistics": step_merged_statistics,
}
