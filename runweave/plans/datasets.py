"""Datasets across runs: outputs of the metrics, tagged, reshaped and aggregated for comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.config import Options
from runweave.errors import MissingEvent, MissingRuns, RunweaveError
from runweave.functions.text import UNKNOWN, miss_type, perf_name, run_tag, tag_order
from runweave.operators.distribution import quantiles, signal_mean
from runweave.operators.ordered import cut_by, follow
from runweave.operators.reshape import melt, roll_up_channels
from runweave.plans import metrics
from runweave.sources.sink import read_dataset
from runweave.trace import NS, Trace

QUANTILES = (0.9, 0.95, 0.99)
# Columns of outputs that views read even where no run has them.
EMPTY_OUTPUTS = {
    "fps": "wa_path string, kernel string, iteration int, ts bigint, frame_time double, deviation double, fps double",
    "capacity": "wa_path string, kernel string, iteration int, time_it double, cpu int, capacity bigint",
}
TARGET_FPS = 30

Hook = Callable[[DataFrame], DataFrame]
Table = Callable[[], DataFrame]


@dataclass
class Analysis:
    """Several runs of one workload, in the order they are compared.

    ``source`` gives a metric's dataset by name for all runs, or None when there is none; it may
    compute it from a trace or read what was written. ``all_results`` and ``frames`` give the
    benchmark results and the per-frame table of all runs. ``dataset`` gives the named tables below,
    each planned once and run by Spark only when used.
    """

    spark: SparkSession
    source: Callable[[str], DataFrame | None]
    runs: DataFrame
    tags: Sequence[str]
    label: str
    options: Options = field(default_factory=Options)
    all_results: Table | None = None
    frames: Table | None = None
    made: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self):
        if not self.tags:
            raise MissingRuns("no run to analyse")

    def load(
        self, name: str, *, allow_missing: bool = False, preprocess: Hook | None = None, postprocess: Hook | None = None
    ) -> DataFrame:
        """One output of a metric for all runs with its ``tag``.

        ``preprocess`` sees the rows of all runs and keeps runs apart by ``wa_path``;
        ``postprocess`` sees the tagged rows.
        """
        df = self.source(name)
        if df is None:
            if not allow_missing:
                raise MissingEvent(f"no run has the output {name}")
            df = self.spark.createDataFrame([], EMPTY_OUTPUTS.get(name, "wa_path string, kernel string, iteration int"))
        if preprocess:
            df = df.transform(preprocess)
        df = df.withColumn("tag", run_tag("wa_path"))
        return df.transform(postprocess) if postprocess else df

    def dataset(self, name: str) -> DataFrame:
        if name not in LOADERS:
            raise RunweaveError(f"unknown dataset {name}")
        if name not in self.made:
            self.made[name] = LOADERS[name](self)
        return self.made[name]

    @property
    def cluster_names_total(self) -> list[str]:
        return [*self.options.cluster_names, "total"]

    @property
    def cpu_columns(self) -> list[str]:
        return [f"cpu{cpu}" for cpu in self.options.cpus]

    def order(self) -> Column:
        return tag_order("tag", list(self.tags))

    def show(self) -> DataFrame:
        """The runs with their tags and kernels, in order."""
        return self.runs.filter(F.col("tag").isin(list(self.tags))).select(
            "wa_path", "tag", "kernel", self.order().alias("order_tag")
        )


def of_trace(
    trace: Trace, tags: Sequence[str], label: str, results: Table | None = None, frames: Table | None = None
) -> Analysis:
    """An analysis that computes what it needs from a trace."""

    def source(name):
        try:
            return metrics.DATASETS[name](trace)
        except MissingEvent:
            return None

    return Analysis(trace.spark, source, trace.runs, tags, label, trace.options, results, frames)


def of_store(
    spark: SparkSession, path: str, runs: DataFrame, tags: Sequence[str], label: str, options: Options | None = None,
    results: Table | None = None, frames: Table | None = None,
) -> Analysis:
    """An analysis of datasets written by ``run_metrics``: of the given ``runs`` with one of the ``tags`` only.

    Other runs in the store, also of the same tag, are not read: ``wa_path`` is the partition column.
    """

    listed = [r.wa_path for r in runs.filter(F.col("tag").isin(list(tags))).select("wa_path").collect()]

    def source(name):
        return read_dataset(spark, path, name, listed)

    return Analysis(spark, source, runs, tags, label, options or Options(), results, frames)


def mean_of_seconds(column: str, out: str) -> Column:
    """Mean of times that are whole ns, summed as such: the same whatever the order of the rows."""
    ns = F.round(F.col(column) * F.lit(float(NS))).cast("long")
    return (F.sum(ns).cast("double") / F.lit(float(NS)) / F.count(column)).alias(out)


# Results and frames

def _results(ana: Analysis) -> DataFrame:
    if ana.all_results is None:
        raise MissingRuns("no benchmark results were given")
    scaled = ana.all_results().drop("scaled from(%)").withColumn("tag", run_tag("wa_path"))
    return scaled.filter("value is null or value != 0")


def results(ana):
    return _results(ana).filter(~F.col("metric").contains("perf"))


def results_perf(ana):
    return _results(ana).filter(F.col("metric").contains("perf")).withColumn("metric", perf_name("metric"))


def jankbench(ana):
    if ana.frames is None:
        raise MissingRuns("no frame table was given")
    return ana.frames().withColumn("tag", run_tag("wa_path"))


def _durations(ana):
    return ana.dataset("jankbench").filter(F.col("variable") == "total_duration")


def jb_max_frame_duration(ana):
    return _durations(ana).groupBy("tag").agg(
        F.max("iteration").alias("iteration"), F.max("value").alias("value")
    ).withColumn("variable", F.lit("max_frame_duration"))


def jb_mean_frame_duration(ana):
    return signal_mean(_durations(ana), ["tag", "iteration"], "value").withColumn(
        "variable", F.lit("mean_frame_duration")
    )


def jankbench_percs(ana):
    frames = ana.dataset("jankbench").filter(F.col("variable") == "jank_frame")
    counts = frames.groupBy("tag", "iteration").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("value") == 1.0).alias("jank_count")
    )
    share = F.round(F.col("jank_count") / F.col("count") * 100, 2)
    return counts.withColumns({"perc": share, "variable": F.lit("jank_percentage")})


# ADPF reports

def adpf(ana):
    """Report rows with their number in the run, from 0, in order of iteration and time."""

    def numbered(df):
        place = F.struct("iteration", F.floor(F.col("time") / 10).alias("at"))
        df, part = cut_by(df, place)
        rows = follow(df, ["wa_path"], ["iteration", "time"], slice_col=part, number="row")
        return rows.withColumn("ts", F.col("row") - 1).drop("row", "piece")

    return ana.load("adpf", preprocess=numbered)


def adpf_totals(ana):
    return ana.load("adpf_totals")


def adpf_totals_melt(ana):
    return melt(ana.dataset("adpf_totals"), ["iteration", "tag"], ["average fps", "frame count"])


def ds_adpf(ana):
    """The value columns of the reports against the row number."""
    rows = ana.dataset("adpf")
    other = ("wa_path", "kernel", "iteration", "time", "# frame count", "tag", "ts")
    return rows.select("ts", "tag", *[f"`{c}`" for c in rows.columns if c not in other])


# Power, overutilization, frequency, temperature

def pixel6_emeter(ana):
    return ana.load("pixel6_emeter")


def pixel6_emeter_mean(ana):
    return ana.load(
        "pixel6_emeter_mean", postprocess=lambda df: roll_up_channels(df, ["tag", "kernel", "iteration"], "power")
    )


def overutilized(ana):
    return ana.load("overutilized", postprocess=lambda df: df.withColumns(
        {"time": F.round("time", 2), "total_time": F.round("total_time", 2)}
    ))


def overutilized_mean(ana):
    return ana.load("overutilized_mean")


def freqs_mean(ana):
    return ana.load("freqs_mean", postprocess=lambda df: df.withColumnRenamed("frequency", "value").withColumns({
        "unit": F.lit("MHz"), "metric": F.lit("frequency"), "order": ana.options.cluster_order("cluster"),
    }))


def thermal(ana):
    """Mean temperature in C per iteration; only the zones are scaled, not the time."""
    zones = list(ana.options.thermal_zones.values())

    def means(df):
        return df.groupBy("iteration", "kernel", "wa_path").agg(*[F.avg(c).alias(c) for c in ("Time", *zones)])

    def scaled(df):
        return df.withColumns({"Time": F.round("Time", 2), **{z: F.round(F.col(z) / 1000, 2) for z in zones}})

    return ana.load("thermal", preprocess=means, postprocess=scaled)


def thermal_melt(ana):
    return melt(ana.dataset("thermal"), ["iteration", "tag", "kernel"], ana.options.cluster_names, "cluster")


# Idle states

def idle_residency(ana):
    return ana.load("idle_residency").groupBy("tag", "cluster", "idle_state").agg(
        F.round(F.avg("time"), 2).alias("time")
    )


def cpu_idle(ana):
    return ana.load("cpu_idle")


def cpu_idle_miss_counts(ana):
    """Misses per cluster as a share of all wakeups of the run."""
    wakeups = ana.dataset("cpu_idle").groupBy("wa_path").agg(F.count_if(F.col("state") == -1).alias("wakeups"))

    def shares(df):
        totals = df.groupBy("wa_path", "kernel", "cluster", "below").agg(F.sum("count").alias("count"))
        share = F.round(F.try_divide("count", "wakeups") * 100, 3)
        return totals.join(wakeups, "wa_path", "left").withColumn("count_perc", share).drop("wakeups")

    return ana.load("cpu_idle_miss_counts", preprocess=shares, postprocess=lambda df: df.withColumns(
        {"type": miss_type("below"), "order": ana.options.cluster_order("cluster")}
    ))


# Energy and load signals

def energy_estimate_mean(ana):
    return ana.load("energy_estimate_mean")


def energy_estimate_melt(ana):
    return melt(ana.dataset("energy_estimate_mean"), ["iteration", "tag"], ana.cluster_names_total, "cluster")


def sched_pelt_cfs_mean(ana):
    return ana.load("sched_pelt_cfs_mean")


def sched_pelt_cfs_melt(ana):
    return melt(ana.dataset("sched_pelt_cfs_mean"), ["iteration", "tag", "kernel", "cluster"], ["util", "load"])


# Wakeup latency

def wakeup_latency_mean(ana):
    return ana.load("wakeup_latency_mean", postprocess=lambda df: df.withColumnRenamed(
        "wakeup_latency", "value"
    ).withColumns({"order": ana.order(), "unit": F.lit("x")}))


def wakeup_latency(ana):
    cluster_of, rank = ana.options.cluster_of, ana.options.cluster_order
    return ana.load("wakeup_latency", postprocess=lambda df: df.withColumns({
        "order": ana.order(), "cluster": cluster_of("cpu"), "target_cluster": cluster_of("target_cpu"),
    }).withColumns({"order_cluster": rank("cluster"), "order_target_cluster": rank("target_cluster")}))


def wakeup_latency_quantiles(ana):
    keys = ["comm", "tag", "iteration"]
    found = quantiles(ana.dataset("wakeup_latency"), keys, "wakeup_latency", QUANTILES)
    return found.withColumn("order", ana.order())


def _latency_by(ana, cluster):
    return ana.dataset("wakeup_latency").groupBy("comm", "tag", cluster).agg(
        mean_of_seconds("wakeup_latency", "wakeup_latency")
    )


def wakeup_latency_execution_cluster(ana):
    return _latency_by(ana, "cluster")


def wakeup_latency_target_cluster(ana):
    return _latency_by(ana, "target_cluster")


def wakeup_latency_cgroup(ana):
    return ana.load("wakeup_latency_cgroup", postprocess=lambda df: df.withColumnRenamed(
        "wakeup_latency", "value"
    ).withColumn("order", ana.order()))


def wakeup_latency_cgroup_mean(ana):
    return ana.dataset("wakeup_latency_cgroup").groupBy("tag", "cgroup", "iteration", "order").agg(
        mean_of_seconds("value", "value")
    )


def wakeup_latency_cgroup_quantiles(ana):
    keys = ["cgroup", "tag", "iteration"]
    found = quantiles(ana.dataset("wakeup_latency_cgroup"), keys, "value", QUANTILES)
    return found.withColumn("order", ana.order())


# CPU residency of tasks and cgroups

def _total(df):
    return df.withColumnRenamed("Total", "total")


def _important(ana, df):
    return _total(df).filter(F.col("comm").isin(list(ana.options.tasks_of(ana.label))))


def tasks_residency_cpu_total(ana):
    return ana.load("tasks_residency_cpu_total", postprocess=_total)


def tasks_residency_cpu_total_melt(ana):
    return melt(ana.dataset("tasks_residency_cpu_total"), ["iteration", "tag", "kernel"], ana.cpu_columns, "cpu")


def tasks_residency_cpu_total_cluster_melt(ana):
    ids = ["iteration", "tag", "kernel"]
    return melt(ana.dataset("tasks_residency_cpu_total"), ids, ana.cluster_names_total, "cluster")


def tasks_residency_total(ana):
    return ana.load("tasks_residency_total", postprocess=lambda df: _important(ana, df))


def tasks_residency_total_melt(ana):
    return melt(ana.dataset("tasks_residency_total"), ["iteration", "tag", "kernel", "comm"], ana.cpu_columns, "cpu")


def tasks_residency_total_cluster_melt(ana):
    ids = ["iteration", "tag", "kernel", "comm"]
    return melt(ana.dataset("tasks_residency_total"), ids, ana.cluster_names_total, "cluster")


def tasks_residency(ana):
    return ana.load("tasks_residency", postprocess=lambda df: _important(ana, df))


def tasks_residency_cluster_melt(ana):
    ids = ["iteration", "tag", "kernel", "comm"]
    return melt(ana.dataset("tasks_residency"), ids, ana.cluster_names_total, "cluster")


def tasks_residency_cgroup_total(ana):
    columns = ["tag", "cgroup", "iteration", *ana.cluster_names_total, *ana.cpu_columns]
    return ana.load("tasks_residency_cgroup_total", postprocess=lambda df: _total(df).select(*columns))


def cgroup_residency_total_melt(ana):
    return melt(ana.dataset("tasks_residency_cgroup_total"), ["iteration", "tag", "cgroup"], ana.cpu_columns, "cpu")


def cgroup_residency_total_cluster_melt(ana):
    ids = ["iteration", "tag", "cgroup"]
    return melt(ana.dataset("tasks_residency_cgroup_total"), ids, ana.cluster_names_total, "cluster")


# Activations, clamps, frames, capacity

def task_activations_stats_cluster(ana):
    return ana.load("task_activations_stats_cluster")


def task_activations_stats_cluster_melt(ana):
    ids = ["kernel", "tag", "iteration", "cluster", "comm"]
    return melt(ana.dataset("task_activations_stats_cluster"), ids, ["count", "duration"])


def task_activations(ana):
    return ana.load("task_activations")


def uclamp_updates(ana):
    updates = ana.load("uclamp_updates", allow_missing=True)
    return updates.filter(F.col("task") != UNKNOWN) if "task" in updates.columns else updates


def fps(ana):
    return ana.load("fps", allow_missing=True)


def frame_target_counts(ana, target_fps: float = TARGET_FPS):
    """Frames per iteration that did and did not meet the target time."""
    met = F.col("render_time") < 1000.0 / target_fps
    return ana.dataset("fps").withColumn("on_target", met).groupBy("tag", "iteration", "on_target").agg(
        F.count("ts").alias("count")
    )


def capacity(ana):
    return ana.load("capacity", allow_missing=True)


_MADE = (
    results, results_perf, jankbench, jb_max_frame_duration, jb_mean_frame_duration, jankbench_percs,
    adpf, adpf_totals, adpf_totals_melt, ds_adpf, pixel6_emeter, pixel6_emeter_mean, overutilized, overutilized_mean,
    freqs_mean, thermal, thermal_melt, idle_residency, cpu_idle, cpu_idle_miss_counts, energy_estimate_mean,
    energy_estimate_melt, sched_pelt_cfs_mean, sched_pelt_cfs_melt, wakeup_latency_mean, wakeup_latency,
    wakeup_latency_quantiles, wakeup_latency_execution_cluster, wakeup_latency_target_cluster,
    wakeup_latency_cgroup, wakeup_latency_cgroup_mean, wakeup_latency_cgroup_quantiles, tasks_residency_cpu_total,
    tasks_residency_cpu_total_melt, tasks_residency_cpu_total_cluster_melt, tasks_residency_total,
    tasks_residency_total_melt, tasks_residency_total_cluster_melt, tasks_residency, tasks_residency_cluster_melt,
    tasks_residency_cgroup_total, cgroup_residency_total_melt, cgroup_residency_total_cluster_melt,
    task_activations_stats_cluster, task_activations_stats_cluster_melt, task_activations, uclamp_updates, fps,
    frame_target_counts, capacity,
)
LOADERS: dict[str, Callable[[Analysis], DataFrame]] = {make.__name__: make for make in _MADE}
