"""From run directories to datasets and comparisons, with results worked out by hand."""

from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from runweave import Options
from runweave.config import energy_model
from runweave.errors import MissingConfig, MissingEvent, MissingRuns, RunweaveError
from runweave.plans import datasets, metrics, views
from runweave.sources import quality, scan, sink
from tests.rundirs import RUN_A, RUN_B, write_job, write_runs

MODEL = energy_model({
    name: {"opp": {500_000: {"capacity": 100, "power": 10 * k}, 700_000: {"capacity": 150, "power": 15 * k},
                   900_000: {"capacity": 200, "power": 30 * k}}, "idle": {0: 2 * k, 1: 1 * k}}
    for k, name in ((1, "little"), (2, "mid"), (3, "big"))
})


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    path = tmp_path_factory.mktemp("runs")
    write_runs(path)
    (path / RUN_A / "wk1-speedometer-2" / "trace-events" / "perf_counter.pq").write_bytes(b"not parquet")
    return path


@pytest.fixture(scope="module")
def runs(spark, root):
    return scan.list_runs(spark, str(root), [RUN_A, RUN_B])


@pytest.fixture(scope="module")
def trace(spark, runs):
    return scan.scan_trace(spark, runs, Options().overridden(MODEL), {RUN_A: "6.1"}, skip_unreadable=True)


def rows(df, run=RUN_A, iteration=1, **where):
    for column, value in {"wa_path": run, "iteration": iteration, **where}.items():
        df = df.filter(df[column] == value)
    return df.collect()


def one(df, *columns, **where):
    found = rows(df, **where)
    assert len(found) == 1, found
    return tuple(found[0][c] for c in columns)


def test_manifest(trace, runs):
    listed = {r.wa_path: (r.kernel, r.label, r.tag) for r in trace.runs.collect()}
    assert listed == {RUN_A: ("6.1", "speedometer", "base"), RUN_B: ("<unknown>", "speedometer", "new_idea")}
    assert trace.iterations == 4
    assert set(trace.tables) >= {"pixel6_emeter", "sched_switch", "frames", "thermal", "adpf"}


def test_absent_runs(spark, root, tmp_path):
    with pytest.raises(MissingRuns):
        scan.list_runs(spark, str(tmp_path / "nowhere"))
    with pytest.raises(MissingRuns):
        scan.list_runs(spark, str(root), [RUN_A, "speedometer_gone_2_0101"])


def test_window(trace):
    assert one(trace.windows, "start_ns", "end_ns") == (10 * 10**9, 20 * 10**9)


def test_residency(trace):
    out = metrics.tasks_residency(trace)
    # cpu 0: pid 1 10-12 and 15-18, pid 2 12-15, pid 0 18-20; cpu 4: pid 3 16-20
    assert one(out, "cpu0", "little", "Total", pid=1) == (5.0, 5.0, 5.0)
    assert one(out, "comm", "cpu0", pid=2) == ("a:b", 3.0)
    assert one(out, "cpu4", "mid", "cpu0", pid=3) == (4.0, 4.0, 0.0)
    assert one(metrics.tasks_residency_cpu_total(trace), "Total", "cpu0") == (12.0, 8.0)
    assert one(metrics.tasks_residency_total(trace), "Total", comm="swapper/0") == (2.0,)


def test_idle(trace):
    out = metrics.idle_residency(trace)
    assert one(out, "time", cluster="mid", idle_state=0) == (1.0,)
    assert one(out, "time", cluster="mid", idle_state=1) == (1.0,)
    assert [r.state for r in rows(metrics.cpu_idle(trace), cpu=4)].count(-1) == 1
    counts = {(r.cluster, r.below): r["count"] for r in rows(metrics.cpu_idle_miss_counts(trace))}
    assert counts == {("mid", 0): 1, ("mid", 1): 2}


def test_frequency(trace):
    out = metrics.freqs_residency(trace)
    # first cpu of mid: 500 MHz 10-13, 900 MHz 13-20; no CPU of it awake from 12 to 14
    assert one(out, "total_time", "active_time", frequency=500_000) == (3.0, 2.0)
    assert one(out, "total_time", "active_time", frequency=900_000) == (7.0, 6.0)
    assert one(metrics.freqs_mean(trace), "frequency", cluster="mid") == (pytest.approx(1900 / 3),)


def test_overutilized(trace):
    assert one(metrics.overutilized(trace), "time", "total_time", "percentage") == (2.5, 10.0, 25.0)


def test_power(trace):
    assert one(metrics.pixel6_emeter(trace), "power", channel="CPU(big)") == (2000.0,)
    assert one(metrics.pixel6_emeter_mean(trace), "power", channel="GPU") == (500.0,)


def test_energy(trace):
    out = sorted((r.Time, r.cpu4, r.cpu5, r.total) for r in rows(metrics.energy_estimate(trace)))
    # mid: awake 500 MHz 20, 700 MHz 30, 900 MHz 60; idle state 0 4, state 1 2
    # the second 500 MHz event starts a span of the same power
    assert out == [
        (10.0, 20.0, 30.0, 50.0), (11.0, 2.0, 30.0, 32.0), (12.0, 2.0, 4.0, 6.0), (13.0, 2.0, 2.0, 4.0),
        (14.0, 60.0, 2.0, 62.0),
    ]


def test_latency(trace):
    # of the wakeups at 13 and 14 the last counts; pid 3's at 19 is never followed
    found = rows(metrics.wakeup_latency(trace))
    assert [(r.pid, r.wakeup_latency, r.cpu, r.target_cpu) for r in found] == [(1, 1.0, 0, 5)]
    by_cgroup = rows(metrics.wakeup_latency_cgroup(trace))
    assert sorted(r.cgroup for r in by_cgroup) == ["background", "foreground"]


def test_activations(trace):
    found = sorted((r.Time, r.active, r.duration, r.duty_cycle) for r in rows(metrics.task_activations(trace), pid=1))
    assert found == [(10.0, 1.0, 2.0, 0.4), (12.0, 0.0, 3.0, None), (15.0, 1.0, 3.0, None), (18.0, 0.0, 2.0, None)]
    stats = metrics.task_activations_stats_cluster(trace)
    assert one(stats, "count", "duration", comm="CrGpuMain") == (2, 5.0)
    # the length of a name with a colon is not cut, and it is not in the task list
    assert rows(metrics.task_activations(trace), pid=2) == []


def test_cgroup_residency(trace):
    out = metrics.tasks_residency_cgroup(trace)
    assert one(out, "Total", "comm", cgroup="background") == (5.0, "CrGpuMain")
    assert one(metrics.tasks_residency_cgroup_total(trace), "Total", cgroup="foreground") == (5.0,)
    assert len(rows(metrics.cgroup_attach_task(trace))) == 4


def test_clamps_capacity_load(trace):
    out = {r.pid: (r.task, r.time_it) for r in rows(metrics.uclamp_updates(trace))}
    assert out == {1: ("CrGpuMain", 1.0), 77: ("<unknown>", 2.0)}
    assert one(metrics.capacity(trace), "capacity", "time_it", cpu=6) == (900, 2.0)
    assert one(metrics.sched_pelt_cfs_mean(trace), "load", "util") == (20.0, 30.0)


def test_counters(trace):
    out = {(r.variable, r.Time): r.value for r in rows(metrics.perf_counters(trace))}
    assert out == {
        ("CPU_CYCLES-Total", 12.0): 150, ("CPU_CYCLES", 12.0): 50,
        ("CPU_CYCLES-Total", 13.0): 170, ("CPU_CYCLES", 13.0): 20,
    }


def test_side_files(trace):
    frames = sorted((r.ts, r.ts_iter, r.render_time, r.render_ready_time) for r in rows(metrics.fps(trace)))
    assert frames == [(0.13, 0.03, 30.0, 20.0), (0.18, 0.08, 50.0, 50.0)]
    assert one(metrics.adpf_totals(trace), "average fps", "frame count") == (40.0, 45.0)
    assert sorted((r.Time, r.big, r.little) for r in rows(metrics.thermal(trace))) == [
        (1.0, 50000, 30000), (2.0, 52000, 32000)
    ]


def test_unknown_counter(trace, spark, runs):
    few = scan.scan_trace(
        spark, runs, Options().overridden({"perf_counter_ids": {8: "INST_RETIRED"}}), skip_unreadable=True
    )
    with pytest.raises(PySparkException, match="unknown counter id 17"):
        metrics.perf_counters(few).collect()
    lenient = scan.scan_trace(
        spark, runs, Options().overridden({"perf_counter_ids": {8: "INST_RETIRED"}, "allow_missing": True}),
        skip_unreadable=True,
    )
    assert metrics.perf_counters(lenient).collect() == []


def test_needed_settings(trace, spark, runs):
    bare = scan.scan_trace(spark, runs)
    with pytest.raises(MissingConfig):
        metrics.energy_estimate(bare)
    with pytest.raises(MissingEvent):
        trace.event("thermal_exynos")


def test_quality(spark, runs, trace):
    unread = quality.unread_files(runs, trace).select("wa_path", "iteration", "event").collect()
    assert [tuple(r) for r in unread] == [(RUN_A, 2, "perf_counter")]
    found = runs.files.filter("event is not null")
    missing = quality.missing_events(runs.iterations, found, ("cpu_idle", "task_rename")).collect()
    assert sorted({(r.event) for r in missing}) == ["task_rename"] and len(missing) == 4
    lost = quality.missing_iterations(runs.iterations, metrics.perf_counters(trace)).collect()
    assert [tuple(r) for r in lost] == [(RUN_A, 2)]
    checks = quality.time_checks(trace.event("sched_switch"))
    assert one(checks, "without_time", "out_of_order") == (0, 0)
    assert one(quality.time_checks(trace.event("cpu_frequency")), "out_of_order") == (1,)


def test_unique_times(trace):
    frequency = scan.unique_times(trace.event("cpu_frequency"))
    assert sorted(r.t_ns for r in rows(frequency)) == [10 * 10**9, 10 * 10**9 + 1, 12 * 10**9, 13 * 10**9]
    again = scan.unique_times(
        trace.event("cpu_frequency"), Options().overridden({"rows_per_slice": 1})
    )
    assert sorted(r.t_ns for r in rows(again)) == sorted(r.t_ns for r in rows(frequency))


def test_rewritten_events(trace, tmp_path):
    scan.write_events(trace, str(tmp_path / "events"))
    moved = scan.with_events_at(trace, str(tmp_path / "events"))
    assert one(metrics.tasks_residency(moved), "Total", pid=1) == (5.0,)


def test_written_metrics(spark, trace, runs, root, tmp_path):
    out, stage = str(tmp_path / "out"), str(tmp_path / "stage")
    failed = metrics.run_metrics(trace, out, stage=stage)
    assert failed == {}
    with pytest.raises(RunweaveError):
        metrics.run_metrics(trace, out, ["nonsense"])
    before = sink.read_dataset(spark, out, "tasks_residency").count()

    # A rerun of one run replaces that run only.
    only_b = scan.scan_trace(spark, scan.list_runs(spark, str(root), [RUN_B]))
    failed = metrics.run_metrics(only_b, out, ["tasks-residency", "energy-estimate"])
    assert list(failed) == ["energy-estimate"]
    assert sink.read_dataset(spark, out, "tasks_residency").count() == before

    ana = datasets.of_store(spark, out, trace.runs, ["base", "new_idea"], "speedometer", trace.options)
    bars = views.tasks_cpu_residency_cluster_bar(ana).filter("cluster = 'little'").collect()
    found = {r.tag: (r.value, r.perc_diff, r.n) for r in bars}
    # the new run's tasks get the same time on cpu 0, split otherwise
    assert found == {"base": (8.0, 0.0, 2), "new_idea": (8.0, 0.0, 2)}
    task = views.tasks_cpu_residency_per_task_bar(ana).filter("cluster = 'total' and comm = 'CrGpuMain'").collect()
    assert {r.tag: (r.value, round(r.perc_diff, 6)) for r in task} == {"base": (5.0, 0.0), "new_idea": (6.0, 20.0)}
    with pytest.raises(MissingEvent):
        ana.load("never_written")
    assert ana.load("never_written", allow_missing=True).collect() == []
    hooked = ana.load("overutilized", preprocess=lambda d: d.filter("iteration = 1"),
                      postprocess=lambda d: d.select("tag", "time"))
    assert sorted(map(tuple, hooked.collect())) == [("base", 2.5), ("new_idea", 2.5)]


def test_failed_metric_does_not_stop_others(spark, tmp_path):
    job = write_job(tmp_path, "other_tag_1_0101", 1)
    for name in ("perf_counter", "cpu_idle"):
        (job / "trace-events" / f"{name}.pq").unlink()
    labelled = tmp_path / "runs" / "other_tag_1_0101"
    labelled.mkdir(parents=True)
    (tmp_path / "other_tag_1_0101" / "wk1-speedometer-1").rename(labelled / "wk1-mystery-1")
    trace = scan.scan_trace(spark, scan.list_runs(spark, str(tmp_path / "runs")))
    failed = metrics.run_metrics(
        trace, str(tmp_path / "out"), ["perf-trace-event", "wakeup-latency", "idle", "thermal"]
    )
    assert sorted(failed) == ["idle", "perf-trace-event", "wakeup-latency"]
    assert sink.read_dataset(spark, str(tmp_path / "out"), "thermal").count() == 2


def test_unreadable_file_is_an_error(spark, runs):
    strict = scan.scan_trace(spark, runs, Options().overridden(MODEL))
    with pytest.raises(Exception, match="perf_counter"):
        strict.event("perf_counter").collect()


def test_rerun_without_rows_leaves_nothing_stale(spark, trace, tmp_path):
    out = str(tmp_path)
    assert metrics.run_metrics(trace, out, ["overutil"]) == {}
    assert sink.read_dataset(spark, out, "overutilized").count() > 0
    gone = replace(trace, tables={**trace.tables, "sched_overutilized": trace.event("sched_overutilized").limit(0)})
    assert list(metrics.run_metrics(gone, out, ["overutil", "thermal"])) == ["overutil"]
    assert sink.read_dataset(spark, out, "overutilized") is None
    # Spark's own errors stop the metric they belong to only
    few = replace(trace, options=trace.options.overridden({"perf_counter_ids": {8: "INST_RETIRED"}}))
    assert list(metrics.run_metrics(few, out, ["perf-trace-event", "thermal"])) == ["perf-trace-event"]
    assert sink.read_dataset(spark, out, "thermal").count() > 0


def test_readers_see_all_of_a_rerun_or_nothing(spark, tmp_path):
    out = str(tmp_path)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "wa_path string, v int")

    def read():
        return sorted(map(tuple, sink.read_dataset(spark, out, "d").select("wa_path", "v").collect()))

    assert sink.read_dataset(spark, out, "d") is None
    assert sink.write_dataset(rows, out, "d", runs=["a", "b", "c"]) == {"a": 2, "b": 1, "c": 0}
    early = sink.read_dataset(spark, out, "d").select("wa_path", "v")
    # a rerun that fails after some of its rows are written
    with pytest.raises(PySparkException):
        sink.write_dataset(rows.withColumn("v", F.expr("if(v = 3, raise_error('broken'), v + 10)")), out, "d", runs=["a", "b"])
    assert read() == [("a", 1), ("a", 2), ("b", 3)]
    # one that ends replaces its runs only; a table opened before still has its rows
    assert sink.write_dataset(rows.filter("wa_path = 'a'").withColumn("v", F.col("v") + 10), out, "d", runs=["a"]) == {"a": 2}
    assert read() == [("a", 11), ("a", 12), ("b", 3)]
    assert sorted(map(tuple, early.collect())) == [("a", 1), ("a", 2), ("b", 3)]
    assert sink.replaced_versions(spark, out, "d").count() == 0  # run b still stands in the first
    assert sink.write_dataset(rows.limit(0), out, "d", runs=["a", "b"]) == {"a": 0, "b": 0}
    assert sink.read_dataset(spark, out, "d") is None and sink.replaced_versions(spark, out, "d").count() == 2
    sink.write_dataset(rows.filter("v = 3"), out, "d", gather=False)
    assert read() == [("b", 3)]
    assert [r.v for r in sink.read_dataset(spark, out, "d", ["b", "z"]).collect()] == [3] and sink.read_dataset(spark, out, "d", ["z"]) is None


def test_store_gives_the_runs_asked_for(spark, trace, tmp_path):
    out = str(tmp_path)
    metrics.run_metrics(trace, out, ["thermal"])
    other = sink.read_dataset(spark, out, "thermal").filter(F.col("wa_path") == RUN_A).toPandas().assign(wa_path="other_base_2_0101")
    sink.write_dataset(spark.createDataFrame(other), out, "thermal")
    ana = datasets.of_store(spark, out, trace.runs, ["base", "new_idea"], "speedometer", trace.options)
    assert {r.wa_path for r in ana.load("thermal").collect()} == {RUN_A, RUN_B}


def test_side_file_with_another_header(spark, tmp_path):
    write_job(tmp_path, RUN_A, 1)
    job = write_job(tmp_path, RUN_B, 1)
    (job / "poller-output.csv").write_text("thermal_zone2-temp,time,thermal_zone1-temp,thermal_zone0-temp\n30000,1.0,40000,50000\n")
    trace = scan.scan_trace(spark, scan.list_runs(spark, str(tmp_path), [RUN_A, RUN_B]))
    with pytest.raises(Exception, match="header|HEADER"):
        metrics.thermal(trace).collect()


def test_kernel_of_the_run_itself(spark, tmp_path):
    write_job(tmp_path, RUN_A, 1)
    write_job(tmp_path, RUN_B, 1)
    (tmp_path / RUN_A / "__meta").mkdir()
    (tmp_path / RUN_A / "__meta" / "target_info.json").write_text('{"kernel_version": {"release": "6.6.1-x"}}')
    listed = scan.list_runs(spark, str(tmp_path), [RUN_A, RUN_B])
    assert {r.wa_path: r.kernel for r in scan.runs_table(spark, listed).collect()} == {RUN_A: "6.6.1-x", RUN_B: "<unknown>"}


def test_largest_total_first(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 9.0)], "iteration int, Total double")
    assert [tuple(r) for r in metrics.sort_by_total(df, "iteration").collect()] == [(1, 5.0), (1, 2.0), (2, 9.0)]


def test_results_of_several_runs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("wa_path,iteration,metric,value\nw_a_1_0101,1,score,10\n")
    (tmp_path / "b.csv").write_text("wa_path,iteration,metric,value,unit\nw_b_1_0101,1,score,0,ms\n")
    table = scan.read_results(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted((r.wa_path, r.value, r.unit) for r in table.collect()) == [
        ("w_a_1_0101", 10.0, None), ("w_b_1_0101", 0.0, "ms")
    ]
    with pytest.raises(MissingRuns):
        scan.read_results(spark, [])


def results_below(path):
    for run, head, rows in (
        ("wl_one_1_0101", "iteration,metric,value,unit", ["1,score,10,x", "2,score,11,x"]),
        ("wl_two_1_0101", 'metric,"value",iteration,wa_path', ["score,20,1,wl_two_1_0101"]),
    ):
        job = path / "runs" / run / "wk1-wl-1" / "trace-events"
        job.mkdir(parents=True)
        (job.parent / "other.csv").write_text("a\n1\n")
        (path / "runs" / run / "results.csv").write_text("\n".join([head, *rows]) + "\n")
        frames = path / "runs" / run / "wk1-wl-1" / ("jankbench.csv" if "one" in run else "jankbench_2.csv")
        frames.write_text("variable,value,extra\njank_frame,1,z\n" if "one" in run else "value,variable\n16.5,total_duration\n")
    return scan.Runs(str(path / "runs"), ["wl_one_1_0101", "wl_two_1_0101"], None, None)


def test_results_and_frames_by_listing(spark, tmp_path):
    runs = results_below(tmp_path)
    found = scan.read_results(spark, runs)
    assert sorted((r.wa_path, r.iteration, r.metric, r.value, r.unit) for r in found.collect()) == [
        ("wl_one_1_0101", 1, "score", 10.0, "x"), ("wl_one_1_0101", 2, "score", 11.0, "x"), ("wl_two_1_0101", 1, "score", 20.0, None)]
    frames = scan.read_frames(spark, runs)
    assert sorted(map(tuple, frames.collect())) == [("wl_one_1_0101", 1, "jank_frame", 1.0), ("wl_two_1_0101", 1, "total_duration", 16.5)]


def test_results_in_columns_and_lines(spark, tmp_path):
    runs = results_below(tmp_path)
    spark.range(1).selectExpr("'fps' as metric", "3 as value", "7 as iteration").toPandas().to_parquet(tmp_path / "runs" / "wl_two_1_0101" / "results_2.pqt")
    found = scan.read_results(spark, runs).filter("metric = 'fps'").collect()
    assert [(r.wa_path, r.iteration, r.value) for r in found] == [("wl_two_1_0101", 7, 3.0)]


def test_file_without_header_is_an_error(spark, tmp_path):
    runs = results_below(tmp_path)
    (tmp_path / "runs" / "wl_one_1_0101" / "results_3.csv").write_text("1,2\n")
    with pytest.raises(MissingRuns, match="no header"):
        scan.read_results(spark, runs)
    with pytest.raises(MissingRuns):
        scan.read_frames(spark, scan.Runs(str(tmp_path / "runs"), ["wl_one_1_0101/wk1-wl-1/trace-events"], None, None))
