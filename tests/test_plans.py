"""What the physical plans must and must not hold."""

import re

import pytest

from runweave.plans import adapter, catalogue, metrics

SF = "/root/testdata/sf0.001"
SLICED = adapter.OPTIONS


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Every metric and step, and one view or dataset of each form.
CHECKED = [n for n in catalogue.QUERIES if not n.startswith(("runs_", "view_"))] + [
    "runs_adpf", "runs_pixel6_emeter_mean", "runs_thermal_melt", "runs_cpu_idle_miss_counts",
    "runs_wakeup_latency_quantiles", "view_jankbench_mean_frame_durations_bar", "view_jankbench_frame_durations_hist",
    "view_jankbench_frame_durations_ecdf", "view_drarm_adpf_metric_line", "view_tasks_cpu_residency_per_task_bar",
    "view_summary",
]


@pytest.mark.parametrize("name", CHECKED)
def test_no_python_and_no_all_pairs(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    for bad in ("EvalPython", "PythonUDF", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, f"{bad} in {name}"
    assert "Exchange SinglePartition, ENSURE" not in text or name in ONE_ROW, name


# One row of bounds, or one row per run: aggregated before they meet.
ONE_ROW = {"step_near_equal_test", "view_jankbench_frame_durations_hist", "view_jankbench_mean_frame_durations_bar", "view_summary"}


def test_summary_is_one_comparison(spark):
    """Eight blocks share one aggregation and one test: it was 101 exchanges by keys with a comparison for each."""
    text = plan(catalogue.QUERIES["view_summary"](spark, SF))
    assert text.count("Exchange hashpartitioning") <= 60


@pytest.mark.parametrize("name", ["tasks_residency", "wakeup_latency", "energy_estimate", "idle_residency", "fps"])
def test_sliced_windows_hold_a_slice(spark, name):
    trace = adapter.trace(spark, SF, SLICED)
    text = plan(metrics.DATASETS[name](trace))
    shuffled = re.findall(r"hashpartitioning\(([^)]*)\)", text)
    assert any("_piece" in keys for keys in shuffled)


def test_borders_of_intervals_need_no_sort(spark):
    """What neighbouring slices need of an interval's start is a hash aggregate."""
    assert "SortAggregate" not in plan(metrics.tasks_residency(adapter.trace(spark, SF, SLICED)))


def test_only_small_sides_are_broadcast(spark):
    """Hinted sides are settings, the run list and the windows, all of a known number of rows."""
    hinted = re.compile(r"strategy=broadcast")
    for name in ("uclamp_updates", "wakeup_latency_cgroup", "tasks_residency_cgroup"):
        df = metrics.DATASETS[name](adapter.trace(spark, SF))
        logical = df._jdf.queryExecution().analyzed().toString()
        for i in [m.start() for m in hinted.finditer(logical)]:
            assert re.search(r"LocalRelation|min\(t_ns|kernel|label|borders", logical[i:i + 900])


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(metrics.cgroup_attach_task(adapter.trace(spark, SF)))
    assert "EqualTo(event_type,error)" in text
    assert "props" not in text.split("ReadSchema")[1]
