"""Some queries of each form against their SQL on the smallest tables.

All of them: ``python tests/side_by_side.py [directory]``.
"""

import pytest

import __spark_entry__ as entry_module
import oracle_queries
from runweave.plans import catalogue
from tests.side_by_side import connect, difference

SF = "/root/testdata/sf0.001"
NAMES = (
    "idle_residency", "freqs_residency", "wakeup_latency", "task_activations", "energy_estimate", "fps",
    "tasks_residency_cgroup", "uclamp_updates", "runs_adpf", "runs_wakeup_latency_quantiles",
    "view_jankbench_frame_durations_ecdf", "view_tasks_cpu_residency_per_task_bar", "view_frame_target_count_bar",
    "step_frame_test", "step_unique_times", "step_next_run", "step_nearest_change", "step_overlapping_runs", "step_burst_intervals",
)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    got = entry_module.queries()[name](spark, SF).toPandas()
    want = con.execute(entry_module.oracle_sql()[name]).fetchdf()
    assert len(got) and difference(got, want) is None


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(oracle_queries.all_queries())


def test_sql_is_of_known_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
