"""The event store: same rows as without it, no exchange of events before windows, slices of equal counts also in bursts."""

import math
import re

import pytest
from pyspark.sql import functions as F

from runweave.operators import sweep
from runweave.operators.ordered import with_slice
from runweave.plans import adapter, metrics
from runweave.sources.store import open_store, write_store
from runweave.trace import RUN_KEYS, SLICE
from tests.side_by_side import difference

SF = "/root/testdata/sf0.001"
PLAIN = adapter.OPTIONS.overridden({"sliced": False})
CUT = adapter.OPTIONS.overridden({"rows_per_slice": 9})


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    write_store(adapter.trace(spark, SF, CUT), folder, 4)
    return open_store(spark, folder, CUT, 2 * adapter.ITERATIONS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in metrics.DATASETS if n not in ("adpf", "adpf_totals", "thermal")])
def test_same_rows(spark, stored, name):
    make = metrics.DATASETS[name]
    want = make(adapter.trace(spark, SF, PLAIN)).toPandas()
    assert len(want) and difference(make(stored).toPandas().round(9), want.round(9)) is None


@pytest.mark.parametrize("name", ("tasks_residency_total", "idle_residency", "freqs_residency"))
def test_one_scan_and_no_exchange_before_the_window(stored, name):
    plan = plan_of(metrics.DATASETS[name](stored))
    assert len(re.findall(r"FileScan parquet \S*_timeline", plan)) == 1 and plan.count("_timeline") == 1
    below = plan[plan.index("Window"):plan.index("FileScan parquet spark_catalog")]
    assert "Exchange hashpartitioning" not in below


@pytest.mark.parametrize("name", ("perf_counters", "overutilized", "energy_estimate"))
def test_events_stay_where_they_are(stored, name):
    """Whatever is exchanged is one row a piece: events are never below an exchange without an aggregate between."""
    lines = plan_of(metrics.DATASETS[name](stored)).splitlines()
    for i, line in enumerate(lines):
        if "FileScan parquet spark_catalog" in line:
            depth = lambda x: len(re.match(r"[\s:+-]*", x).group())
            at = depth(line)
            for above in reversed(lines[:i]):
                if depth(above) < at:
                    at = depth(above)
                    if "Aggregate" in above:
                        break
                    assert "Exchange" not in above


def test_all_totals_from_one_scan(stored):
    plan = plan_of(sweep.totals(stored))
    assert plan.count("_timeline") == 1 and plan.count("Window [") <= 2


def test_store_opens_in_a_session_that_does_not_know_it(spark, tmp_path):
    write_store(adapter.trace(spark, SF, CUT), str(tmp_path), 2)
    for table in spark.catalog.listTables():
        if table.name.startswith("store_"):
            spark.sql(f"DROP TABLE {table.name}")
    again = open_store(spark, str(tmp_path), CUT)
    want = metrics.idle_residency(adapter.trace(spark, SF, PLAIN)).toPandas()
    assert difference(metrics.idle_residency(again).toPandas().round(9), want.round(9)) is None


def test_unfinished_store_cannot_be_opened(spark, tmp_path):
    trace = adapter.trace(spark, SF, CUT)
    trace.slices.write.parquet(f"{tmp_path}/slices")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        open_store(spark, str(tmp_path), CUT)


def test_cpu_of_no_cluster_counts_in_totals_only(spark, tmp_path):
    fewer = CUT.overridden({"clusters": {"little": (0, 1, 2, 3), "mid": (4, 5)}})
    write_store(adapter.trace(spark, SF, fewer), str(tmp_path), 2)
    got = open_store(spark, str(tmp_path), fewer)
    plain = adapter.trace(spark, SF, fewer.overridden({"sliced": False}))
    for make in (metrics.tasks_residency, metrics.idle_residency, metrics.freqs_residency):
        assert difference(make(got).toPandas().round(9), make(plain).toPandas().round(9)) is None


def test_a_burst_gives_no_large_slice(spark):
    options = adapter.OPTIONS.overridden({"rows_per_slice": 20})
    trace = adapter.burst_trace(spark, "/root/testdata/sf0.01", options)
    sizes = trace.cut(trace.event("sched_switch")).groupBy(*RUN_KEYS, SLICE).count()
    most, slices = sizes.agg(F.max("count"), F.count("*")).first()
    assert most <= 40 and slices >= 10_000 / 40


def test_a_query_writes_the_tables_it_reads(spark):
    """Others are laid out when they are asked for, in the same slices and as many buckets."""
    options = adapter.OPTIONS.overridden({"rows_per_slice": 11})
    first = adapter.stored_trace(spark, SF, ["sched_overutilized"], options)
    assert set(first.tables) == {"sched_overutilized"} and "timeline" not in first.prepared
    for _ in range(2):
        later = adapter.stored_trace(spark, SF, ["timeline", "perf_counter"], options)
        assert set(later.tables) == {"sched_overutilized", "perf_counter"} and "timeline" in later.prepared
    plain = adapter.trace(spark, SF, PLAIN)
    for make in (metrics.overutilized, metrics.perf_counters, metrics.idle_residency, metrics.tasks_residency_total):
        assert difference(make(later).toPandas().round(9), make(plain).toPandas().round(9)) is None


def test_slices_are_found_by_compiled_code(spark):
    """No array of borders is copied for a row: its cost does not grow with the number of slices."""
    plan = plan_of(adapter.trace(spark, SF, CUT).cut(adapter.base_events(spark, SF)))
    assert "lambda" not in plan and plan.count("BroadcastHashJoin") == 1


def test_with_slice(spark):
    rows = [([], 5), (None, 5), ([3], 2), ([3], 3), ([3], None), *((list(range(0, 2 * n, 2)), t) for n in (2, 7, 8, 1023) for t in (-1, 0, 1, n, 2 * n - 3, 2 * n - 2, 2 * n))]
    df = spark.createDataFrame(rows, "borders array<bigint>, t bigint")
    got = with_slice(df, "s", "borders", "t").collect()
    assert [r["s"] for r in got] == [0 if t is None else sum(b <= t for b in borders or []) for borders, t in rows]


def test_steps_of_a_slice_are_small_as_one_expression(spark):
    """Where a join's key holds the slice, the optimizer puts each step in place of its name in the next one."""
    df = with_slice(spark.createDataFrame([([3], 2)], "borders array<bigint>, t bigint"), "s", "borders", "t")
    steps = re.findall(r"Project \[(.*) AS s#\d+\]", df._jdf.queryExecution().analyzed().toString())
    assert len(steps) > 10 and math.prod(max(1, len(re.findall(r"\bs#\d+", step))) for step in steps) <= 2 ** len(steps)
