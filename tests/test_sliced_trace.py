"""Datasets that need an order are the same with and without time slices, also when one task has a third of the events."""

import pytest
from pyspark.sql import functions as F

from runweave.plans import adapter, metrics, views
from tests.side_by_side import difference

SF = "/root/testdata/sf0.001"
PLAIN = adapter.OPTIONS.overridden({"sliced": False})
SLICED = adapter.OPTIONS.overridden({"rows_per_slice": 7})


@pytest.fixture(scope="module")
def skewed_dir(spark, tmp_path_factory):
    """The given tables, with every third event moved to one user."""
    path = tmp_path_factory.mktemp("skewed")
    events = spark.read.parquet(f"{SF}/events.parquet")
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(4)).otherwise(F.col("user_id")).cast("long")
    events.withColumn("user_id", hot).write.parquet(f"{path}/events.parquet")
    for table in ("orders", "lineitem"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{path}/{table}.parquet")
    return str(path)


ORDERED = (
    "pixel6_emeter", "idle_residency", "freqs_residency", "overutilized", "wakeup_latency", "task_activations",
    "task_activations_stats", "perf_counters", "tasks_residency", "fps", "energy_estimate", "wakeup_latency_cgroup",
    "tasks_residency_cgroup",
)


@pytest.mark.parametrize("name", ORDERED)
def test_dataset(spark, skewed_dir, name):
    make = metrics.DATASETS[name]
    plain = make(adapter.trace(spark, skewed_dir, PLAIN))
    cut = adapter.trace(spark, skewed_dir, SLICED)
    assert difference(make(cut).toPandas().round(9), plain.toPandas().round(9)) is None


ACROSS = [
    (views.jankbench_frame_durations_ecdf, ()), (views.wakeup_latency_quantiles_bar, ()),
    (views.frequency_bar, ()), (views.perf_bar, ()), (views.drarm_adpf_metric_line, (("average fps",),)),
]


@pytest.mark.parametrize("name", ("idle_residency", "freqs_residency", "energy_estimate", "task_activations"))
def test_steps_kept_in_the_checkpoint_folder(spark, skewed_dir, tmp_path, name):
    make = metrics.DATASETS[name]
    want = make(adapter.trace(spark, skewed_dir, PLAIN)).toPandas()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    got = make(adapter.trace(spark, skewed_dir, SLICED))
    assert any(tmp_path.rglob("part-*"))
    assert difference(got.toPandas().round(9), want.round(9)) is None


@pytest.mark.parametrize("view,args", ACROSS, ids=[v.__name__ for v, _ in ACROSS])
def test_view(spark, skewed_dir, view, args):
    plain = view(adapter.analysis(spark, skewed_dir, PLAIN), *args)
    cut = view(adapter.analysis(spark, skewed_dir, SLICED), *args)
    keep = [c for c in plain.columns if not c.endswith("_label")]
    assert difference(cut.select(keep).toPandas().round(6), plain.select(keep).toPandas().round(6)) is None
