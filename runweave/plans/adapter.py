"""The given test tables read as traces, results and side files of two runs.

``events`` becomes the trace: users are tasks, each bound to a CPU; even users belong to the
baseline run and odd ones to the candidate; three days are an iteration. Every event table is a
filter and a projection of it, so work grows with ``events``. ``orders`` becomes the benchmark
results and ``lineitem`` the per-frame table.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.config import Options, local_table
from runweave.functions.text import run_tag, run_workload
from runweave.operators.ordered import shared_folder
from runweave.plans.datasets import Analysis, of_trace
from runweave.sources.schema import ADPF_COLUMNS
from runweave.sources.store import add_tables, open_store, write_store
from runweave.trace import RUN_KEYS, Tables, Trace

BASELINE = "synth_baseline_10_0101"
CANDIDATE = "synth_candidate_10_0101"
TAGS = ["baseline", "candidate"]
COMMS = ("swapper/0", "RenderThread", "surfaceflinger", "HwBinder:1", "GameThread", "writer")
CHANNELS = ("CPU(little)", "CPU(mid)", "CPU(big)", "GPU", "DDR", "Display")
COUNTERS = (17, 8, 27)
TARGET_FPS = 0.005  # frames are minutes apart: this puts the target in their midst
ITERATIONS = 11  # of each run: three-day steps of a month

OPP_STEPS = 8
OPTIONS = Options().overridden({
    "important_tasks": {"synth": ("RenderThread", "surfaceflinger", "HwBinder:1", "GameThread")},
    "opp": tuple(
        (cluster, 300_000 + 200_000 * step, 100.0 * (step + 1), base * (step + 1))
        for cluster, base in (("little", 20.0), ("mid", 60.0), ("big", 150.0))
        for step in range(OPP_STEPS)
    ),
    "idle_power": tuple(
        (cluster, state, base / (state + 1)) for cluster, base in (("little", 8.0), ("mid", 12.0), ("big", 24.0))
        for state in range(2)
    ),
    # small slices, so that the tables at hand are cut as large ones are
    "rows_per_slice": 500,
})

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with the keys of a trace; ``whole`` is the value's integer part, ``cents`` all of it."""
    names = ", ".join(f"'{c}'" for c in COMMS)
    return read(spark, sf_dir, "events").selectExpr(
        f"if(user_id % 2 = 0, '{BASELINE}', '{CANDIDATE}') as wa_path",
        "cast((day(ts) - 1) div 3 + 1 as int) as iteration",
        "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000 as t_ns",
        "event_id as seq",
        "cast((user_id div 2) % 8 as int) as cpu",
        "user_id as pid",
        f"array({names})[cast((user_id div 2) % {len(COMMS)} as int)] as comm",
        "event_type as type",
        "cast(floor(value) as bigint) as whole",
        "cast(round(value * 100) as bigint) as cents",
    )


def runs_table(spark: SparkSession) -> DataFrame:
    rows = [(BASELINE, "6.1.0-base", 0), (CANDIDATE, "6.1.0-new", 1)]
    return local_table(spark, rows, "wa_path string, kernel string, run_order int").select(
        "*", run_workload("wa_path").alias("label"), run_tag("wa_path").alias("tag")
    )


def trace(spark: SparkSession, sf_dir: str, options: Options = OPTIONS) -> Trace:
    ev = base_events(spark, sf_dir)
    seq, whole, cents, t_ns = F.col("seq"), F.col("whole"), F.col("cents"), F.col("t_ns")

    def of(*types: str) -> DataFrame:
        return ev.filter(F.col("type").isin(list(types))) if types else ev

    head = (*RUN_KEYS, "t_ns", "seq")
    pick = F.element_at
    makers = {
        "sched_switch": lambda: ev.filter("type <> 'signup'").select(
            *head, "cpu", F.col("pid").alias("next_pid"), F.col("comm").alias("next_comm")
        ),
        "sched_wakeup": lambda: of("signup").select(
            *head, "pid", "comm", ((F.col("cpu") + whole) % 8).cast("int").alias("target_cpu")
        ),
        "cpu_idle": lambda: of().select(
            *head, "cpu",
            F.when(F.col("type").isin("click", "error"), F.lit(4294967295)).when(F.col("type") == "view", 0)
            .otherwise(1).cast("long").alias("state"),
        ),
        "cpu_idle_miss": lambda: of("error").select(*head, F.col("cpu").alias("cpu_id"), (whole % 2).alias("below")),
        "cpu_frequency": lambda: of("view", "purchase").select(
            *head, "cpu", (300_000 + (whole % OPP_STEPS) * 200_000).alias("frequency")
        ),
        "cgroup_attach_task": lambda: of("error").select(
            *head, "pid", "comm",
            pick(
                F.array(*[F.lit(p) for p in ("/background", "/foreground", "/system-background", "/top-app")]),
                ((F.col("pid") + whole % 2) % 4 + 1).cast("int"),
            ).alias("dst_path"),
        ),
        "uclamp_update_tsk": lambda: of("click").select(
            *head, F.when(whole % 10 == 0, F.col("pid") + 1_000_000_000).otherwise(F.col("pid")).alias("pid"),
            (seq % 2).alias("uclamp_id"), (whole % 1024).alias("value"),
        ),
        "pixel6_emeter": lambda: of("purchase", "view").select(
            *head, pick(F.array(*[F.lit(c) for c in CHANNELS]), (seq % 6 + 1).cast("int")).alias("chan_name"),
            (seq * 1_000_000_000 + cents).alias("value"),
        ),
        "sched_pelt_cfs": lambda: of("view").select(
            *head, "cpu", F.when(seq % 3 == 0, "/background").otherwise("/").alias("path"),
            (whole % 1024).alias("load"), (cents % 1024).alias("util"),
        ),
        "sched_cpu_capacity": lambda: of("signup").select(*head, "cpu", (1024 - whole % 512).alias("capacity")),
        "sched_overutilized": lambda: of("click", "purchase").select(*head, (seq % 2).alias("overutilized")),
        "perf_counter": lambda: of("error", "view").select(
            *head, "cpu", pick(F.array(*[F.lit(c) for c in COUNTERS]), (seq % 3 + 1).cast("int")).alias("counter_id"),
            (seq * 1000 + whole).alias("value"),
        ),
        "frames": lambda: of("purchase", "click", "error").select(
            *RUN_KEYS, (t_ns - 8_000_000).alias("desired_present_time_us"),
            F.when(F.col("type") == "error", F.lit(9223372036854775807)).otherwise(t_ns)
            .alias("actual_present_time_us"),
            (t_ns - cents * 1000).alias("frame_ready_time_us"),
        ),
        "thermal": lambda: of("view").select(
            *RUN_KEYS, (t_ns.cast("double") / 1e9).alias("time"),
            *[(30_000 + (cents * (zone + 1)) % 20_000).alias(f"thermal_zone{zone}-temp") for zone in range(3)],
        ),
        "adpf": lambda: of("signup").select(
            *RUN_KEYS, (t_ns.cast("double") / 1e9).alias("time"), seq.cast("double").alias("# frame count"),
            (whole % 60 + 1).cast("double").alias("average fps"), (whole % 5).cast("double").alias("sigma fps"),
            (whole % 3).cast("double").alias("thermal status"),
            # after time, frame count and the three above, a feature and its sn_ twin have one value
            *[((cents + i // 2) % 10).cast("double").alias(name) for i, name in enumerate(ADPF_COLUMNS[5:])],
        ),
    }
    return Trace(spark, Tables(makers), runs_table(spark), options, iterations=2 * ITERATIONS, clock=ev, origin=sf_dir)


_STORES: dict[tuple, str] = {}  # folders of stores already written, by application, directory and slices


def stored_trace(spark: SparkSession, sf_dir: str, tables: Collection[str], options: Options = OPTIONS) -> Trace:
    """The trace read from a store in the shared folder with these tables: each is written when the first call for a directory asks for it."""
    key = (spark.sparkContext.applicationId, sf_dir, options.rows_per_slice)
    if key not in _STORES:
        folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        write_store(trace(spark, sf_dir, options), folder, int(spark.conf.get("spark.sql.shuffle.partitions")), tables)
        _STORES[key] = folder
    else:
        add_tables(trace(spark, sf_dir, options), _STORES[key], tables)
    return open_store(spark, _STORES[key], options, 2 * ITERATIONS)


def burst_trace(spark: SparkSession, sf_dir: str, options: Options = OPTIONS) -> Trace:
    """The trace with nine tenths of each iteration's events moved into the first hundredth of its three days."""
    ev = base_events(spark, sf_dir)
    began = f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', date_trunc('DAY', timestamp_micros(t_ns div 1000)) - make_interval(0, 0, 0, (day(timestamp_micros(t_ns div 1000)) - 1) % 3)) * 1000"
    ev = ev.withColumn("began", F.expr(began)).withColumn(
        "t_ns", F.when(F.col("seq") % 10 != 0, F.col("began") + F.expr("(t_ns - began) div 100")).otherwise(F.col("t_ns"))).drop("began")
    switches = lambda: ev.select(
        *RUN_KEYS, "t_ns", "seq", "cpu", F.col("pid").alias("next_pid"), F.col("comm").alias("next_comm"))
    return Trace(spark, Tables({"sched_switch": switches}), runs_table(spark), options, iterations=2 * ITERATIONS, clock=ev, origin=f"{sf_dir} in bursts")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as benchmark results: the mean price per iteration, test and metric.

    Statuses choose between two scores and the perf counters; priorities are tests. Every fiftieth
    order counts to an idle test whose score is 0, which an analysis leaves out.
    """
    counters = ", ".join(f"'{c}'" for c in OPTIONS.perf_counters)
    rows = read(spark, sf_dir, "orders").selectExpr(
        f"if(o_custkey % 2 = 0, '{BASELINE}', '{CANDIDATE}') as wa_path",
        "cast((day(o_orderdate) - 1) div 3 + 1 as int) as iteration",
        f"case o_orderstatus when 'P' then concat('perf-0-', array({counters})[cast(o_orderkey % 9 as int)])"
        " when 'O' then 'jank_p' else 'mean' end as metric",
        "if(o_orderkey % 50 = 0, 'idle', o_orderpriority) as test_name",
        "if(o_orderkey % 50 = 0, 0, cast(round(o_totalprice * 100) as bigint)) as cents",
    )
    return rows.groupBy("wa_path", "iteration", "metric", "test_name").agg(
        (F.sum("cents").cast("double") / 100 / F.count("cents")).alias("value"),
        F.lit(100.0).alias("scaled from(%)"),
    )


def jank_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as frames in long form: its price as duration, returned lines as janky frames."""
    line = read(spark, sf_dir, "lineitem")
    forms = F.array(
        F.struct(F.lit("total_duration").alias("variable"), F.col("l_extendedprice").alias("value")),
        F.struct(
            F.lit("jank_frame").alias("variable"),
            F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("value"),
        ),
    )
    return line.select(
        F.when(F.col("l_suppkey") % 2 == 0, BASELINE).otherwise(CANDIDATE).alias("wa_path"),
        (F.col("l_orderkey") % 10 + 1).cast("int").alias("iteration"), F.inline(forms),
    )


def analysis(spark: SparkSession, sf_dir: str, options: Options = OPTIONS) -> Analysis:
    return of_trace(
        trace(spark, sf_dir, options), TAGS, "synth",
        lambda: results(spark, sf_dir), lambda: jank_frames(spark, sf_dir),
    )
