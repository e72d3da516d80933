"""One ordered pass over a store's timeline for everything that sums the time between state changes.

The timeline has the idle, frequency and switch events of all CPUs, dealt out by run, iteration and time slice. A slice begins
with carried rows: what each CPU's idle state, frequency and task were when it began. So each slice is swept by itself:
the states of a cluster's CPUs are held as a vector along its rows, every span is cut at the end of the slice, and the
sums over slices are those over the iteration. Nothing is looked up in other slices and no table is read twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.trace import PLACED, RUN_KEYS, SLICE, Trace, seconds

FREQUENCY, IDLE, SWITCH = 0, 1, 2
AWAKE = -1
STATE = ("state", "frequency", "pid", "comm")
IDLE_EXIT = 4294967295  # fixed value: the idle event's "left idle" code as an unsigned number


def _laned(trace: Trace, rows: DataFrame) -> DataFrame:
    """With ``lane``, the cluster of the CPU, or a lane of its own for a CPU of no cluster."""
    return rows.select("*", F.coalesce(trace.options.cluster_of("cpu"), F.concat(F.lit("cpu"), F.col("cpu").cast("string")), F.lit("")).alias("lane"))


def changes(trace: Trace) -> DataFrame:
    """The timeline's own rows: all state changes with their slice."""
    kinds = {
        "cpu_frequency": (FREQUENCY, {"frequency": F.col("frequency").cast("long")}),
        "cpu_idle": (IDLE, {"state": F.when(F.col("state") == IDLE_EXIT, F.lit(AWAKE)).otherwise(F.col("state")).cast("long")}),
        "sched_switch": (SWITCH, {"pid": F.col("next_pid").cast("long"), "comm": F.col("next_comm")}),
    }
    none = {"state": "long", "frequency": "long", "pid": "long", "comm": "string"}
    rows = None
    for event, (kind, values) in kinds.items():
        if trace.has(event):
            columns = [values.get(c, F.lit(None).cast(t)).alias(c) for c, t in none.items()]
            part = trace.event(event).select(*RUN_KEYS, "t_ns", "seq", F.col("cpu").cast("int").alias("cpu"), F.lit(kind).alias("kind"), *columns)
            rows = part if rows is None else rows.unionByName(part)
    return _laned(trace, trace.cut(rows).withColumn("carried", F.lit(False)))


def carried(trace: Trace, rows: DataFrame) -> DataFrame:
    """For each slice what it inherits from the ones before, made of the `changes`: as a store reads them, they are grouped where they are."""
    # the last row of each CPU and kind in a slice, and from these what every later slice begins with
    place = F.struct("t_ns", "seq")
    lasts = rows.groupBy(*PLACED, "cpu", "kind").agg(F.max_by(F.struct(*STATE), place).alias("last"))
    sizes = trace.slices.select(*RUN_KEYS, "borders").filter(F.size("borders") > 0)
    present = lasts.select(*RUN_KEYS, "cpu", "kind").distinct()
    grid = present.join(sizes, list(RUN_KEYS)).select(*RUN_KEYS, "cpu", "kind", F.posexplode("borders").alias("before", "t_ns"))
    grid = grid.select(*RUN_KEYS, "cpu", "kind", (F.col("before") + 1).alias(SLICE), "t_ns")
    held = grid.unionByName(present.select("*", F.lit(0).alias(SLICE), F.lit(None).cast("long").alias("t_ns"))).join(
        lasts, [*PLACED, "cpu", "kind"], "left")
    earlier = Window.partitionBy(*RUN_KEYS, "cpu", "kind").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("last", F.last("last", ignorenulls=True).over(earlier)).filter("last is not null")
    return _laned(trace, held.select(*PLACED, "cpu", "kind", "t_ns", F.lit(-1).cast("long").alias("seq"), "last.*", F.lit(True).alias("carried")))


def _slot(trace: Trace) -> Column:
    """A CPU's place in its cluster."""
    found = F.lit(0)
    for members in trace.options.clusters.values():
        for slot, cpu in enumerate(members):
            if slot:
                found = F.when(F.col("cpu") == cpu, slot).otherwise(found)
    return found


def totals(trace: Trace, *wanted: str) -> DataFrame:
    """Time in ns by run, iteration and ``what``: idle states, frequencies and tasks, from one pass over the timeline.

    ``what`` idle: lane, number (state). frequency: lane, number (kHz), active_ns. task: cpu, number (pid), comm. All of
    them, or those that are ``wanted``: states that only the others need are not held then.
    """
    if "totals" in trace.prepared:
        return trace.prepared["totals"]
    clusters = trace.options.clusters
    width = max(map(len, clusters.values()))
    ends = trace.slices.select(*RUN_KEYS, "end_ns", "borders")
    rows = trace.prepared["timeline"].join(trace._small(ends), list(RUN_KEYS), "left")
    rows = rows.withColumn("until", F.coalesce(F.get("borders", F.col(SLICE)), F.col("end_ns"))).drop("borders", "end_ns")
    along = Window.partitionBy(*PLACED, "lane").orderBy("t_ns", F.col("carried").desc(), "kind", "seq", "cpu")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("slot", _slot(trace))
    task = F.struct("pid", "comm")
    held = {"next_ns": F.lead("t_ns").over(along)}
    for k in range(width):
        mine = F.col("slot") == k
        held[f"state_{k}"] = F.last(F.when(mine & (F.col("kind") == IDLE), F.col("state")), ignorenulls=True).over(so_far)
        held[f"task_{k}"] = F.last(F.when(mine & (F.col("kind") == SWITCH), task), ignorenulls=True).over(before)
    first = (F.col("slot") == 0) & (F.col("kind") == FREQUENCY)
    held["at"] = F.last(F.when(first, F.col("frequency")), ignorenulls=True).over(so_far)
    rows = rows.withColumns(held)

    known = F.col("lane").isin(list(clusters))
    states = [F.when(F.lit(k) < trace.options.cluster_size("lane"), F.coalesce(f"state_{k}", F.lit(AWAKE).cast("long"))) for k in range(width)]
    shallowest = F.least(*states) if width > 1 else states[0]
    rows = rows.withColumns({
        "ns": F.coalesce("next_ns", "until") - F.col("t_ns"), "shallowest": shallowest,
        "was": F.coalesce(*[F.when(F.col("slot") == k, F.col(f"task_{k}")) for k in range(width)]),
    })
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    is_idle, is_switch = F.col("kind") == IDLE, F.col("kind") == SWITCH

    def share(what, when, lane=F.lit(None).cast("string"), cpu=F.lit(None).cast("int"), number=none, comm=F.lit(None).cast("string"), ns=zero, active=zero):
        return F.when(when, F.struct(F.lit(what).alias("what"), lane.alias("lane"), cpu.alias("cpu"), number.cast("long").alias("number"),
                                     comm.alias("comm"), ns.cast("long").alias("ns"), active.cast("long").alias("active_ns")))

    left = F.col("until") - F.col("t_ns")  # a task runs to the end of the slice, less what its successor takes over
    shares = [
        share("idle", known & (F.col("shallowest") >= 0), lane=F.col("lane"), number=F.col("shallowest"), ns=F.col("ns")),
        # states that a CPU enters are reported, with no time where the whole cluster is never in them
        share("idle", known & is_idle & (F.col("state") >= 0), lane=F.col("lane"), number=F.col("state")),
        share("frequency", known & F.col("at").isNotNull(), lane=F.col("lane"), number=F.col("at"), ns=F.col("ns"),
              active=F.when(F.col("shallowest") == AWAKE, F.col("ns")).otherwise(0)),
        share("task", is_switch, cpu=F.col("cpu"), number=F.col("pid"), comm=F.col("comm"), ns=left),
        share("task", is_switch & F.col("was").isNotNull(), cpu=F.col("cpu"), number=F.col("was.pid"), comm=F.col("was.comm"), ns=-left),
    ]
    of = ("idle", "idle", "frequency", "task", "task")
    chosen = F.array_compact(F.array(*[s for s, what in zip(shares, of) if what in (wanted or of)]))
    parts = rows.select(*RUN_KEYS, F.inline(chosen))
    return parts.groupBy(*RUN_KEYS, "what", "lane", "cpu", "number", "comm").agg(F.sum("ns").alias("ns"), F.sum("active_ns").alias("active_ns"))


def cluster_idle_residency(trace: Trace) -> DataFrame:
    """As ``cpus.cluster_idle_residency``: a CPU that enters a state is in all shallower ones on its way, so these are reported too."""
    idle = totals(trace, "idle").filter("what = 'idle'").select(
        *RUN_KEYS, F.col("lane").alias("cluster"), "number", "ns", F.explode(F.sequence(F.lit(0).cast("long"), "number")).alias("idle_state"))
    own = F.when(F.col("idle_state") == F.col("number"), F.col("ns")).otherwise(0)
    every = idle.groupBy(*RUN_KEYS, "cluster", "idle_state").agg(F.sum(own).alias("ns"))
    return every.select(*RUN_KEYS, "cluster", "idle_state", seconds("ns").alias("time"))


def frequency_residency(trace: Trace) -> DataFrame:
    """As ``cpus.frequency_residency``."""
    return totals(trace, "frequency").filter("what = 'frequency'").select(
        *RUN_KEYS, F.col("lane").alias("cluster"), F.col("number").alias("frequency"),
        seconds("ns").alias("total_time"), seconds("active_ns").alias("active_time"))


def task_cpu_ns(trace: Trace) -> DataFrame:
    """As ``tasks.task_cpu_ns``."""
    return totals(trace, "task").filter("what = 'task'").select(*RUN_KEYS, F.col("number").alias("pid"), "comm", "cpu", "ns")
