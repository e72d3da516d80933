"""CPU states over time: idle, frequency, overutilization and what they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.operators import sweep
from runweave.operators.sweep import AWAKE, IDLE_EXIT
from runweave.trace import PLACED, RUN_KEYS, Trace, place, seconds


def idle_events(trace: Trace) -> DataFrame:
    """Idle transitions: ``state`` is the idle state entered, -1 when the CPU woke up."""
    events = trace.event("cpu_idle")
    state = F.when(F.col("state") == IDLE_EXIT, F.lit(AWAKE)).otherwise(F.col("state")).cast("long")
    return events.select(
        *place(events), "t_ns", "seq", "cpu", state.alias("state"), trace.options.cluster_of("cpu").alias("cluster")
    )


def idle_steps(trace: Trace) -> DataFrame:
    """Idle transitions that change something, with the state before; a CPU starts out awake."""
    changes = trace.follow(
        idle_events(trace).filter(F.col("cluster").isNotNull()), ["cpu"], behind={"before": "state"}
    )
    return trace.staged(
        changes.withColumn("before", F.coalesce("before", F.lit(AWAKE).cast("long"))).filter(
            F.col("before") != F.col("state")
        )
    )


def cluster_idle_residency(trace: Trace) -> DataFrame:
    """Time each cluster spends in each idle state: the shallowest state among its CPUs.

    A CPU in state s is "at least k deep" for every k up to s. Counting how many CPUs are at least
    k deep, as a running sum over the changes, gives the time the whole cluster is; state k is that
    time less the time of k+1. Changes at one instant need no merging: between them no time passes.
    """
    if "timeline" in trace.prepared:
        return sweep.cluster_idle_residency(trace)
    low = F.least("before", "state")
    high = F.greatest("before", "state")
    steps = idle_steps(trace).select(
        *RUN_KEYS, "cluster", "t_ns", "cpu", "seq",
        F.signum(F.col("state") - F.col("before")).cast("long").alias("step"),
        F.explode(F.sequence(low + 1, high)).alias("depth"),
    )
    deep = trace.spans(steps, ["cluster", "depth"], ["t_ns", "cpu", "seq"], total={"deep_cpus": "step"})
    all_deep = F.col("deep_cpus") == trace.options.cluster_size("cluster")
    per_depth = deep.groupBy(*RUN_KEYS, "cluster", "depth").agg(
        F.sum(F.when(all_deep, F.col("t_end_ns") - F.col("t_ns")).otherwise(0)).alias("ns")
    )
    # At least k deep counts for state k and against state k-1.
    shares = per_depth.select(
        *RUN_KEYS, "cluster",
        F.explode(F.array(
            F.struct(F.col("depth").alias("idle_state"), F.col("ns").alias("ns"), F.lit(True).alias("own")),
            F.struct((F.col("depth") - 1).alias("idle_state"), (-F.col("ns")).alias("ns"), F.lit(False).alias("own")),
        )).alias("share"),
    )
    states = shares.groupBy(*RUN_KEYS, "cluster", F.col("share.idle_state").alias("idle_state")).agg(
        F.sum("share.ns").alias("ns"), F.bool_or("share.own").alias("own")
    )
    return states.filter("own").select(*RUN_KEYS, "cluster", "idle_state", seconds("ns").alias("time"))


def frequency_events(trace: Trace) -> DataFrame:
    """Frequency changes in kHz, with the cluster of the CPU."""
    events = trace.event("cpu_frequency")
    return events.select(
        *place(events), "t_ns", "seq", "cpu", "frequency", trace.options.cluster_of("cpu").alias("cluster")
    )


def domain_frequency_events(trace: Trace) -> DataFrame:
    """Frequency changes of the first CPU of each cluster: the others of the domain repeat it."""
    firsts = [members[0] for members in trace.options.clusters.values()]
    return frequency_events(trace).filter(F.col("cpu").isin(firsts))


def frequency_residency(trace: Trace) -> DataFrame:
    """Time per cluster and frequency: in total, and while any CPU of the cluster is awake."""
    if "timeline" in trace.prepared:
        return sweep.frequency_residency(trace)
    freqs = domain_frequency_events(trace).select(
        *RUN_KEYS, "cluster", "t_ns", "cpu", "seq", "frequency", F.lit(0).cast("long").alias("step")
    )
    rows = freqs
    if trace.has("cpu_idle"):
        before = F.when(F.col("before") == AWAKE, 1).otherwise(0)
        after = F.when(F.col("state") == AWAKE, 1).otherwise(0)
        awake = idle_steps(trace).select(
            *RUN_KEYS, "cluster", "t_ns", "cpu", "seq",
            F.lit(None).cast("long").alias("frequency"), (after - before).cast("long").alias("step"),
        ).filter("step != 0")
        rows = freqs.unionByName(awake)
    spans = trace.spans(
        rows, ["cluster"], ["t_ns", "cpu", "seq", "step"], fill={"at": "frequency"}, total={"woken": "step"}
    )
    length = F.col("t_end_ns") - F.col("t_ns")
    any_awake = F.col("woken") + trace.options.cluster_size("cluster") > 0
    residency = spans.filter("at is not null").groupBy(*RUN_KEYS, "cluster", F.col("at").alias("frequency")).agg(
        F.sum(length).alias("total_ns"), F.sum(F.when(any_awake, length).otherwise(0)).alias("active_ns")
    )
    return residency.select(
        *RUN_KEYS, "cluster", "frequency",
        seconds("total_ns").alias("total_time"), seconds("active_ns").alias("active_time"),
    )


def overutilized_time(trace: Trace) -> DataFrame:
    """Seconds an iteration is overutilized, its length, and the percentage."""
    events = trace.event("sched_overutilized")
    spans = trace.spans(events.select(*place(events), "t_ns", "seq", "overutilized"), [])
    over = spans.groupBy(*RUN_KEYS).agg(
        F.sum(F.when(F.col("overutilized") == 1, F.col("t_end_ns") - F.col("t_ns")).otherwise(0)).alias("ns")
    )
    timed = trace.with_window(over).select(
        *RUN_KEYS, seconds("ns").alias("time"), seconds(F.col("end_ns") - F.col("start_ns")).alias("total_time")
    )
    share = F.try_divide("time", "total_time") * 100
    return timed.withColumn("percentage", F.round(share, 2))


def power_spans(trace: Trace) -> DataFrame:
    """Modelled power of each CPU over the spans in which its frequency and idle state hold.

    Both kinds of events are put in one order per CPU and each state is carried forward: no range
    join. An awake CPU takes the power of its operating point, an idle one that of its idle state.
    """
    opp = F.broadcast(trace.options.opp_table(trace.spark).select("cluster", "frequency", "active_power"))
    idle = F.broadcast(trace.options.idle_power_table(trace.spark))
    none = F.lit(None).cast("long")
    if "timeline" in trace.prepared:  # both kinds in one table, dealt out already
        changes = trace.prepared["timeline"].filter(~F.col("carried") & F.col("kind").isin(sweep.FREQUENCY, sweep.IDLE)).select(
            *PLACED, trace.options.cluster_of("cpu").alias("cluster"), "cpu", "t_ns", "kind", "seq", "frequency", "state"
        )
    else:
        changes = frequency_events(trace).select(
            *RUN_KEYS, "cluster", "cpu", "t_ns", F.lit(0).alias("kind"), "seq", "frequency", none.alias("state")
        ).unionByName(
            idle_events(trace).select(
                *RUN_KEYS, "cluster", "cpu", "t_ns", F.lit(1).alias("kind"), "seq", none.alias("frequency"), "state"
            )
        )
    changes = changes.filter("cluster is not null")
    held = trace.spans(
        changes, ["cpu"], ["t_ns", "kind", "seq"], fill={"held_frequency": "frequency", "held_state": "state"}
    )
    held = held.filter("t_end_ns > t_ns").select(
        *place(held), "cluster", "cpu", "t_ns", "t_end_ns",
        F.col("held_frequency").alias("frequency"),
        F.coalesce("held_state", F.lit(AWAKE).cast("long")).alias("state"),
    )
    priced = held.join(opp, ["cluster", "frequency"], "left").join(idle, ["cluster", "state"], "left")
    power = F.when(F.col("state") == AWAKE, F.col("active_power")).otherwise(F.col("idle_power"))
    return priced.select(*place(priced), "cluster", "cpu", "t_ns", "t_end_ns", power.alias("power")).filter(
        "power is not null"
    )


def energy_estimate(trace: Trace) -> DataFrame:
    """Power of every CPU, cluster and of all at each instant it changes (``cpu0`` ..., clusters, ``total``)."""
    cpus = trace.options.cpus
    spans = power_spans(trace)
    changes = spans.groupBy(*place(spans), "t_ns").agg(
        *[F.max(F.when(F.col("cpu") == cpu, F.col("power"))).alias(f"set_{cpu}") for cpu in cpus]
    )
    held = trace.follow(trace.staged(changes), [], ["t_ns"], fill={f"cpu{cpu}": f"set_{cpu}" for cpu in cpus})
    return held.select(
        *RUN_KEYS, "t_ns", *[f"cpu{cpu}" for cpu in cpus],
        *[
            sum((F.coalesce(f"cpu{cpu}", F.lit(0.0)) for cpu in members), F.lit(0.0)).alias(cluster)
            for cluster, members in trace.options.clusters.items()
        ],
        sum((F.coalesce(f"cpu{cpu}", F.lit(0.0)) for cpu in cpus), F.lit(0.0)).alias("total"),
    )
