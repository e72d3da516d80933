"""Events that are readings: power rails, counters, load signals, frames, side files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.trace import RUN_KEYS, Trace, place, seconds

NOT_PRESENTED = 9223372036854775807  # fixed value: present time of a frame that is still pending


def power_samples(trace: Trace) -> DataFrame:
    """Mean power in mW between two readings of a channel's energy counter (uJ); from the second on."""
    events = trace.event("pixel6_emeter")
    readings = events.select(
        *place(events), "t_ns", "seq", F.col("chan_name").alias("channel"), "value"
    )
    pairs = trace.follow(readings, ["channel"], behind={"was": "value", "was_ns": "t_ns"})
    # uJ per ns is 1e9 uW, or 1e6 mW
    power = (F.col("value") - F.col("was")) * F.lit(1e6) / (F.col("t_ns") - F.col("was_ns"))
    return pairs.filter("t_ns > was_ns").select(*RUN_KEYS, "t_ns", "channel", power.alias("power"))


def counter_deltas(trace: Trace) -> DataFrame:
    """Counter readings in long form: the reading as ``<name>-Total``, its increase as ``<name>``."""
    events = trace.event("perf_counter")
    readings = events.select(*place(events), "t_ns", "seq", "cpu", "counter_id", "value")
    pairs = trace.follow(readings, ["counter_id", "cpu"], behind={"was": "value"}).filter(
        "was is not null and value is not null"
    )
    name = trace.options.counter_name("counter_id")
    if trace.options.allow_missing:
        pairs = pairs.filter(name.isNotNull())
    else:
        unknown = F.raise_error(F.concat(F.lit("unknown counter id "), F.col("counter_id").cast("string")))
        name = F.coalesce(name, unknown.cast("string"))
    forms = F.array(
        F.struct(F.concat("counter", F.lit("-Total")).alias("variable"), F.col("value").alias("value")),
        F.struct(F.col("counter").alias("variable"), (F.col("value") - F.col("was")).alias("value")),
    )
    return pairs.withColumn("counter", name).select(*RUN_KEYS, "t_ns", "cpu", F.inline(forms))


def load_signals(trace: Trace) -> DataFrame:
    return trace.event("sched_pelt_cfs").select(
        *RUN_KEYS, "t_ns", "seq", "cpu", "path", "load", "util", trace.options.cluster_of("cpu").alias("cluster")
    )


def relative_time(trace: Trace, df: DataFrame) -> DataFrame:
    """``time_it``: seconds since the first event of the iteration."""
    return trace.with_window(df, "start_ns").withColumn(
        "time_it", seconds(F.col("t_ns") - F.col("start_ns"))
    ).drop("start_ns")


def frame_times(trace: Trace) -> DataFrame:
    """Presented frames with the time since the one before; the first frame of an iteration has none.

    The file's times are ns. ``ts``, ``ts_iter`` (since the first frame), ``desired_ts`` and
    ``ready_ts`` are s, ``render_time`` and ``render_ready_time`` ms.
    """
    present, desired, ready = "actual_present_time_us", "desired_present_time_us", "frame_ready_time_us"
    frames = trace.event("frames").select(*RUN_KEYS, present, desired, ready).filter(
        F.col(present) != F.lit(NOT_PRESENTED)
    )
    order = [present, ready, desired]
    rows = trace.follow(
        frames, [], order, time=present, behind={"was": present, "was_ready": ready},
        first={"first_present": present}, number="frame",
    ).filter("frame > 1")

    def ms(column):
        return column.cast("double") / F.lit(1e6)

    return rows.select(
        *RUN_KEYS,
        (ms(F.col(present)) / 1000).alias("ts"),
        (ms(F.col(present) - F.col("first_present")) / 1000).alias("ts_iter"),
        (ms(F.col(desired)) / 1000).alias("desired_ts"),
        (ms(F.col(ready)) / 1000).alias("ready_ts"),
        ms(F.col(present) - F.col("was")).alias("render_time"),
        ms(F.col(ready) - F.col("was_ready")).alias("render_ready_time"),
    )
