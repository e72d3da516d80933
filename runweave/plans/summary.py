"""One table of the headline figures: a row per figure and a column per run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.errors import RunweaveError
from runweave.operators.reshape import by_tag
from runweave.plans import views
from runweave.plans.compare import asked, compare_stacked
from runweave.plans.datasets import Analysis

# Block, its view, the facet that names the figure, the name's pattern, which rows, whether the change is shown.
BLOCKS = (
    ("results", None, "metric", "{}", None, True),
    ("jb_mean_frame_duration", views.jankbench_mean_frame_durations_bar, "variable", "{}", None, True),
    ("jankbench_percs", views.jankbench_jank_percentage_bar, "variable", "{}", None, True),
    ("jb_max_frame_duration", views.jankbench_max_frame_durations, "variable", "{}", None, False),
    ("power_usage", views.power_meter_bar, "channel", "CPU_total_power", "channel = 'CPU'", True),
    ("overutilized_mean", None, None, None, None, None),
    ("thermal", views.thermal_bar, "cluster", "thermal ({})", None, True),
    ("wakeup_latency", views.wakeup_latency_bar, "comm", "latency ({})", None, True),
    ("tasks_cpu_residency_per_task", views.tasks_cpu_residency_per_task_bar, "comm", "CPU residency ({})",
     "cluster = 'total'", True),
)
SHARES = "overutilized_mean"  # the one block that compares nothing


def compared_cells(ana: Analysis, names: Sequence[str], metrics: Sequence[str] = ()) -> DataFrame:
    """Cells ``block, metric, tag, value`` of the blocks that compare runs, from one comparison of all of them."""
    chosen = [b for b in BLOCKS if b[0] in names and b[0] != SHARES]
    parts = {}
    for name, view, _, _, rows, _ in chosen:
        part = views.results_bar(ana, metrics, compare=asked) if name == "results" else view(ana, compare=asked)
        parts[name] = replace(part, rows=part.rows.filter(rows)) if rows else part
    table = compare_stacked(parts, ana.tags, options=ana.options)
    change = F.concat(F.lit(" ("), F.col("perc_label"), F.lit(")")) if "perc_label" in table.columns else F.lit("")
    figure = value = F.lit(None).cast("string")
    for name, _, index, pattern, _, changes in reversed(chosen):
        here = F.col("block") == name
        before, _, after = pattern.partition("{}")
        named = F.concat(F.lit(before), F.col("facet")[index], F.lit(after)) if "{}" in pattern else F.lit(pattern)
        if name == "results" and "test_name" in parts[name].facets:
            named = F.concat(named, F.lit(" ("), F.col("facet")["test_name"], F.lit(")"))
        figure = F.when(here, named).otherwise(figure)
        value = F.when(here, F.concat("value_label", change) if changes else F.col("value_label")).otherwise(value)
    return table.select("block", figure.alias("metric"), "tag", value.alias("value"))


def shares(ana: Analysis) -> DataFrame:
    percent = F.concat(F.col("percentage").cast("string"), F.lit("%"))
    return ana.dataset(SHARES).select(F.lit(SHARES).alias("block"), "metric", "tag", percent.alias("value"))


def summary(
    ana: Analysis, blocks: Sequence[str], metrics: Sequence[str] = (), rename: Mapping[str, str] | None = None
) -> DataFrame:
    """The chosen blocks as one table; ``metrics`` are the results shown, ``rename`` changes headings."""
    known = [b[0] for b in BLOCKS]
    unknown = [b for b in blocks if b not in known]
    if unknown or not blocks:
        raise RunweaveError(f"unknown summary blocks: {unknown}" if unknown else "no summary block chosen")
    cells = [compared_cells(ana, blocks, metrics)] if set(blocks) - {SHARES} else []
    cells += [shares(ana)] if SHARES in blocks else []
    place = F.array_position(F.array(*[F.lit(name) for name in known]), F.col("block")).cast("int") - 1
    long = reduce(DataFrame.unionByName, cells).withColumn("metric", F.struct(place.alias("block"), "metric"))
    wide = by_tag(long, "metric", ana.tags).select("metric.block", "metric.metric", *[f"`{t}`" for t in ana.tags])
    return wide.withColumnsRenamed(dict(rename or {}))
