"""Comparison of runs: one row per tag and facet with its statistics against the first run."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.config import Options
from runweave.functions.stats import STATISTICS, Mergeable, Statistic, Whole, python_statistics, split_statistics, statistics
from runweave.functions.text import SIGNIFICANT, human_number, marked_change, percent, tag_order
from runweave.operators.distribution import two_sample_test

log = logging.getLogger(__name__)


def compare_runs(
    df: DataFrame,
    tags: Sequence[str],
    facets: Sequence[str] = (),
    value: str = "value",
    *,
    digits: int | Mapping[str, int] = 1,
    percentage: bool = True,
    options: Options | None = None,
    sliced: bool = False,
    exact: bool = True,
    stats: dict[str, Statistic | Whole | Mergeable | Callable] | None = None,
) -> DataFrame:
    """Statistics over the iterations of each tag and facet, in long melt-like input ``df``.

    ``value`` of the result is the geometric mean; it, ``std`` and ``sem`` are rounded to ``digits``
    places, unless that is 0; a mapping gives the places by the value of the facet ``block``. With ``percentage`` and two tags or more, ``perc_diff`` is the change
    of the geometric mean from the first tag and ``ks_p`` the two-sample test against it; the first
    tag itself has a change of 0 and no p-value. Rows of tags that are not listed are left out.
    ``stats`` names further aggregates: functions of a column to an aggregate, Python functions of a numpy array of
    all values of a tag and facet, or ``Mergeable`` ones for very many values. A facet has about one value per
    iteration; for very many values a facet pass ``sliced=True``, and ``exact=False`` for the
    limiting distribution in the test.
    """
    options, tags, facets = options or Options(), list(tags), list(facets)
    df = df.filter(F.col("tag").isin(tags))
    for column, default in (("metric", "gmean"), ("unit", "x")):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(default))
        if column not in facets:
            facets.append(column)
    if percentage and len(tags) < 2:
        log.error("percentage differences need two runs or more")
        percentage = False

    columns, python = split_statistics(stats)
    made = statistics(value, STATISTICS | columns)
    table = df.groupBy("tag", *facets).agg(F.count(value).alias("n"), *made)
    if python:
        table = _beside(table, python_statistics(df, ["tag", *facets], value, python), ["tag", *facets], list(python))
    if percentage:
        # A facet has at most one row per tag here, so the reference row is found without a join.
        facet = Window.partitionBy(*facets)
        reference = F.max(F.when(F.col("tag") == tags[0], F.col("gmean"))).over(facet)
        table = table.withColumn("perc_diff", (F.try_divide("gmean", reference) - 1) * 100)
        tests = two_sample_test(df, facets, value, tags, sliced=sliced, exact=exact)
        table = _beside(table, tests, ["tag", *facets], ["ks_d", "ks_p"])

    def rounded(column: str, places: int) -> Column:
        return F.round(column, places) if places > 0 else F.col(column)

    def shown(column: str) -> Column:
        if isinstance(digits, int):
            return rounded(column, digits)
        return F.coalesce(*[F.when(F.col("block") == name, rounded(column, d)) for name, d in digits.items()])

    table = table.withColumns({"value": shown("gmean"), "std": shown("std"), "sem": shown("sem")}).drop("gmean")
    labels = {"order_tag": tag_order("tag", tags), "value_label": human_number("value")}
    if percentage:
        labels |= {
            "significant": F.coalesce(F.col("ks_p") < SIGNIFICANT, F.lit(False)),
            "perc_label": percent("perc_diff"),
            "bar_label": marked_change("value", "perc_diff", "ks_p"),
        }
    if "cluster" in facets:
        labels["order_cluster"] = options.cluster_order("cluster")
    return table.withColumns(labels)


@dataclass(frozen=True)
class Asked:
    """What a comparison is asked for, before it is made: several of them can be made at once."""

    rows: DataFrame
    facets: Sequence[str]
    value: str
    digits: int


def asked(
    df: DataFrame, tags: Sequence[str], facets: Sequence[str] = (), value: str = "value", *, digits: int = 1,
    options: Options | None = None,
) -> Asked:
    """Takes the arguments of ``compare_runs``, for ``compare_stacked``."""
    more = [c for c in ("metric", "unit") if c in df.columns and c not in facets]
    return Asked(df.filter(F.col("tag").isin(list(tags))), [*facets, *more], value, digits)


def compare_stacked(
    parts: Mapping[str, Asked], tags: Sequence[str], *, options: Options | None = None, percentage: bool = True
) -> DataFrame:
    """Comparisons of several tables in one: one aggregation and one test over all of them.

    The tables are stacked as ``block`` (their name in ``parts``), ``facet`` (a struct of all their facets as strings,
    null where a table has no such facet), ``tag`` and ``value``; the result has a row per block, facet and tag.
    """
    names = sorted({facet for part in parts.values() for facet in part.facets})

    def stacked(block: str, part: Asked) -> DataFrame:
        own = [(F.col(f"`{n}`") if n in part.facets else F.lit(None)).cast("string").alias(n) for n in names]
        return part.rows.select(
            "tag", F.lit(block).alias("block"), F.struct(*own).alias("facet"), F.col(f"`{part.value}`").cast("double").alias("value")
        )

    rows = reduce(DataFrame.unionByName, [stacked(block, part) for block, part in parts.items()])
    return compare_runs(
        rows, tags, ["block", "facet"], digits={block: part.digits for block, part in parts.items()},
        options=options, percentage=percentage,
    )


def _beside(table: DataFrame, other: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``table`` with columns of the row of ``other`` that has its keys; null keys are equal."""
    matched = [F.col(f"c.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return table.alias("c").join(other.alias("t"), matched, "left").select("c.*", *[F.col(f"t.`{c}`") for c in columns])


def comparison_order(df: DataFrame, sort: Sequence[str] | None = None, order_cluster: bool = False) -> DataFrame:
    """Rows in the order of the table: by metric, rank of the cluster if asked, and run; or as given."""
    keys = list(sort) if sort else ["metric", *(["order_cluster"] if order_cluster else []), "order_tag"]
    return df.orderBy(*keys)


def series(
    df: DataFrame, tags: Sequence[str], value: str = "value", x: str = "iteration", facets: Sequence[str] = ()
) -> DataFrame:
    """The points of one line per tag (and facet): to be shown by ``order_tag`` and ``x``."""
    rows = df.filter(F.col("tag").isin(list(tags)))
    return rows.select("tag", tag_order("tag", list(tags)).alias("order_tag"), *facets, x, F.col(f"`{value}`").alias("value"))


def series_order(df: DataFrame, sort: Sequence[str] = ("iteration",)) -> DataFrame:
    return df.orderBy("order_tag", *sort)
