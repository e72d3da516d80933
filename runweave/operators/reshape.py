"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], variable: str = "variable") -> DataFrame:
    """One row per listed column, its name in ``variable`` and its content as a double in ``value``."""
    wide = df.select(*ids, *[F.col(f"`{v}`").cast("double").alias(v) for v in values])
    return wide.unpivot(list(ids), [F.col(f"`{v}`") for v in values], variable, "value")


def by_tag(df: DataFrame, index: str, tags: Sequence[str], value: str = "value") -> DataFrame:
    """One row per index value and a column per tag, in the order of the runs; two values for a cell are an error."""
    one = F.when(F.count(value) <= 1, F.first(value, ignorenulls=True)).otherwise(
        F.raise_error(F.lit(f"by_tag: several values of a {index} for one tag"))
    )
    return df.groupBy(index).pivot("tag", list(tags)).agg(one)


def roll_up_channels(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per-channel rows, plus ``CPU`` for the channels whose name starts so and ``Total`` for all."""
    cpu = F.when(F.col("channel").startswith("CPU"), F.array(F.lit("CPU"))).otherwise(F.array().cast("array<string>"))
    own = F.array(F.struct(F.col("channel").alias("channel"), F.lit(0).alias("level")))
    rolled = F.concat(
        own,
        F.transform(F.concat(cpu, F.array(F.lit("Total"))), lambda c: F.struct(c.alias("channel"), F.lit(1).alias("level"))),
    )
    return df.select(*keys, F.col(value).alias(value), F.inline(rolled)).groupBy(*keys, "level", "channel").agg(
        F.sum(value).alias(value)
    ).drop("level")
