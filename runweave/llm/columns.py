"""Keeping a table's own columns out of the way of an operator's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASIDE = "_own_columns"


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names: an operator's column takes the place of one of the same name."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def set_aside(df: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the columns `used` and all others in one, and what brings back the columns of df in their order."""
    columns = df.columns
    others = [c for c in columns if c not in used]
    held = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(0).alias("none"))

    def restored(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(c) if c in used else F.col(ASIDE)[c].alias(c) for c in columns))

    return df.select(*(F.col(c) for c in used), held.alias(ASIDE)), restored
