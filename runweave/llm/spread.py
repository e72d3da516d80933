"""Joins by a key that very many rows may share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY = 2_000  # a key is heavy with more than this part of all counted rows, so there are fewer heavy keys than this


def spread_join(rows: DataFrame, facts: DataFrame, keys: Sequence[str], count: str) -> DataFrame:
    """Inner join by `keys` of rows with facts, which has one row a key and in `count` the number of its rows.

    Facts of heavy keys, less than `HEAVY` of them at any size, are broadcast, so the rows of such a key stay where they
    are; all other keys are joined as usual. Both inputs are read twice: they should be tables. Null keys match nothing.
    """
    keys = list(keys)
    total = facts.agg(F.sum(count)).first()[0] or 0
    heavy = F.coalesce(F.col(count) * HEAVY > F.lit(total), F.lit(False))
    few = facts.filter(heavy)
    spread = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(facts.filter(~heavy), keys)
    return spread.unionByName(rest)
