"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runweave.llm.storage import checkpointed

MAX_ROUNDS = 100  # the number of rounds is logarithmic; reaching this is an error


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of every node's neighbours (large: the greater ones; small: the smaller ones) to the least node around."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node with a link that is not itself the root.

    links: u, v of one orderable type, no nulls; direction and repeated rows do not matter. Least neighbours come from
    map-side minima, so a hub with very many links is no single task's group; each round's links are written to the
    shared folder.
    """
    now = checkpointed(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = print_of(now)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        now = checkpointed(_star(_star(now, True), False))
        after = print_of(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
