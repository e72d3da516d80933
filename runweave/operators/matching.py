"""Rows of two tables matched by time: the nearest row of the other side, and intervals that overlap.

Neither is a range join. Both put the rows of the two sides in one order per key and carry along it what the other side
had last, or how many rows it has had: ordered work in slices, so that a key with most of the rows is cut like any other.
Slices have equal counts by a quantile sketch of all times. Inputs are written to the
shared folder once, as ordered work reads them more than once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runweave.operators.ordered import even_borders, follow, kept_once, slice_of

ROWS_PER_SLICE = 2_000_000
BLOCK = 4096  # intervals of one side in one array, and of the other that meet it in one group
SIDE, AT, PART = "_side", "_at", "_part"


def asof(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str = "t_ns", *, direction: str = "backward",
    tolerance: int | None = None, order: Sequence[str] = (), rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """``left`` with ``match``: the columns of the row of ``right`` that has its keys and is nearest in time.

    ``backward`` looks at rows at or before the left row's time, ``forward`` at or after it, ``nearest`` at both and takes the
    earlier one of two that are equally near. A match further away than ``tolerance`` is null, and so is that of a row
    without one. ``time`` is a long column of both. Of right rows at one time the last by ``order`` is taken going
    backward and the first going forward. Rows with null times match nothing; null keys are equal to each other.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no such direction: {direction}")
    mine = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    theirs = F.struct(*[F.col(f"`{c}`") for c in right.columns])
    none = F.lit(None)
    kinds = {"_left": left.select(mine.alias("x")).schema["x"].dataType, "_right": right.select(theirs.alias("x")).schema["x"].dataType}
    ties = [f"_tie{i}" for i in range(len(order))]
    own_ties = [F.col(o).alias(t) for o, t in zip(order, ties)]
    types = [right.schema[o].dataType for o in order]
    asking = left.select(
        *keys, F.col(time).cast("long").alias(AT), F.lit(1).alias(SIDE), *[none.cast(d).alias(t) for t, d in zip(ties, types)],
        mine.alias("_left"), none.cast(kinds["_right"]).alias("_right"))
    offered = right.select(
        *keys, F.col(time).cast("long").alias(AT), F.lit(0).alias(SIDE), *own_ties, none.cast(kinds["_left"]).alias("_left"),
        F.when(F.col(time).isNotNull(), theirs).alias("_right"))
    rows = kept_once(asking, offered)
    rows = rows.withColumn(PART, slice_of(even_borders(rows, AT, rows_per_slice), AT))
    # ascending order, in which right rows come first of those at one time
    if direction != "forward":
        rows = follow(rows, keys, [AT, SIDE, *ties], slice_col=PART, fill={"_before": "_right"})
    if direction != "backward":
        # the same seen from the end: times, ties and slices turned round. Right rows still come first at one time
        numbered = follow(rows, keys, [AT, SIDE, *ties], slice_col=PART, number="_row") if ties else rows
        turned = numbered.withColumns({"_ta": -F.col(AT), "_tp": -F.col(PART), **({"_tr": -F.col("_row")} if ties else {})})
        rows = follow(turned, keys, ["_ta", SIDE, *(["_tr"] if ties else [])], slice_col="_tp", fill={"_after": "_right"}).drop("_ta", "_tp", "_tr", "_row")
    rows = rows.filter(F.col(SIDE) == 1)

    def gap(name: str) -> Column:
        return F.abs(F.col(AT) - F.col(f"{name}.{time}").cast("long"))

    if direction == "nearest":
        ahead = F.col("_before").isNull() | (gap("_after") < gap("_before"))
        rows = rows.withColumn("_before", F.when(F.col("_after").isNotNull() & ahead, F.col("_after")).otherwise(F.col("_before")))
    found = "_after" if direction == "forward" else "_before"
    near = F.col(AT).isNotNull() & (gap(found) <= F.lit(tolerance) if tolerance is not None else F.lit(True))
    return rows.select("_left.*", F.when(near, F.col(found)).alias("match"))


def overlaps(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str = "t_ns", end: str = "t_end_ns", *, rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Pairs of intervals with equal keys that have more than an instant in common: ``keys, left, right, overlap``.

    ``left`` and ``right`` are structs of the sides' columns. Intervals of either side may overlap each other. Of two that
    overlap, one begins while the other lasts; so each side's intervals are numbered by their start, and an interval's partners
    that begin while it lasts are the numbers between two running counts. The other side's intervals lie in arrays of `BLOCK`
    consecutive numbers, and an interval is joined to the arrays its partners are in: pairs are made from these as the last
    step, as many as there are results, and are never moved or written. Empty intervals and null keys or times match nothing.
    """
    def usable(df: DataFrame) -> DataFrame:
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col(start) < F.col(end))
        return df.filter(known).select(*keys, F.col(start).cast("long").alias("_from"), F.col(end).cast("long").alias("_to"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_own"))

    left, right = usable(left), usable(right)
    left, right = kept_once(left), kept_once(right)
    borders = even_borders(left.select("_from").unionAll(right.select("_from")), "_from", rows_per_slice)

    def numbered(df: DataFrame) -> DataFrame:
        """Written once, as it is read three times; ties may be numbered either way, as their partners are the same."""
        cut = df.withColumn(PART, slice_of(borders, "_from"))
        return kept_once(follow(cut, keys, ["_from", "_to"], slice_col=PART, number="_no").drop(PART))

    left, right = numbered(left), numbered(right)

    def beginning(during: DataFrame, others: DataFrame, after: bool) -> DataFrame:
        """(keys, _no, _lo, _hi): the others numbered above _lo and up to _hi begin in [from, to) of an interval, or in (from, to) if ``after``."""
        point = lambda df, at, kind, no: df.select(*keys, F.col(at).alias(AT), F.lit(kind).alias("_kind"), no.alias("_no"))
        none = F.lit(None).cast("int")
        # at one time: ends are asked before others begin, starts before them or after them
        points = point(others, "_from", 0, none).unionAll(point(during, "_to", -1, F.col("_no"))).unionAll(
            point(during, "_from", 1 if after else -2, F.col("_no")))
        cut = points.withColumns({PART: slice_of(borders, AT), "_one": (F.col("_kind") == 0).cast("long"), "_id": F.coalesce("_no", F.lit(0))})
        counted = follow(cut, keys, [AT, "_kind", "_id"], slice_col=PART, total={"_seen": "_one"}).filter("_kind <> 0")
        return counted.groupBy(*keys, "_no").agg(
            F.max(F.when(F.col("_kind") != -1, F.col("_seen"))).alias("_lo"), F.max(F.when(F.col("_kind") == -1, F.col("_seen"))).alias("_hi")).filter("_hi > _lo")

    def paired(during: DataFrame, others: DataFrame, after: bool) -> DataFrame:
        """(keys, _own, _from, _to, _other): each interval with all others that begin while it lasts."""
        row = F.struct("_no", "_own", "_from", "_to")
        ordered = F.array_sort(F.collect_list(row), lambda a, b: (a["_no"] - b["_no"]).cast("int"))
        blocks = others.groupBy(*keys, F.expr(f"(_no - 1) div {BLOCK}").alias("_block")).agg(ordered.alias("_others"))
        asked = beginning(during, others, after).join(during, [*keys, "_no"]).select(
            *keys, F.expr(f"_no div {BLOCK}").alias("_share"), "_own", "_from", "_to", "_lo", "_hi",
            F.explode(F.expr(f"sequence(_lo div {BLOCK}, (_hi - 1) div {BLOCK})")).alias("_block"))
        # a block that very many meet goes out once for each share of them: no group has more than BLOCK * BLOCK pairs
        asked = kept_once(asked)
        met = asked.select(*keys, "_block", "_share").distinct().join(blocks, [*keys, "_block"])
        first = F.greatest(F.col("_lo") - F.col("_block") * BLOCK, F.lit(0))
        last = F.least(F.col("_hi") - F.col("_block") * BLOCK, F.lit(BLOCK))
        partners = F.slice("_others", (first + 1).cast("int"), (last - first).cast("int"))
        return asked.join(met.hint("merge"), [*keys, "_block", "_share"]).select(*keys, "_own", "_from", "_to", F.explode(partners).alias("_other"))

    def sides(pairs: DataFrame, left: str, right: str) -> DataFrame:
        shared = F.least("_to", "_other._to") - F.greatest("_from", "_other._from")
        return pairs.select(*keys, F.col(left).alias("left"), F.col(right).alias("right"), shared.alias("overlap"))

    return sides(paired(left, right, False), "_own", "_other._own").unionByName(sides(paired(right, left, True), "_other._own", "_own"))
