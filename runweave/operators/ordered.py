"""Order-dependent columns that never need a whole group in one task.

A plain window puts all rows of its group into one task. So the caller passes ``slice_col``: a column
that cuts each group into consecutive pieces. The windows then run per piece, and what crosses a
piece border (the next piece's first row, the last known value, the total so far) comes from a table
with one row per piece, made by a map-side combined aggregation. Without ``slice_col`` the plain
window runs: that is for groups the caller knows to be small. The size of the input decides nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def cut_by(df: DataFrame, place: Column, name: str = "piece") -> tuple[DataFrame, str]:
    """``df`` with the slice column ``place``, and that column's name."""
    return df.withColumn(name, place), name


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the cluster's checkpoint folder, for steps that read it twice.

    The folder is shared, so the rows outlive a lost executor. Where the session names none, ``df``
    stays as it is and is computed again when needed.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not folder:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """Where tables that all executors read may be written: the checkpoint folder, or else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def kept_once(*parts: DataFrame) -> DataFrame:
    """Tables of one schema written to the shared folder now and read from there: for what must not be computed twice."""
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


SKETCH = 4096  # items a level of the quantile sketch: ranks are right to less than a thousandth
GRID = 1024    # most slices that borders are asked for at once


def sketch_quantiles(sketch: str) -> str:
    """The values at all ranks of the grid, as the text of an expression."""
    return f"kll_sketch_get_quantile_bigint({sketch}, array({', '.join(f'{i / GRID}D' for i in range(1, GRID))}))"


def even_borders(df: DataFrame, time: str, rows_per_slice: int) -> list[int]:
    """Ascending values of a long column that cut the rows of ``df`` into slices of about equal counts: at most ``GRID`` - 1."""
    told = df.agg(F.count(time).alias("n"), F.expr(f"kll_sketch_agg_bigint({time}, {SKETCH})").alias("sketch")).select(
        "n", F.when(F.col("n") > 0, F.expr(sketch_quantiles("sketch"))).alias("times")).first()
    pieces = min(GRID, -(-told["n"] // rows_per_slice))
    return sorted({told["times"][i * GRID // pieces - 1] for i in range(1, pieces)})


def slice_of(borders: str | Sequence[int], time: str) -> Column:
    """How many of the ascending borders (a column or values) are at or before the time; 0 for a time that is null."""
    borders = F.col(borders) if isinstance(borders, str) else F.array(*map(F.lit, borders)).cast("array<bigint>")
    size = F.coalesce(F.size(borders), F.lit(0))

    def step(place, width):
        ahead = place + width
        return F.when((ahead <= size) & (F.get(borders, ahead - 1) <= F.col(time)), ahead).otherwise(place)

    widths = F.array(*[F.lit(1 << bit) for bit in reversed(range(GRID.bit_length()))])
    return F.when(size == 0, F.lit(0)).otherwise(F.aggregate(widths, F.lit(0), step))


def with_slice(df: DataFrame, name: str, borders: str, time: str) -> DataFrame:
    """``df`` with `slice_of` as a column, for borders that are an array column.

    One step of the search is one projection: these are compiled together with the join that brings the borders, so that the array is not
    copied for every row, which would make a row cost more the more slices there are. A step names the one before it twice and no more (past the
    end, or without borders, ``get`` is null): where the slice is part of a join's key, Spark's optimizer puts all steps into one expression,
    which doubles with each of them.
    """
    df = df.withColumn(name, F.lit(0))
    for bit in reversed(range(GRID.bit_length())):
        step = F.lit(1 << bit)
        df = df.withColumn(name, F.col(name) + F.when(F.get(borders, F.col(name) + step - 1) <= F.col(time), step).otherwise(0))
    return df


def follow(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    slice_col: str | None = None,
    placed: Sequence[str] = (),
    ahead: Mapping[str, str | Column] | None = None,
    behind: Mapping[str, str | Column] | None = None,
    fill: Mapping[str, str | Column] | None = None,
    total: Mapping[str, str | Column] | None = None,
    first: Mapping[str, str | Column] | None = None,
    whole: Mapping[str, str | Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """``df`` with columns that look along the rows of each group ``keys`` in ``order`` (ascending).

    ``ahead`` / ``behind``: value in the following / preceding row. ``fill``: last value that is not
    null, up to the row itself. ``total``: running sum, the row included. ``first``: value in the
    group's first row. ``whole``: sum over the group. ``number``: 1-based row number.
    ``order`` must be total within a group. Pieces of ``slice_col`` must ascend with ``order``.
    Rows with a null key are a group, as in a window: pieces are matched as one struct of key and
    piece, in which nulls are equal. ``placed`` names columns without nulls, each a key or the slice, by
    which the rows are already dealt out, as in a bucketed table: windows then need no exchange.
    """
    asks = {
        name: {out: F.col(c) if isinstance(c, str) else c for out, c in (given or {}).items()}
        for name, given in (
            ("ahead", ahead), ("behind", behind), ("fill", fill), ("total", total), ("first", first), ("whole", whole)
        )
    }
    if slice_col is None:
        return _plain(df, list(keys), list(order), asks, number)
    # Outputs that are the first order column itself: the first and last of a piece are its min and max.
    looks = [*(ahead or {}).items(), *(behind or {}).items(), *(first or {}).items()]
    times = {out for out, c in looks if isinstance(c, str) and c == order[0]}
    place = F.struct(*[F.col(k) for k in keys], F.col(slice_col).alias("_slice_of"))
    grouped = df.withColumns({"_group": F.struct(*keys), "_piece": place})
    return _sliced(grouped, list(order), asks, number, times, list(placed)).drop("_group", "_piece")


def _plain(df, keys, order, asks, number) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(*order)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(*keys)
    new = {}
    new |= {out: F.lead(c).over(along) for out, c in asks["ahead"].items()}
    new |= {out: F.lag(c).over(along) for out, c in asks["behind"].items()}
    new |= {out: F.last(c, ignorenulls=True).over(so_far) for out, c in asks["fill"].items()}
    new |= {out: F.sum(c).over(so_far) for out, c in asks["total"].items()}
    new |= {out: F.first(c).over(so_far) for out, c in asks["first"].items()}
    new |= {out: F.sum(c).over(everything) for out, c in asks["whole"].items()}
    if number:
        new[number] = F.row_number().over(along)
    return df.withColumns(new)


def _sliced(df, order, asks, number, times, placed) -> DataFrame:
    """``_group`` is the struct of the keys, ``_piece`` that of the keys and the slice."""
    place = F.struct(*order)
    piece = [*placed, "_piece"]

    def at_start(out, c):
        return F.min(c) if out in times else F.min_by(c, place)

    def at_end(out, c):
        return F.max(c) if out in times else F.max_by(c, place)

    # One row per piece: what neighbouring pieces need to know of it.
    told = {}
    told |= {f"_{out}": at_start(out, c) for out, c in asks["ahead"].items()}
    told |= {f"_{out}": at_end(out, c) for out, c in asks["behind"].items()}
    told |= {f"_{out}": F.max_by(c, F.when(c.isNotNull(), place)) for out, c in asks["fill"].items()}
    told |= {f"_{out}": F.sum(c) for out, c in (asks["total"] | asks["whole"]).items()}
    told |= {f"_{out}": at_start(out, c) for out, c in asks["first"].items()}
    told["_piece_rows"] = F.count(F.lit(1))
    pieces = df.groupBy(*piece).agg(*[c.alias(out) for out, c in told.items()])

    pieces = pieces.withColumn("_group", F.col("_piece").dropFields("_slice_of"))
    across = Window.partitionBy("_group").orderBy("_piece")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("_group")
    brought = {}
    brought |= {out: F.lead(f"_{out}").over(across) for out in asks["ahead"]}
    brought |= {out: F.lag(f"_{out}").over(across) for out in asks["behind"]}
    brought |= {out: F.last(f"_{out}", ignorenulls=True).over(before) for out in asks["fill"]}
    brought |= {out: F.sum(f"_{out}").over(before) for out in asks["total"]}
    brought |= {out: F.sum(f"_{out}").over(group) for out in asks["whole"]}
    brought |= {
        out: F.first(f"_{out}").over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        for out in asks["first"]
    }
    brought["piece_rows"] = F.sum("_piece_rows").over(before)
    carried = pieces.select(*piece, *[c.alias(f"_from_{out}") for out, c in brought.items()])

    along = Window.partitionBy(*piece).orderBy(*order)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {}
    inside |= {f"_in_{out}": F.lead(F.struct(c.alias("v"))).over(along) for out, c in asks["ahead"].items()}
    inside |= {f"_in_{out}": F.lag(F.struct(c.alias("v"))).over(along) for out, c in asks["behind"].items()}
    inside |= {f"_in_{out}": F.last(c, ignorenulls=True).over(so_far) for out, c in asks["fill"].items()}
    inside |= {f"_in_{out}": F.sum(c).over(so_far) for out, c in asks["total"].items()}
    if number:
        inside["_in_piece_rows"] = F.row_number().over(along)
    joined = df.withColumns(inside).join(carried, piece, "left")

    result = {}
    for out in [*asks["ahead"], *asks["behind"]]:
        neighbour = F.col(f"_in_{out}")
        result[out] = F.when(neighbour.isNotNull(), neighbour["v"]).otherwise(F.col(f"_from_{out}"))
    for out in asks["fill"]:
        result[out] = F.coalesce(f"_in_{out}", f"_from_{out}")
    for out in asks["total"]:
        nothing = F.col(f"_in_{out}").isNull() & F.col(f"_from_{out}").isNull()
        summed = F.coalesce(f"_in_{out}", F.lit(0)) + F.coalesce(f"_from_{out}", F.lit(0))
        result[out] = F.when(~nothing, summed)
    for out in asks["first"]:
        result[out] = F.col(f"_from_{out}")
    for out in asks["whole"]:
        result[out] = F.col(f"_from_{out}")
    if number:
        result[number] = (F.col("_in_piece_rows") + F.coalesce("_from_piece_rows", F.lit(0))).cast("int")
    kept = [c for c in df.columns if c not in result]
    return joined.select(*kept, *[c.alias(out) for out, c in result.items()])


def value_slice(value: str | Column) -> Column:
    """A slice number that ascends with a numeric value, by relative steps of one in ten thousand.

    It needs no look at the data: distinct values spread over many pieces whatever their range.
    Infinities and NaN, the greatest of all as in Spark's order, have pieces of their own.
    """
    value = F.col(value) if isinstance(value, str) else value
    value = value.cast("double")
    ends = F.when(F.isnan(value), F.lit(2**62)).when(value == float("inf"), F.lit(2**61)).when(value == float("-inf"), F.lit(-(2**61)))
    return ends.otherwise((F.signum(value) * F.floor(F.log(1 + F.abs(value) * 1e6) * 1e4)).cast("long"))
