"""Ranks of rows by a distributed LSD radix sort, in DataFrame functions.

**Passes.** The key is a list of long columns, the first the most significant; it is cut into digits of `BITS` bits, of
which those that are the same in all rows are left out. From the last digit to the first, each pass is a stable counting
sort: the order so far is cut into blocks, rows are counted per digit and block, prefix sums over (digit, block) say where
each digit of each block begins in the new order, and a row's place in it is that offset and its rank among the block's
rows of its digit. After the last pass the place is the final rank.

**Scale.** A pass moves the rows once, by (digit, block): no group is larger than a block, whatever the keys are, so ties and
hot keys are nobody's single task. Offsets come from map-side counts; only the totals of the 2^BITS digits meet in one task,
and a digit's window has one row a block. Each pass ends in the shared checkpoint folder, so a lost executor costs a part of
one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runweave.llm.storage import checkpointed

BITS = 11
BLOCK_ROWS = 1 << 20
LEAST_BLOCK_ROWS = 1 << 12
SIGN = -(1 << 63)


def _unsigned(key: str) -> F.Column:
    """The bits of a long in an order that is unsigned."""
    return F.col(key).bitwiseXOR(F.lit(SIGN))


def digits(rows: DataFrame, keys: list[str], bits: int = BITS) -> tuple[int, list[tuple[str, int]]]:
    """The number of rows and (column, shift) of all digits that are not the same in all rows, the last digit first."""
    seen = rows.agg(F.count("*"), *(f(_unsigned(k)) for k in keys for f in (F.bit_or, F.bit_and))).first()
    found = []
    for i, key in reversed(list(enumerate(keys))):
        some, every = seen[1 + 2 * i], seen[2 + 2 * i]
        varying = ((some ^ every) if seen[0] else 0) % (1 << 64)
        found += [(key, shift) for shift in range(0, 64, bits) if varying >> shift & ((1 << bits) - 1)]
    return seen[0], found


def _pass(rows: DataFrame, key: str, shift: int, bits: int, block_rows: int) -> DataFrame:
    digit = F.shiftrightunsigned(_unsigned(key), shift).bitwiseAND(F.lit((1 << bits) - 1))
    placed = rows.withColumns({"_digit": digit, "_block": F.expr(f"_at DIV {block_rows}L")})
    counts = placed.groupBy("_digit", "_block").count()
    totals = counts.groupBy("_digit").agg(F.sum("count").alias("n"))
    before = totals.select("_digit", F.coalesce(F.sum("n").over(
        Window.orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_less"))
    inside = F.coalesce(F.sum("count").over(
        Window.partitionBy("_digit").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_digit", "_block", inside.alias("_earlier")).join(before, "_digit").select(
        "_digit", "_block", (F.col("_less") + F.col("_earlier")).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_digit", "_block").orderBy("_at")) - 1
    moved = placed.withColumn("_own", own).join(starts, ["_digit", "_block"])
    kept = [F.col(f"`{c}`") for c in rows.columns if c != "_at"]
    return checkpointed(moved.select(*kept, (F.col("_start") + F.col("_own")).cast("bigint").alias("_at")))


def ranked(rows: DataFrame, keys: list[str], rank: str = "rank", bits: int = BITS, block_rows: int | None = None) -> DataFrame:
    """rows and `rank`: 1, 2, 3, ... in ascending order of the long columns `keys` (without nulls).

    Rows with equal keys have consecutive ranks. `_at`, `_digit`, `_block`, `_own` and `_start` must not be columns of rows.
    An empty table gives no rows; a table in which no key differs is numbered as it stands.
    """
    work = checkpointed(rows.withColumn("_at", F.monotonically_increasing_id()))
    n, found = digits(work, keys, bits)
    size = block_rows or min(BLOCK_ROWS, max(LEAST_BLOCK_ROWS, n // 64))
    for key, shift in found or ([(keys[0], 0)] if n else []):
        work = _pass(work, key, shift, bits, size)
    return work.withColumn(rank, F.col("_at") + 1).drop("_at")
