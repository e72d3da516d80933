"""Quantiles, histograms, empirical CDFs and the two-sample test, without collecting a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runweave.operators.ordered import follow, value_slice

SLICE = "value_slice"
EXACT_CELLS = 50_000_000  # of the band of the exact test, about 0.6 microseconds each
TERMS = 30  # of the limiting series: either form is exact to all digits where it is used


def signal_mean(
    df: DataFrame, keys: Sequence[str], value: str, weight_ns: str | None = None
) -> DataFrame:
    """Mean of a signal per key: plain, or weighted by how long each value holds (``weight_ns``)."""
    if weight_ns is None:
        return df.groupBy(*keys).agg(F.avg(value).alias(value))
    held = F.when(F.col(value).isNotNull(), F.col(weight_ns).cast("double"))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value).cast("double") * held), F.sum(held)).alias(value))


def value_counts(df: DataFrame, keys: Sequence[str], value: str, sliced: bool, *aggregates: Column):
    """One row per distinct value of a key, and the slice column to order it by."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        *(aggregates or [F.count(F.lit(1)).alias("_count")])
    )
    if not sliced:
        return counted, None
    return counted.withColumn(SLICE, value_slice(value)), SLICE


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Exact quantiles per key by linear interpolation, one row per key and quantile.

    Values are counted, and the counts of their slices summed. The running total of the slices says
    which of them hold a wanted rank; only the values of those are put in order.
    """
    keys = list(keys)
    group = F.struct(*keys).alias("_group") if keys else F.lit(0).alias("_group")
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_count")
    ).withColumn("_slice", value_slice("_v"))
    totals = counted.groupBy("_group", "_slice").agg(F.sum("_count").alias("n"))
    along = Window.partitionBy("_group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({
        "before": F.coalesce(F.sum("n").over(along), F.lit(0)), "rows": F.sum("n").over(Window.partitionBy("_group")),
    })
    points = F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("quantile")
    asked = totals.select("_group", "_slice", "before", "n", "rows", points).withColumn(
        "at_rank", F.col("quantile") * (F.col("rows") - 1)
    )

    def covers(rank: Column, first: Column, size: Column) -> Column:
        return (rank >= first) & (rank < first + size)

    def either(first: Column, size: Column) -> Column:
        return covers(F.floor("at_rank"), first, size) | covers(F.ceil("at_rank"), first, size)

    asked = asked.filter(either(F.col("before"), F.col("n"))).groupBy("_group", "_slice", "before").agg(
        F.collect_list(F.struct("quantile", "at_rank")).alias("asks")
    )
    inside = Window.partitionBy("_group", "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = counted.join(asked, ["_group", "_slice"]).withColumn(
        "first", F.col("before") + F.coalesce(F.sum("_count").over(inside), F.lit(0))
    )
    near = near.select("_group", "_v", "first", "_count", F.inline("asks")).filter(either(F.col("first"), F.col("_count")))
    ends = near.groupBy("_group", "quantile").agg(
        F.min("_v").alias("low"), F.max("_v").alias("high"), F.first("at_rank").alias("at_rank")
    )
    weight = F.col("at_rank") - F.floor("at_rank")
    found = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * weight)
    return ends.select(*[F.col("_group")[k].alias(k) for k in keys], "quantile", found.cast("double").alias(value))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 40) -> DataFrame:
    """Counts in equal bins between the least and greatest value of all keys; the top value is in the last bin."""
    span = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    binned = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("v"), low.alias("low"), high.alias("high")
    )
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    place = F.floor(F.try_divide(F.col("v") - F.col("low"), width)).cast("long")
    place = F.least(F.coalesce(place, F.lit(0).cast("long")), F.lit(bins - 1).cast("long"))
    counts = binned.groupBy(*keys, place.alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.first("low").alias("low"), F.first(width).alias("width")
    )
    edge = F.col("low") + F.col("bin") * F.col("width")
    return counts.select(*keys, "bin", edge.alias("bin_start"), "count")


def ecdf(df: DataFrame, keys: Sequence[str], value: str, sliced: bool = True) -> DataFrame:
    """Share of the values of a key that are at most each distinct value."""
    counted, slice_col = value_counts(df, keys, value, sliced)
    upto = follow(counted, keys, [value], slice_col=slice_col, total={"upto": "_count"}, whole={"rows": "_count"})
    return upto.select(*keys, value, (F.col("upto") / F.col("rows")).alias("ecdf"))


def two_sample_test(
    df: DataFrame, facets: Sequence[str], value: str, tags: Sequence[str], *, sliced: bool = True, exact: bool = False
) -> DataFrame:
    """Kolmogorov-Smirnov statistic and p-value of each tag's values against the first tag's.

    Values are counted first; the reference tag's counts are then repeated for each other tag, and
    the greatest gap of the two running counts is found in whole numbers. The p-value is that of the
    limiting distribution at every size, or the exact one if asked: its work grows with the greatest
    gap times the product of the sizes.
    """
    facets = list(facets)
    reference, others = tags[0], list(tags[1:])
    counted, slice_col = value_counts(df.filter(F.col("tag").isin(list(tags))), [*facets, "tag"], value, sliced)
    arm = F.when(F.col("tag") == reference, F.array(*[F.lit(t) for t in others])).otherwise(F.array("tag"))
    base = F.when(F.col("tag") == reference, F.col("_count")).otherwise(F.lit(0))
    counted = counted.select(
        *facets, value, *([SLICE] if sliced else []), base.alias("base"), (F.col("_count") - base).alias("own"),
        F.explode(arm).alias("tag"),
    ).groupBy(*facets, "tag", value, *([SLICE] if sliced else [])).agg(F.sum("base").alias("base"), F.sum("own").alias("own"))
    run = follow(
        counted, [*facets, "tag"], [value], slice_col=slice_col,
        total={"base_upto": "base", "own_upto": "own"}, whole={"m": "base", "n": "own"},
    )
    wide = "decimal(19,0)"
    gap = F.abs(F.col("own_upto").cast(wide) * F.col("m").cast(wide) - F.col("base_upto").cast(wide) * F.col("n").cast(wide))
    tested = run.groupBy(*facets, "tag").agg(
        F.max(gap).cast("double").alias("gap"), F.first("n").alias("n"), F.first("m").alias("m")
    ).filter("n > 0 and m > 0")
    d = F.col("gap") / (F.col("n").cast("double") * F.col("m"))
    return tested.select(*facets, "tag", d.alias("ks_d"), two_sample_p("gap", "n", "m", exact).alias("ks_p"))


def two_sample_p(gap: str, n: str, m: str, exact: bool = False) -> Column:
    """P-value for the greatest gap ``gap`` of the cross-multiplied counts of samples of n and m values.

    The limiting distribution has two series: one converges fast for large gaps, the other for small
    ones. Exact, for equal sizes: alternating sum of ratios of binomials. Exact, for unequal ones: share
    of the lattice paths from (0,0) to (n,m) that leave the band, by a recursion over the band's cells; with more
    than ``EXACT_CELLS`` of them an error.
    """
    root = f"(sqrt(cast({n} as double) * {m} / (cast({n} as double) + {m})) * {gap} / (cast({n} as double) * {m}))"
    limiting = F.expr(f"""
      least(1D, greatest(0D, if({root} > 1,
        2 * aggregate(sequence(1, {TERMS}), 0D, (s, k) -> s + if(k % 2 = 1, 1, -1) * exp(-2 * k * k * {root} * {root})),
        1 - sqrt(2 * pi()) / {root} * aggregate(sequence(1, {TERMS}), 0D,
          (s, k) -> s + exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / (8 * {root} * {root}))))))
    """)
    if not exact:
        return F.when(F.col(gap) == 0, 1.0).otherwise(limiting)
    equal = f"""
      least(1D, greatest(0D, 2 * aggregate(
        sequence(1, greatest(1, cast({n} / ({gap} / {n}) as int))), 0D,
        (s, k) -> s + if(k % 2 = 1, 1, -1) * aggregate(
          sequence(1, cast(k * ({gap} / {n}) as int)), 1D,
          (p, j) -> p * ({n} - cast(k * ({gap} / {n}) as int) + j) / ({n} + j)))))
    """
    # Share of paths kept inside the band, by diagonals i + j = d: the cells of the band only, from `low` on.
    low = f"greatest(0L, d - {m}, cast(floor((d * {n} - {gap}) / ({n} + {m})) as bigint) + 1)"
    high = f"least(d, cast({n} as bigint), cast(ceil((d * {n} + {gap}) / ({n} + {m})) as bigint) - 1)"
    lattice = f"""
      1D - element_at(aggregate(
        sequence(1L, cast({n} as bigint) + {m}), named_struct('low', 0L, 'kept', array(1D)),
        (last, d) -> named_struct('low', {low}, 'kept', if({low} > {high}, array(0D), transform(sequence({low}, {high}), i ->
          (coalesce(get(last.kept, cast(i - 1 - last.low as int)), 0D) * i
            + coalesce(get(last.kept, cast(i - last.low as int)), 0D) * (d - i)) / d)))).kept, -1)
    """
    cells = F.when(F.col(n) == F.col(m), F.lit(0.0)).otherwise(2 * F.col(gap))
    small = F.when(cells <= EXACT_CELLS, F.expr(lattice)).otherwise(F.raise_error(F.concat(
        F.lit("the exact test of "), F.col(n).cast("string"), F.lit(" and "), F.col(m).cast("string"),
        F.lit(" values is too much work: ask for exact=False"),
    )).cast("double"))
    return (
        F.when(F.col(gap) == 0, 1.0).when(F.col(n) == F.col(m), F.expr(equal)).otherwise(small)
    )
