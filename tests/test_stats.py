"""Statistics, labels and the two-sample test against counting by hand."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from runweave.functions import text
from runweave.functions.stats import statistics
from runweave.operators.distribution import ecdf, histogram, quantiles, two_sample_p, two_sample_test
from runweave.operators.reshape import roll_up_channels
from runweave.plans.compare import asked, compare_runs, compare_stacked, comparison_order, series, series_order
from runweave.plans.metrics import sort_by_clusters
from runweave.trace import Trace


def test_gmean_of_zero_negative_equal(spark):
    df = spark.createDataFrame(
        [("zero", 0.0), ("zero", 2.0), ("neg", -1.0), ("neg", 2.0), ("same", 1.1), ("same", 1.1), ("two", 2.0),
         ("two", 8.0), ("null", None)],
        "k string, v double",
    )
    got = {r.k: r for r in df.groupBy("k").agg(*statistics("v")).collect()}
    assert got["zero"].gmean == 0.0 and got["neg"].gmean is None and got["same"].gmean == 1.1
    assert got["two"].gmean == pytest.approx(4.0) and got["null"].gmean is None
    assert got["two"].std == pytest.approx(math.sqrt(18)) and got["two"].sem == pytest.approx(3.0)


def exact_p(a, b):
    """Share of all ways to split the pooled values whose gap is at least the one seen."""
    n, m = len(a), len(b)

    def gap(first, second):
        points = set(first) | set(second)
        return max(abs(sum(x <= p for x in first) * m - sum(x <= p for x in second) * n) for p in points)

    pooled, seen = a + b, gap(a, b)
    hits = total = 0
    for chosen in itertools.combinations(range(n + m), n):
        first = [pooled[i] for i in chosen]
        second = [pooled[i] for i in range(n + m) if i not in chosen]
        hits += gap(first, second) >= seen
        total += 1
    return seen, hits / total


@pytest.mark.parametrize("a,b", [
    ([1, 2, 3], [4, 5, 6]), ([1, 4, 6], [2, 3, 5]), ([1, 2, 3, 9], [4, 5, 6, 7, 8]), ([5], [1, 2, 3]),
    ([1, 3, 5, 7, 9, 11], [2, 4, 6, 8]), ([1, 2, 3, 4, 5], [6, 7, 8, 9, 10]),
])
def test_two_sample_test(spark, a, b):
    rows = [("base", float(v)) for v in b] + [("new", float(v)) for v in a]
    df = spark.createDataFrame([(t, "f", v) for t, v in rows], "tag string, facet string, v double")
    got = two_sample_test(df, ["facet"], "v", ["base", "new"], exact=True).collect()[0]
    gap, p = exact_p(a, b)
    assert got.ks_d == pytest.approx(gap / (len(a) * len(b)))
    assert got.ks_p == pytest.approx(p, abs=1e-12)


def test_two_sample_test_of_a_null_facet(spark):
    rows = [(t, None, float(v)) for t, vs in (("base", range(6)), ("new", range(3, 9))) for v in vs]
    df = spark.createDataFrame(rows, "tag string, facet string, v double")
    for sliced in (True, False):
        got = two_sample_test(df, ["facet"], "v", ["base", "new"], sliced=sliced, exact=True).collect()
        assert [(r.facet, r.tag, r.ks_d) for r in got] == [(None, "new", 0.5)]


def test_p_by_the_limiting_distribution(spark):
    def limit(n, m, d):
        lam = math.sqrt(n * m / (n + m)) * d
        if lam < 0.2:
            return 1.0
        return 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 400))

    sizes = [(400, 400, 0.1), (500, 500, 0.06), (501, 501, 0.06), (200, 199, 0.1), (201, 200, 0.1), (10**6, 10**6 + 1, 1e-6), (10**7, 10**7, 1e-7), (3000, 5000, 0.02)]
    df = spark.createDataFrame([(float(d * n * m), n, m, limit(n, m, d)) for n, m, d in sizes], "gap double, n long, m long, want double")
    for r in df.select("want", two_sample_p("gap", "n", "m").alias("p")).collect():
        assert r.p == pytest.approx(r.want, abs=1e-9)


def test_nearly_equal_large_samples(spark):
    base, more = spark.range(300_000), spark.range(300_001)
    rows = base.select(F.lit("base").alias("tag"), F.col("id").cast("double").alias("v")).unionAll(
        more.select(F.lit("more"), F.col("id").cast("double"))).withColumn("f", F.lit("x"))
    assert two_sample_test(rows, ["f"], "v", ["base", "more"]).first().ks_p == 1.0


def test_quantiles(spark):
    df = spark.range(0, 1000).select(
        F.nullif(F.col("id") % 3, F.lit(2)).alias("k"), F.pmod(F.col("id") * 7919, F.lit(503)).cast("double").alias("v")
    )
    at = (0.0, 0.5, 0.9, 0.95, 0.99, 1.0)
    got = {(r.k, r.quantile): r.v for r in quantiles(df, ["k"], "v", at).collect()}
    built_in = df.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in at])).alias("p")).collect()
    want = {(r.k, q): v for r in built_in for q, v in zip(at, r.p)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_labels_of_large_and_negative_numbers(spark):
    df = spark.createDataFrame([(-2.5e7,), (2.5e17,), (1e-9,), (-1e-4,), (12340.0,), (0.0,)], "v double")
    got = [tuple(r) for r in df.select(text.human_number("v"), text.percent("v")).collect()]
    assert got == [("-25000000.0", "-25000000.0%"), ("250000000.0B", "250000000000000000.0%"), ("0.0μ", "0.0%"), ("-100.0μ", "0.0%"),
                   ("12.34k", "12340.0%"), ("0.0", "0.0%")]


def test_histogram_and_ecdf(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 10.0), ("b", 5.0), ("b", None)], "tag string, v double")
    bins = {(r.tag, r.bin): (r.bin_start, r["count"]) for r in histogram(df, ["tag"], "v", 4).collect()}
    assert bins == {("a", 0): (0.0, 1), ("a", 3): (7.5, 1), ("b", 2): (5.0, 1)}
    one_value = histogram(spark.createDataFrame([("a", 2.0), ("a", 2.0)], "tag string, v double"), ["tag"], "v")
    assert [(r.bin, r["count"]) for r in one_value.collect()] == [(0, 2)]
    steps = {(r.tag, r.v): r.ecdf for r in ecdf(df, ["tag"], "v").collect()}
    assert steps == {("a", 0.0): 0.5, ("a", 10.0): 1.0, ("b", 5.0): 1.0}


def test_labels(spark):
    numbers = [2.5e9, 3.25e6, 12_345.0, 9_999.5, 0.0, 0.005, -0.005, -12.5]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert [r.s for r in df.select(text.human_number("x").alias("s")).collect()] == [
        "2.5B", "3.25M", "12.35k", "9999.5", "0.0", "5000.0μ", "-5000.0μ", "-12.5"
    ]
    marks = spark.createDataFrame(
        [(10.0, 1.5, 0.01), (10.0, -1.5, 0.5), (10.0, 0.0, None), (10.0, None, None)], "v double, c double, p double"
    )
    assert [r.s for r in marks.select(text.marked_change("v", "c", "p").alias("s")).collect()] == [
        "10.0 * (+1.5%)", "10.0 (-1.5%)", "10.0 (0.0%)", "10.0"
    ]


def test_names(spark):
    runs = ["speedometer_baseline_10_0812", "gb_ufc_feec_all_3_3001", "short_1", "plain", "w_x_1_0101"]
    df = spark.createDataFrame([(r,) for r in runs], "r string")
    assert [r.t for r in df.select(text.run_tag("r").alias("t")).collect()] == ["baseline", "ufc_feec_all", "", "", "x"]
    tasks = spark.createDataFrame([("[12:a:b]",), ("[-1:x]",)], "t string")
    assert [r.c for r in tasks.select(text.task_comm("t").alias("c")).collect()] == ["a:b", "x"]


def test_compare_runs(spark):
    data = [(t, i, c, v) for t, c, vs in (
        ("base", "little", (1.0, 2.0, 4.0)), ("new", "little", (2.0, 4.0, 8.0)), ("new", "big", (3.0, 3.0, 3.0))
    ) for i, v in enumerate(vs)]
    df = spark.createDataFrame(data, "tag string, iteration int, cluster string, value double")
    got = {(r.tag, r.cluster): r for r in compare_runs(df, ["base", "new"], ["cluster"]).collect()}
    assert got["base", "little"].value == 2.0 and got["base", "little"].perc_diff == 0.0
    assert got["base", "little"].ks_p is None and not got["base", "little"].significant
    assert got["new", "little"].perc_diff == pytest.approx(100.0) and got["new", "little"].bar_label == "4.0 (+100.0%)"
    assert got["new", "big"].perc_diff is None and got["new", "big"].bar_label == "3.0"
    assert got["new", "big"].order_cluster == 2 and got["new", "big"].unit == "x"
    alone = compare_runs(df, ["new"], ["cluster"])
    assert "perc_diff" not in alone.columns and alone.count() == 2
    own = compare_runs(df, ["base", "new"], ["cluster"], stats={"top": F.max})
    assert {r.top for r in own.filter("tag = 'new'").collect()} == {8.0, 3.0}


def test_stacked_comparison_is_that_of_each_part(spark):
    tags = ["base", "new"]
    one = spark.createDataFrame(
        [(t, i, c, "ms", float(v + i)) for t, v in (("base", 3), ("new", 5)) for c in ("little", None) for i in range(4)],
        "tag string, iteration int, cluster string, unit string, value double")
    two = spark.createDataFrame([(t, i, 7 + i % 2, float(i + len(t))) for t in ("base", "new", "else") for i in range(6)],
                                "tag string, iteration int, cpu int, time double")
    three = two.limit(0)
    parts = {"one": asked(one, tags, ["cluster"]), "two": asked(two, tags, ["cpu"], "time", digits=0),
             "three": asked(three, tags, ["cpu"], "time")}
    shown = ["tag", "n", "value", "std", "sem", "perc_diff", "ks_d", "ks_p", "bar_label"]
    got = compare_stacked(parts, tags)
    assert {r.block for r in got.collect()} == {"one", "two"}
    for name, df, facet, value, digits in (("one", one, "cluster", "value", 1), ("two", two, "cpu", "time", 0)):
        want = compare_runs(df, tags, [facet], value, digits=digits)
        own = got.filter(F.col("block") == name).select(F.col("facet")[facet].alias("f"), *shown)
        assert sorted(map(str, own.collect())) == sorted(map(str, want.select(F.col(facet).cast("string").alias("f"), *shown).collect()))


def test_exact_p_of_thousands_of_values(spark):
    row = spark.createDataFrame([(0.03 * 3000 * 2999, 3000, 2999), (3.0, 6, 4)], "gap double, n long, m long")
    exact, small = [r.p for r in row.select(two_sample_p("gap", "n", "m", True).alias("p")).collect()]
    limit = row.select(two_sample_p("gap", "n", "m").alias("p")).first().p
    assert exact == pytest.approx(limit, abs=5e-3) and 0 <= small <= 1
    many = spark.createDataFrame([(5e7, 30_000, 20_000)], "gap double, n long, m long")
    with pytest.raises(Exception, match="too much work"):
        many.select(two_sample_p("gap", "n", "m", True)).collect()


def test_row_orders(spark):
    df = spark.createDataFrame(
        [("w", "k", i, c, 1.0) for i in (2, 1) for c in ("big", "little", "mid")],
        "wa_path string, kernel string, iteration int, cluster string, v double",
    )
    trace = Trace(spark, {}, df.select("wa_path", "kernel").distinct())
    got = [(r.iteration, r.cluster) for r in sort_by_clusters(trace, df, ["v"]).collect()]
    assert got == [(i, c) for i in (1, 2) for c in ("little", "mid", "big")]
    values = df.withColumns({"tag": F.concat(F.lit("t"), F.col("iteration")), "value": F.col("iteration") * 1.0})
    table = compare_runs(values, ["t2", "t1"], ["cluster"])
    got = [(r.cluster, r.tag) for r in comparison_order(table, order_cluster=True).collect()]
    assert got == [(c, t) for c in ("little", "mid", "big") for t in ("t2", "t1")]
    assert [r.tag for r in comparison_order(table, ["tag", "cluster"]).collect()] == ["t1"] * 3 + ["t2"] * 3


def test_series_in_run_order(spark):
    df = spark.createDataFrame([("b", 2, 1.0), ("a", 1, 2.0), ("b", 1, 3.0)], "tag string, iteration int, value double")
    got = series_order(series(df, ["b", "a"])).collect()
    assert [(r.tag, r.iteration, r.order_tag) for r in got] == [("b", 1, 0), ("b", 2, 0), ("a", 1, 1)]


def test_roll_up_keeps_a_channel_of_that_name(spark):
    df = spark.createDataFrame([("CPU", 1.0), ("CPU(big)", 2.0), ("GPU", 4.0)], "channel string, power double")
    got = sorted((r.channel, r.power) for r in roll_up_channels(df.withColumn("k", F.lit(1)), ["k"], "power").collect())
    assert got == [("CPU", 1.0), ("CPU", 3.0), ("CPU(big)", 2.0), ("GPU", 4.0), ("Total", 7.0)]


def mean_of_parts():
    from runweave.functions.stats import Mergeable

    return Mergeable(lambda: (0.0, 0), lambda s, v: (s[0] + v.sum(), s[1] + len(v)), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: s[0] / s[1] if s[1] else None)


def test_python_statistics(spark, monkeypatch):
    import numpy as np

    from runweave.functions import stats

    rows = [(g, v) for g in ("a", "b", None) for v in (1.0, 2.0, 9.0, None)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = stats.python_statistics(df, ["g"], "v", {"mean": mean_of_parts(), "middle": stats.Whole(np.median)})
    assert {r["g"]: (r["mean"], r["middle"]) for r in got.collect()} == {"a": (4.0, 2.0), "b": (4.0, 2.0), None: (4.0, 2.0), "none": (None, None)}
    everything = stats.python_statistics(df, [], "v", {"mean": mean_of_parts()}).collect()
    assert [r["mean"] for r in everything] == [4.0]


def test_python_statistics_of_many_groups(spark):
    from runweave.functions import stats

    df = spark.range(60_000).selectExpr("id % 25000 as g", "cast(id as double) as v")
    got = stats.python_statistics(df, ["g"], "v", {"mean": mean_of_parts()})
    want = df.groupBy("g").agg({"v": "avg"})
    assert got.join(want, "g").filter("mean <> `avg(v)`").count() == 0 and got.count() == 25_000


def test_kinds_of_statistics(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from runweave.functions import stats

    columns, python = stats.split_statistics({"a": F.max, "b": lambda v: np.sort(v)[0], "c": mean_of_parts(), "d": np.median, "e": lambda v: F.sum(v) / 2})
    assert set(columns) == {"a", "e"} and set(python) == {"b", "c", "d"}
