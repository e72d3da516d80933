"""Sliced ordered work gives what a plain window does, and what pandas does."""

import random

import pytest
from pyspark.sql import functions as F

from runweave.operators.ordered import follow, value_slice

ASKS = dict(
    ahead={"next_t": "t", "next_v": "v"}, behind={"was_v": "v"}, fill={"held": "v"}, total={"upto": "n"},
    first={"first_v": "v"}, whole={"rows": "n"}, number="nth",
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        # one key holds most rows, some keys have one, several rows share a time
        key = "hot" if i % 3 else f"k{rng.randrange(40)}"
        v = None if rng.random() < 0.4 else rng.randrange(100)
        data.append((key, rng.randrange(200), i, v, rng.randrange(-3, 4)))
    return spark.createDataFrame(data, "key string, t long, seq long, v long, n long")


def collected(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("width", [1, 7, 50, 1000])
def test_slices_do_not_change_results(rows, width):
    plain = follow(rows, ["key"], ["t", "seq"], **ASKS)
    cut = rows.withColumn("piece", F.floor(F.col("t") / width))
    sliced = follow(cut, ["key"], ["t", "seq"], slice_col="piece", **ASKS).drop("piece")
    assert collected(sliced) == collected(plain)


def test_null_keys(spark):
    data = [(None, t, t, t, 1) for t in range(20)] + [("a", t, t, None, 2) for t in range(20)]
    rows = spark.createDataFrame(data, "key string, t long, seq long, v long, n long")
    plain = follow(rows, ["key"], ["t", "seq"], **ASKS)
    cut = rows.withColumn("piece", F.floor(F.col("t") / 6))
    sliced = follow(cut, ["key"], ["t", "seq"], slice_col="piece", **ASKS).drop("piece")
    assert collected(sliced) == collected(plain)


def test_against_pandas(rows):
    pdf = rows.toPandas().sort_values(["key", "t", "seq"])
    g = pdf.groupby("key")
    want = pdf.assign(
        next_t=g.t.shift(-1), was_v=g.v.shift(1), held=g.v.ffill(), upto=g.n.cumsum(), nth=g.cumcount() + 1,
    )
    cut = rows.withColumn("piece", F.floor(F.col("t") / 13))
    got = follow(cut, ["key"], ["t", "seq"], slice_col="piece", **ASKS).toPandas().sort_values(["key", "t", "seq"])
    for column in ("next_t", "was_v", "held", "upto", "nth"):
        assert got[column].astype(float).fillna(-99).tolist() == want[column].astype(float).fillna(-99).tolist()


def test_value_slices_ascend_with_values(spark):
    values = sorted([-1e9, -3.5, -1e-7, 0.0, 1e-9, 1.0, 1.00001, 2.0, 1e6, 1e6 + 1, 1e18])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_slice("v").alias("s"))
    slices = [r.s for r in df.orderBy("v").collect()]
    assert slices == sorted(slices)


def test_null_keys_are_a_group_in_slices(spark):
    rows = [(None if i % 3 else "a", i, i) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, t int, n int").withColumn("piece", F.floor(F.col("t") / 7))
    plain = follow(df, ["key"], ["t"], ahead={"after": "t"}, total={"upto": "n"}, number="nth")
    cut = follow(df, ["key"], ["t"], slice_col="piece", ahead={"after": "t"}, total={"upto": "n"}, number="nth")
    assert sorted(map(str, cut.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_not_a_number_has_the_last_slice(spark):
    values = [float("-inf"), -1.0, 0.0, 1e300, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", value_slice("v").alias("s"))
    slices = [r.s for r in df.orderBy("i").collect()]
    assert slices == sorted(slices) and len(set(slices)) == 6
