"""As-of matches and overlapping intervals against loops, with ties, nulls, one hot key and tiny slices."""

import random
import re

import pytest

from runweave.operators import matching
from runweave.operators.matching import asof, overlaps
from runweave.operators.ordered import even_borders, slice_of

LEFT, RIGHT = "k string, t_ns bigint, a int", "k string, t_ns bigint, n int, b string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    key = lambda: rng.choice(["hot", "hot", "hot", "x", None])
    left = [(key(), rng.choice([None, rng.randrange(60)]), i) for i in range(120)]
    right = [(key(), rng.choice([None] + [rng.randrange(60)] * 5), i, f"r{i}") for i in range(90)]
    return left, right + [("only", 3, 900, "r")]


def best(left, right, direction, tolerance):
    out = []
    for k, t, a in left:
        found = None
        for r in right:
            if t is None or r[1] is None or r[0] != k or (tolerance is not None and abs(t - r[1]) > tolerance):
                continue
            if r[1] <= t and direction != "forward":
                place = (abs(t - r[1]), 0, -r[2])
            elif r[1] >= t and direction != "backward":
                place = (abs(t - r[1]), 1, r[2])
            else:
                continue
            if found is None or place < found[0]:
                found = (place, r)
        out.append((a, found and found[1][2]))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 0, 4])
def test_asof(spark, rows, direction, tolerance):
    left, right = rows
    got = asof(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], direction=direction, tolerance=tolerance, order=["n"], rows_per_slice=7)
    assert got.columns == ["k", "t_ns", "a", "match"]
    assert sorted((r["a"], r["match"] and r["match"]["n"]) for r in got.collect()) == best(left, right, direction, tolerance)


def test_asof_of_empty_sides(spark, rows):
    left, right = spark.createDataFrame(rows[0], LEFT), spark.createDataFrame(rows[1], RIGHT)
    assert asof(left.limit(0), right, ["k"]).count() == 0
    got = asof(left, right.limit(0), ["k"], direction="nearest").collect()
    assert len(got) == len(rows[0]) and all(r["match"] is None for r in got)
    with pytest.raises(ValueError):
        asof(left, right, ["k"], direction="sideways")


def test_overlaps(spark):
    rng = random.Random(2)

    def intervals(n, first):
        out = []
        for i in range(n):
            start = rng.randrange(200)
            out.append((rng.choice(["hot", "hot", "x", None]), rng.choice([start] * 9 + [None]), start + rng.choice([-1, 0, 1, 5, 30, 150]), first + i))
        return out + [("hot", 50, 60, first + n), ("hot", 50, 60, first + n + 1)]

    left, right = intervals(120, 0), intervals(80, 1000)
    schema = "k string, t_ns bigint, t_end_ns bigint, i int"
    got = overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], rows_per_slice=11)
    want = sorted(
        (a[3], b[3], min(a[2], b[2]) - max(a[1], b[1])) for a in left for b in right
        if a[0] is not None and a[0] == b[0] and a[1] is not None and b[1] is not None and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])
    assert sorted((r["left"]["i"], r["right"]["i"], r["overlap"]) for r in got.collect()) == want and len(want) > 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_borders_have_equal_counts(spark):
    values = [1000 + i % 7 for i in range(700)] + [10**12 + i for i in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "t bigint")
    borders = even_borders(df, "t", 100)
    assert borders == sorted(set(borders))
    sizes = df.groupBy(slice_of(borders, "t").alias("s")).count().collect()
    assert max(r["count"] for r in sizes) <= 200
    assert even_borders(df.limit(0), "t", 10) == []


def test_pairs_are_made_last_from_blocks(spark, monkeypatch):
    """Pairs grow with the square of a key's intervals: they are neither exchanged nor written, whatever the size of a block."""
    monkeypatch.setattr(matching, "BLOCK", 4)
    rng = random.Random(3)
    left, right = ([("hot", start, start + rng.randrange(1, 90), i) for i in range(n) for start in [rng.randrange(100)]] for n in (70, 50))
    schema = "k string, t_ns bigint, t_end_ns bigint, i int"
    got = overlaps(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"], rows_per_slice=9)
    want = sorted((a[3], b[3], min(a[2], b[2]) - max(a[1], b[1])) for a in left for b in right if a[1] < b[2] and b[1] < a[2])
    assert sorted((r["left"]["i"], r["right"]["i"], r["overlap"]) for r in got.collect()) == want and len(want) > 1000
    lines = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    made = [i for i, line in enumerate(lines) if "Generate explode(slice" in line]
    assert len(made) == 2
    for i in made:
        depth = len(re.match(r"[\s:+-]*", lines[i]).group())
        above = [x for x in lines[:i] if len(re.match(r"[\s:+-]*", x).group()) < depth]
        assert not [x for x in above if "Exchange" in x or "Join" in x]
