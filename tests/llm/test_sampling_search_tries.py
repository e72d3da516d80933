"""Importance resampling, nearest neighbours and the conversation trie on hand-made rows, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runweave.llm import nearest, oracle, queries, radix, resampling, tries
from tests.side_by_side import connect, difference

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, rank string, score string, _key string, bucket int"


@pytest.mark.parametrize("name", ["op11_resampling", "op13_trie"])
def test_same_rows_as_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = connect(SF).execute(oracle.SQL[name]).fetchdf()
    assert len(got) and difference(got, want) is None


# --- resampling


def features_of(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resampling(docs, target, longest, buckets, seed, least, share):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in features_of(text, longest)[1])
    t = Counter(bucket(f) for text in target for f in features_of(text, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets)))) for b in range(buckets)]
    out = []
    for key, text in docs:
        words, found = features_of(text, longest)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    eligible = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, row in enumerate(eligible[:len(eligible) * share // 100]):
        row[4] = i + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(5)
    vocabulary = "alpha Beta gamma delta eps ZETA eta théta iota kappa 日本 mu nu xi pi rho x1 2024".split() + ["long" * 40, "É" * 70]
    texts = [None, "", " ;! ", "one", "x " * 5000]
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    return texts + texts[10:30]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_by_hand(spark, mixed_texts, longest):
    rows = [(None if i == 7 else (i * 37 % 101) * (-1 if i % 5 == 0 else 1) + i * 1000, t) for i, t in enumerate(mixed_texts)]
    docs = spark.createDataFrame([(k, t, "r", "s", "k", 1) for k, t in rows], DOCS)
    target = ["alpha beta, alpha x1", None, "", "rho RHO pi"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(docs, goal, longest=longest, buckets=97, seed=3, least_words=5, share=40, bits=5, block_rows=7)
    got = Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == plain_resampling(rows, target, longest, 97, 3, 5, 40)


def test_resampling_of_empty_tables(spark, mixed_texts):
    docs = spark.createDataFrame([(i, t, "r", "s", "k", 1) for i, t in enumerate(mixed_texts)], DOCS)
    none = docs.limit(0)
    assert resampling.digest(none, docs).count() == 0
    got = resampling.digest(docs, none)
    assert got.count() == len(mixed_texts)


def test_crc_of_spans():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 63, 64, 65, 300, 5, 5)]
    data, borders = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    state = resampling.extended(np.full(len(texts), 0xFFFFFFFF, np.uint32), data, borders[:-1], borders[1:])
    assert (state ^ np.uint32(0xFFFFFFFF)).tolist() == [zlib.crc32(t) for t in texts]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_radix_ranks(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([-2**63, -1, 0, 1, 2**63 - 1, rng.randrange(-9, 9)]), rng.choice([0, 5, rng.randrange(2**40)]), i) for i in range(150)]
    rows += [(4, 4, 200 + i) for i in range(60)]  # one hot key
    df = spark.createDataFrame(rows, "a bigint, b bigint, i int").repartition(5)
    got = radix.ranked(df, ["a", "b"], bits=9, block_rows=block).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(rows) + 1))
    assert [(r["a"], r["b"]) for r in got] == sorted((a, b) for a, b, _ in rows)
    assert {r["i"] for r in got} == {i for *_, i in rows}


def test_radix_is_stable_and_numbers_equal_rows(spark):
    df = spark.createDataFrame([(1, i) for i in range(20)], "a bigint, i int").coalesce(1)
    got = {r["i"]: r["rank"] for r in radix.ranked(df, ["a"], block_rows=6).collect()}
    assert got == {i: i + 1 for i in range(20)}
    assert radix.ranked(df.limit(0), ["a"]).count() == 0


# --- nearest neighbours


def plain_nearest(rows, k):
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for query in sorted({i for i, _ in rows if i % 100 == 0}):
        best = {}
        for i, v in rows:
            if i != query:
                d = min(math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))) for j, w in rows if j == query)
                best[i] = min(d, best.get(i, math.inf))
        out[query] = sorted((d, i) for i, d in best.items())[:k]
    return out


def asked(key):
    return key % 100 == 0


def test_nearest_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(20).tolist()) for i in range(0, 800, 7)] + [(100, [1.0] * 20), (200, [1.0] * 20)]
    good += [(i, [1.0] * 20) for i in range(300, 330)]            # copies: ties go to the smaller id
    good += [good[3], good[3], (0, [1.0] * 20), (5, [2.0] * 20)]  # repeated rows, and an id with two vectors
    odd = [(900, None), (901, []), (902, [0.0] * 20), (903, [float("nan")] + [1.0] * 19), (904, [float("inf")] * 20), (905, [None] + [1.0] * 19), (None, [1.0] * 20), (1000, [1.0] * 7)]
    vectors = spark.createDataFrame([(i, v, "l", 1) for i, v in good + odd], "vec_id bigint, embedding array<double>, list string, rank int")
    got = defaultdict(list)
    # every list is visited: what is found is exact unless a test abandons a neighbour
    for r in nearest.nearest(vectors, asked, target=1.0, part_rows=5, block_queries=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = plain_nearest(good, 10)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.97 * 10 * len(want)
    assert [i for _, i in got[200]] == [i for _, i in want[200]] and got[200][0] == (0.0, 0)
    assert all(len(rows) == 10 for rows in got.values())


def test_nearest_of_few_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert nearest.digest(spark.createDataFrame([], schema)).count() == 0
    assert nearest.digest(spark.createDataFrame([(0, [1.0])], schema)).count() == 0
    got = nearest.digest(spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 3.0]), (4, [1.0, 2.0])], schema)).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 4, 2.0), (0, 2, 3, 3.0)]


def test_recall_and_abandonment():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((30, 64))
    candidates = np.repeat(centers, 100, axis=0) + 0.3 * rng.standard_normal((3000, 64))
    asking = candidates[::60] + 0.1 * rng.standard_normal((50, 64))
    turn = nearest.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    q, c = nearest.scanned(asking @ turn, candidates @ turn, 10)
    true = np.argsort(nearest.squared(asking, candidates), axis=1)[:, :10]
    left = [set(c[q == i]) for i in range(50)]
    assert sum(len(left[i] & set(true[i])) for i in range(50)) >= 0.97 * 500
    assert len(q) < 50 * 3000 / 20  # most candidates are abandoned


def test_recall_of_the_search(spark):
    """Against brute force, on vectors without clusters: the hardest for lists."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((3000, 48))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<double>")
    got = defaultdict(set)
    for r in nearest.digest(df).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for i in range(0, 3000, 100):
        d = ((v - v[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10]) & got[i])
    assert hits >= 0.9 * 300


# --- trie


def plain_trie(rows):
    stored = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            stored[c].append((turn is not None, turn or 0, sha, role, text))
    rebuilt = {}
    for c in stored:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        turns = sorted(stored.get(base, []))[:h] + sorted(stored[c])[h:]
        rebuilt[c] = tuple(t[3:] for t in turns)
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    out = []
    for node, cs in members.items():
        under = [m for m in members if m[:len(node)] == node]
        kids = lambda x: [m for m in members if len(m) == len(x) + 1 and m[:len(x)] == x]
        words = lambda m: len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) if m else 0
        ends = ",".join(str(c) for c in cs if rebuilt[c] == node)
        out.append((
            cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(kids(node)), sum(not kids(m) for m in under),
            sum((len(members[m]) - 1) * words(m) for m in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


CONV = "conv_id bigint, turn bigint, role string, text string, depth int, f0 string, part string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_rows():
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 90), -25, -20, -3, 207, 2**40 + 20, 2**40 + 21]:
        if c in (40, 41):
            continue  # a base that is absent
        shared = rng.random() < 0.5
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, t if t else rng.choice([None, 0]), rng.choice(["user", "user", None, ""]), f"turn {t} of all" if shared else rng.choice([None, "", "a b c \n d", "same"])))
    rows += [(60, 2, "user", "tie one"), (60, 2, "user", "tie two"), (60, 2, "user", "tie two"), (None, 1, "user", "nobody")]
    return rows


@pytest.mark.parametrize("piece", [1, 2, 1 << 16])
def test_trie_by_hand(spark, piece):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, 1, "f", "p") for r in rows], CONV)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in tries.trie(df, piece).collect()), key=lambda r: (r[1], r[0]))
    assert got == plain_trie(rows)


def test_trie_of_many_equal_ones(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 3000) for t in range(2)]
    df = spark.createDataFrame([(*r, 1, "f", "p") for r in rows], CONV)
    got = {r["depth"]: r for r in tries.digest(df).collect()}
    assert len(got) == 3 and got[2]["n_convs"] == 3000 and got[0]["n_leaves"] == 1
    assert got[2]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()


def test_trie_takes_another_seed_when_hashes_collide(spark, monkeypatch):
    monkeypatch.setattr(tries, "FIELDS", (3, 5))
    monkeypatch.setattr(tries, "RADICES", (2, 2))
    df = spark.createDataFrame([(c, 0, "u", f"{c}", 1, "f", "p") for c in range(60)], CONV)
    with pytest.raises(RuntimeError, match="collide"):
        tries.trie(df)


def test_trie_of_an_empty_table(spark):
    assert tries.digest(spark.createDataFrame([], CONV)).count() == 0
