"""Every operator on hand-made rows (nulls, empty and long texts, ties, repeats, odd columns, empty tables) against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runweave.llm import bpe, decontaminate, graph, licenses, lines, minhash, passages, quality, sharding, spread, suffixes, toxicity
from runweave.llm import textbytes as tb
from runweave.llm.settings import vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, hits int, shard string, `_drop` int, n_words string, score string"
BENCH = "item_id bigint, text string"


def words(text, kind=r"[^\x20\x09-\x0D]+"):
    return re.findall(kind, (text or "").translate(LOWER))


def made_up(n, seed, size=400):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()) + str(rng.randrange(size)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base, other = made_up(120, 1), made_up(90, 2)
    edited = base.split()
    edited[50] = "changed"
    passage = made_up(60, 3)
    return [
        None, "", "   \n\t ", "one", "Mit License", base, base, base.upper(), " ".join(edited), other + " " + passage, passage + "\n" + made_up(70, 4),
        "ab" * 300, "-" * 500, "line one\nline one\nline two", "Grüße, señor! " * 30, made_up(4000, 5), "x " * 80, "licensed under the CC BY 4.0 license. " + made_up(60, 6),
        "a\x00b " * 40, "<|endoftext|> and 'll don't 日本語 \U0001F600 ½",
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None, "k", i, "z", 1, "w", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_shingles_by_hand(texts):
    for kind, pattern in ((tb.SPACED, r"[^\x20\x09-\x0D]+"), (tb.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, borders = tb.packed(pa.array(texts))
        data = tb.LOWER[data]
        starts, ends, firsts = tb.words(data, borders, kind)
        got = [[bytes(data[s:e]).decode() for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(firsts[:-1], firsts[1:])]
        assert got == [words(t, pattern) for t in texts]


def test_suffix_order_of_random_texts():
    rng = np.random.default_rng(3)
    for _ in range(40):
        parts = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        text, borders = np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        suffix = {int(borders[i]) + k: p[k:] for i, p in enumerate(parts) for k in range(len(p))}
        order = suffixes.suffix_order(text, borders, depth=50).tolist()
        assert sorted(order) == list(range(len(text))) and [suffix[i] for i in order] == sorted(suffix.values())


def brute_suffixes(rows):
    seen, out = set(), {}
    for i, text in rows:
        data = (text or "").encode()
        covered = bytearray(len(data))
        for p in range(len(data) - 99):
            s = data[p:p + 100]
            if s in seen:
                covered[p:p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, c in zip(data, covered) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (not k or not covered[k - 1]))
        out[i] = (len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [5000, 1])
def test_suffixes(docs, texts, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_SEGMENTS", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.digest(docs).collect()}
    assert got == brute_suffixes(enumerate(texts))


def test_suffixes_of_null_ids_and_repeated_rows(spark):
    text = made_up(60, 9)
    rows = spark.createDataFrame([(None, text), (7, text), (7, text)], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffixes.digest(rows).collect())
    assert got == [(-1, len(text)), (7, 0), (7, 0)]


@pytest.mark.parametrize("shared", [200_000, 0])
def test_suffixes_of_unlike_texts_without_an_id(spark, monkeypatch, shared):
    monkeypatch.setattr(suffixes, "SHARED_IDS", shared)
    kept, lost, own, other = made_up(60, 9), made_up(70, 10), made_up(80, 11), made_up(90, 12)
    rows = [(1, lost), (None, lost), (None, own), (None, own), (3, kept), (3, other), (3, f"{other} {kept}")]
    got = {}
    for r in suffixes.spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.n_bytes, len(r.kept)))
    assert got[1] == [(len(lost), len(lost))]
    assert sorted(got[None]) == sorted([(len(lost), 0), (len(own), len(own)), (len(own), len(own))])
    # three texts of one id: one of two that share a passage gives it up, and nothing else is lost
    assert sum(k for _, k in got[3]) in range(len(kept) + len(other), len(kept) + len(other) + 3)


def test_spread_join(spark):
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 1), (None, 3), (4, 2)) for i in range(n)], "k bigint, i int")
    facts = rows.groupBy("k").count().filter("k is null or k <> 4").withColumn("x", F.lit("f"))
    want = sorted(map(tuple, rows.join(facts, "k").select("k", "i", "x").collect()))
    for heavy in (1, 3, 10_000):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(spread, "HEAVY", heavy)
            got = spread.spread_join(rows, facts, ["k"], "count").select("k", "i", "x")
            assert sorted(map(tuple, got.collect())) == want and len(want) == 51


def test_licenses(docs, texts):
    got = {r.doc_id: r for r in licenses.digest(docs).collect()}
    assert got[4].base_labels == "mit" and got[4].n_base == 1 and got[4].first_word == got[4].last_word == 0 and got[4].score == 0.5
    assert got[17].labels == "cc-by,cc-by-4.0" and got[17].score == 1.0
    assert got[0].n_words == 0 and got[0].labels == "" and got[0].first_word is None


@pytest.mark.parametrize("template, text, size", [
    ("a b [[c [[d]] e]] f", "a b f", 3), ("a b [[c [[d]] e]] f", "a b c e f", 5), ("a b [[c [[d]] e]] f", "a b c d e f", 6), ("a b [[c [[d]] e]] f", "a b c f", 0),
    ("a b {{x:2-3}} c", "a b p q c", 5), ("a b {{x:2-3}} c", "a b p c", 0), ("a b {{x:2-3}} c", "a b p q r c", 6), ("a b {{x:2-3}} c", "a b p q r s c", 0),
    ("a b {{x:0-2}} [[c]]", "a b z", 3), ("a b [[a b]]", "a b a", 2),
])
def test_template_markup(template, text, size):
    scanner = licenses.Scanner([("l", template)])
    numbers = scanner.numbers(licenses.word_hashes(text.split())).tolist()
    assert scanner.automata[0].longest(numbers) == size


@pytest.mark.parametrize("block", [60_000, 20])
def test_decontamination(spark, docs, texts, block):
    items = [(1, " ".join(texts[15].split()[100:140])), (22, "ONE"), (3, None), (4, ""), (22, "one"), (5, "Grüße señor"), (6, made_up(30, 77))]
    bench = spark.createDataFrame(items, BENCH)
    got = {r.doc_id: r for r in decontaminate.judged(decontaminate.matches(docs, bench, limit=block)).collect()}
    for i, text in enumerate(texts):
        doc, hit, found = words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set(), set()
        for item, t in items:
            w = words(t, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
            n = min(13, len(w))
            for a, p in itertools.product(range(len(w) - n + 1 if n else 0), range(len(doc))):
                if doc[p:p + n] == w[a:a + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
        assert (got[i].n_words, got[i].n_hit, list(got[i].items)) == (len(doc), len(hit), sorted(found))
        assert got[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(doc))
    left = decontaminate.removed(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in got if not got[i].contaminated}


def test_proximity(spark):
    item = made_up(13, 50)
    w = item.split()
    loose = " ".join([*w[:6], "in", "between", *w[6:]])
    docs = spark.createDataFrame([(1, loose)], "doc_id bigint, text string")
    hits = decontaminate.matches(docs, spark.createDataFrame([(9, item)], BENCH)).first().hits
    assert [(h["item"], h["exact"]) for h in hits] == [("9", False)]


@pytest.mark.parametrize("parts", [1, 3])
def test_proximity_with_a_replaced_word_in_any_deal_of_documents(spark, parts):
    item = made_up(13, 50)
    w = item.split()
    rows = [(i, " ".join([made_up(20, 300 + i), *w[:i], "replaced", *w[i + 1:], made_up(20, 330 + i)])) for i in range(13)]
    rows += [(20, " ".join(w[:12])), (21, made_up(60, 360)), (22, " ".join([*w, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts, "doc_id")
    alone = spark.createDataFrame(rows[5:6], "doc_id bigint, text string")
    bench = spark.createDataFrame([(9, item)], BENCH)
    got = {r.doc_id: [(h["item"], h["exact"]) for h in r.hits] for r in decontaminate.matches(docs, bench).collect()}
    assert got == {**{i: [("9", False)] for i in [*range(13), 20]}, 21: [], 22: [("9", True)]}
    assert [(h["item"], h["exact"]) for h in decontaminate.matches(alone, bench).first().hits] == [("9", False)]


def test_sharding(docs, empty, texts):
    for size in (sharding.BUCKET_BYTES, 2000):
        rows = sharding.dealt(docs, bucket_bytes=size).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
        by = {s: sorted(r["slot"] for r in rows if r["shard"] == s) for s in {r["shard"] for r in rows}}
        assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(len(by.get(s, ())) for s in range(16)) <= 1
        assert rows == sharding.dealt(docs, bucket_bytes=size).collect() or sorted(rows, key=lambda r: r.doc_id) == sorted(sharding.dealt(docs, bucket_bytes=size).collect(), key=lambda r: r.doc_id)
    crc = {r.doc_id: (r.size, r.text_crc32) for r in sharding.digest(docs).collect()}
    assert crc == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    assert sharding.digest(empty).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"menu\n own {i} \n\nmenu" if i < 8 else f"own {i}\nMenu", "a" if i < 10 else None, 0, "x", 1) for i in range(12)] + [(20, None, "a", None, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, n_chars bigint, kept string, lines int")
    out = {r.doc_id: r for r in lines.deduplicated(docs, ratio=0.5).collect()}
    assert out[0].text == " own 0 \n" and out[0].n_chars == 8 and out[9].text == "own 9\nMenu" and out[11].text == "own 11\nMenu" and out[20].text is None
    assert out[0].kept == "x" and out[0].lines == 1
    assert {r.doc_id: r.text for r in lines.deduplicated(docs, ratio=0.9).collect()}[0] == rows[0][1]
    assert lines.deduplicated(docs.limit(0)).count() == 0


def test_text_of_pages_is_worked_out_once_for_counting(spark, monkeypatch):
    plans, kept = [], lines.checkpointed
    monkeypatch.setattr(lines, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df))
    rows = [(i, f"http://h/{i}", None if i == 4 else f"<p>menu</p><p>own {i}</p>") for i in range(8)]
    got = lines.digest(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: (r.n_lines, r.n_dropped) for r in got} == {i: (0, 0) if i == 4 else (5, 2 - 1) for i in range(8)}
    assert plans[0].count("regexp_replace(") == 3


def brute_quality(text):
    w = words(text) if not text else re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {p + k for p in at for k in range(3)}
    own = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(covered)


@pytest.mark.parametrize("few", [64, 0])
def test_quality_statistics(docs, texts, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.statistics(docs).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}


def test_quality_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert all(r.kept == (not r.base_failed) for r in quality.digest(docs, labels).collect())


def test_quality_cutoffs_limit_false_rejection(spark):
    rng = random.Random(4)
    rows = [(i, i % 4 > 0, min(60, rng.randrange(3) + (30 if i % 4 == 0 else 0))) for i in range(8000)]
    stats = spark.createDataFrame([(i, "en", 100, 100, s, 0, 0, 5, False) for i, _, s in rows],
                                  "doc_id bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint, base_failed boolean")
    labels = spark.createDataFrame([(i, int(good)) for i, good, _ in rows], "doc_id bigint, quality int")
    cuts = quality.cutoffs(stats, labels)
    assert [(r["stratum"], r["rule"]) for r in cuts.collect()] == [("en", "symbols")]
    kept = {r.doc_id: r.kept for r in quality.judged(stats, cuts).collect()}
    assert all(kept[i] for i, good, _ in rows if good) and not any(kept[i] for i, good, _ in rows if not good)
    few = quality.cutoffs(stats.limit(100), labels)
    assert few.count() == 0


def test_minhash(docs, empty, texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.classes(docs).collect()}
    assert got == {i: (len(sets[i]), root[i], root[i] == i) for i in range(len(texts))}
    left = minhash.kept_documents(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i in got if got[i][2]}
    assert minhash.classes(empty).count() == 0


def test_minhash_of_large_components_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TASK_SETS", 4)
    base = made_up(100, 30).split()
    rows = [(100 + i, " ".join(base[:i] + [f"odd{i}"] + base[i + 1:])) for i in range(30)] + [(1, made_up(80, 31)), (None, " ".join(base))]
    got = {r.doc_id: r.component_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {**{100 + i: 100 for i in range(30)}, 1: 1, None: None}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (300, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 200: 100}


def test_compact_windows():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = rng.integers(0, 60, 3)
        heads, least = np.concatenate([[0], np.cumsum(n)]), int(rng.integers(1, 12))
        v, want = rng.integers(0, 50, heads[-1]).astype(np.uint64), set()
        for d in range(3):
            for c in range(heads[d], heads[d + 1]):
                a = b = c
                while a > heads[d] and v[a - 1] > v[c]:
                    a -= 1
                while b + 1 < heads[d + 1] and v[b + 1] >= v[c]:
                    b += 1
                if b - a + 1 >= least:
                    want.add((d, int(a), int(c), int(b)))
        assert set(zip(*(x.tolist() for x in passages.compact_windows(v, heads, least)))) == want


def test_passages(docs, empty, texts):
    rows = [r.asDict() for r in passages.near_passages(docs).collect()]
    shared = [r for r in rows if (r["doc_id"], r["ref_doc_id"]) == (10, 9)]
    assert len(shared) == 1 and shared[0]["end"] - shared[0]["begin"] >= 60 and shared[0]["similarity"] == 1.0
    assert {r["doc_id"] for r in rows if r["ref_doc_id"] == 5} == {6, 7, 8}
    for r in rows:
        a, b = words(texts[r["doc_id"]])[r["begin"]:r["end"]], words(texts[r["ref_doc_id"]])[r["ref_begin"]:r["ref_end"]]
        x, y = ({tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        assert abs(len(x & y) / len(x | y) - r["similarity"]) < 1e-9 and r["similarity"] >= 0.75
    assert passages.near_passages(empty).count() == 0


def passage_rows(spark, *rows):
    made = passages.near_passages(spark.createDataFrame(list(enumerate(rows, 1)), "doc_id bigint, text string"))
    return [r.asDict() for r in made.collect()]


def test_passages_behind_earlier_parts(spark):
    passage = made_up(60, 40).split()
    parts = [" ".join([made_up(40, 41), *passage[a:a + 35], made_up(40, 42)]) for a in (0, 13, 25)]
    copies = [" ".join([made_up(50, 43 + i), *passage, made_up(50, 53 + i)]) for i in range(2)]
    rows = [r for r in passage_rows(spark, *parts, *copies) if r["doc_id"] > 3]
    assert {(r["doc_id"], r["ref_doc_id"], r["similarity"]) for r in rows} == {(5, 4, 1.0)}
    assert {(r["begin"], r["end"]) for r in rows} == {(50, 110)}


def test_passages_of_a_chain_and_of_many_parts(spark):
    passage = made_up(120, 60).split()
    variant = [w if i % 25 else f"new{i}" for i, w in enumerate(passage)]
    third = [w if (i + 12) % 25 else f"newer{i}" for i, w in enumerate(variant)]
    parts = [" ".join([made_up(30, 61 + i), *passage[9 * i:9 * i + 30], made_up(30, 81 + i)]) for i in range(12)]
    rows = passage_rows(spark, *parts, " ".join(passage), " ".join(third), " ".join(passage))
    assert (15, 13, 1.0) in {(r["doc_id"], r["ref_doc_id"], r["similarity"]) for r in rows}


def edited(passage, first=34, step=35):
    """With a new word at every 35th place: similarity 0.77 at 120 words, and no exact run of 32 shingles is left."""
    return [f"new{i}" if i % step == first else w for i, w in enumerate(passage)]


def test_passages_of_texts_behind_earlier_parts_of_both(spark):
    """Every shingle of the passages is in an earlier text, each in texts that have too little of them; both later texts differ."""
    rows, want = [], set()
    for n in range(8):
        passage = made_up(120, 700 + n).split()
        rows += [" ".join([made_up(40, 800 + 20 * n + i), *passage[9 * i:9 * i + 30], made_up(40, 1000 + 20 * n + i)]) for i in range(11)]
        rows += [" ".join([made_up(50, 1200 + n), *passage]), " ".join([*edited(passage), made_up(50, 1300 + n)])]
        want.add((len(rows), len(rows) - 1))
    rows = passage_rows(spark, *rows)
    assert {(r["doc_id"], r["ref_doc_id"]) for r in rows if r["end"] - r["begin"] >= 100} == want
    assert all(r["similarity"] >= 0.75 for r in rows)


def test_ties_of_windows_that_no_result_links(spark):
    """Equal ranges are tied to their earliest, others in pairs if a side of the least place is alike; not those that are linked to one place."""
    passage = made_up(90, 1400).split()
    texts = [[*passage[40:60]], passage, edited(passage, 5), passage, [*made_up(35, 1401).split(), *passage[38:62], *made_up(35, 1402).split()]]
    texts = [" ".join([made_up(60, 1410 + i), *t, made_up(60, 1420 + i)]) for i, t in enumerate(texts)]
    own = spark.createDataFrame(list(enumerate(texts, 1)), "d bigint, text string").repartition(3)
    made = passages.windows(own)
    ties = passages.tied(made)
    linked = [(2, 60, 150, 1, 60, 150, 1.0), (4, 60, 150, 1, 60, 150, 1.0)]
    for links in ([], linked):
        found = passages.unlinked(ties, spark.createDataFrame(
            links, "doc_id bigint, begin bigint, end bigint, ref_doc_id bigint, ref_begin bigint, ref_end bigint, similarity double"), own).collect()
        assert len(found) == len(set(found)) and all(r["d"] > r["e"] > 1 for r in found)
        assert ((4, 2) in {(r["d"], r["e"]) for r in found}) == (not links)
        assert (3, 2) in {(r["d"], r["e"]) for r in found}
        known = {(r.key, r.d, r.l, r.r) for r in made.collect()}
        assert all((r["key"], r["d"], r["l"], r["r"]) in known and (r["key"], r["e"], r["xl"], r["xr"]) in known for r in found)


def test_windows_of_a_hot_key_are_paired_in_blocks(spark, monkeypatch):
    """The pairs are the same ones, dealt by key and block, and only one side of them is repeated."""
    passage = made_up(90, 2300).split()
    rows = [(i, " ".join([made_up(30, 2301 + i), *(w if (j + i) % 31 else f"new{i}x{j}" for j, w in enumerate(passage)), made_up(30, 2401 + i)])) for i in range(40)]
    own = spark.createDataFrame(rows, "d bigint, text string").repartition(3)
    links = spark.createDataFrame([], "doc_id bigint, begin bigint, end bigint, ref_doc_id bigint, ref_begin bigint, ref_end bigint, similarity double")
    ties, got = passages.tied(passages.windows(own)), []
    for block in (10_000, 3):
        monkeypatch.setattr(passages, "BLOCK", block)
        found = passages.unlinked(ties, links, own)
        assert "block" in found._jdf.queryExecution().optimizedPlan().toString()
        got.append(sorted(tuple(r) for r in found.collect()))
    assert got[0] == got[1] and len(set(got[0])) == len(got[0]) > 200


def test_least_places_and_bits_beside_them():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 40, 300).astype(np.uint64) * np.uint64(8) + rng.integers(0, 8, 300).astype(np.uint64)
    left = rng.integers(0, 280, 200)
    right, key = left + rng.integers(0, 20, 200), rng.integers(0, 42 * 8, 200).astype(np.uint64)
    want = [next((c for c in range(a, b + 1) if values[c] >> 3 == k >> 3), -1) for k, a, b in zip(key.tolist(), left, right)]
    assert passages.least_places(values, key, left, right).tolist() == want
    bits, text = rng.integers(0, 1 << 62, 90).astype(np.uint64), np.repeat([0, 2, 3], [50, 1, 39])
    before, behind = passages.alike_ahead(bits, text)
    for i in range(90):
        near = [j for j in range(90) if text[j] == text[i]]
        assert before[i] == np.bitwise_or.reduce([bits[j] for j in near if i - passages.SIDE < j <= i])
        assert behind[i] == np.bitwise_or.reduce([bits[j] for j in near if i <= j < i + passages.SIDE])


def test_single_shingles_in_order_are_verified_by_counts(monkeypatch):
    """With the results of the way for texts that repeat themselves, which two foreign shingles at the end ask for."""
    rng, cases = np.random.default_rng(11), []
    for n in range(200):
        own = rng.permutation(1 << 20)[:rng.integers(60, 700)].astype(np.uint64)
        other = np.where(rng.random(len(own)) < (0.01, 0.04, 0.15)[n % 3], own + np.uint64(1 << 30), own)
        for k in range(n % 4):  # 60 foreign shingles in place of up to 80
            at = int(rng.integers(0, len(other)))
            other = np.concatenate([other[:at], np.arange(60, dtype=np.uint64) + np.uint64((k + 1) << 40), other[at + int(rng.integers(0, 80)):]])
        if len(set(other.tolist())) == len(other):
            cases.append((own, other))
    want = [sorted(passages.verified(np.append(own, [np.uint64(1 << 60)] * 2), other)) for own, other in cases]
    assert sum(map(len, want)) > len(cases)
    for name in ("_similarity", "_equal_ahead"):
        monkeypatch.setattr(passages, name, None)
    assert [sorted(passages.verified(own, other)) for own, other in cases] == want


def test_runs_of_one_text_are_verified_with_the_places_of_the_whole():
    """As each by itself, with true similarities; the shingles of many short texts at once are those of each."""
    rng, found = np.random.default_rng(12), 0
    for n in range(300):
        whole = rng.integers(0, (60, 400, 1 << 40)[n % 3], 400).astype(np.uint64)
        first, last = sorted(rng.integers(0, 400, 2).tolist())
        own, places = whole[first:last], passages.places_of(whole)
        other = np.where(rng.random(len(own)) < 0.03, np.uint64(1 << 50), own)[int(rng.integers(0, 9)):]
        rows = list(passages.verified(own, other, places.before[first:last] - first))
        assert rows == list(passages.verified(own, other))
        for a, b, x, y, similar in rows:
            one, two = set(own[a:b + 1].tolist()), set(other[x:y + 1].tolist())
            assert similar == len(one & two) / len(one | two) >= passages.SIMILAR
        found += len(rows)
    assert found > 100 and not list(passages.verified(np.arange(60, dtype=np.uint64), np.zeros(0, np.uint64)))
    texts = [made_up(rng.integers(1, 90), 2100 + i).encode() for i in range(9)] + [b"", b"two words"]
    got = list(passages._shingles_each(iter(texts)))
    assert [x.tolist() for x in got] == [passages.shingles_of(*passages._one(t))[0].tolist() for t in texts]


def test_passages_of_equal_ids_of_which_one_is_short(spark):
    """A tie's range may lie behind the end of another text with the same id."""
    passage = made_up(70, 2200)
    rows = [(1, f"{made_up(80, 2201)} {passage}"), (1, made_up(6, 2202)), (2, passage), (2, "short")]
    made = passages.near_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.begin, r.end, r.ref_doc_id, r.ref_begin, r.ref_end, r.similarity) for r in made] == [(2, 0, 70, 1, 80, 150, 1.0)]


def test_passages_beside_an_earlier_place_of_their_shingles(spark):
    # the first text has each shingle of the passage at places before it too
    passage = made_up(60, 90).split()
    stray = " ".join(" ".join([made_up(60, 200 + i), *passage[i % 56:i % 56 + 5]]) for i in range(168))
    rows = passage_rows(spark, " ".join([stray, made_up(60, 190), *passage]), " ".join(passage))
    assert [(r["doc_id"], r["ref_doc_id"], r["end"] - r["begin"], r["similarity"]) for r in rows] == [(2, 1, 60, 1.0)]


def test_passages_with_a_wide_insertion(spark):
    one, two = made_up(98, 140).split(), made_up(70, 141).split()
    first = " ".join([made_up(60, 142), *one, made_up(60, 143), *two])
    second = " ".join([*one[:49], made_up(17, 144), *one[49:], made_up(60, 145), *two, made_up(60, 146)])
    rows = passage_rows(spark, first, second)
    assert {(r["begin"], r["end"], r["ref_begin"], r["ref_end"]) for r in rows} == {(0, 115, 60, 158), (175, 245, 218, 288)}
    assert all(r["similarity"] >= 0.75 for r in rows)


def test_ties_of_windows(spark):
    rng = random.Random(6)
    rows = [(rng.choice([5, 5, 5, rng.randrange(40)]), i // 3, i, i + 9) for i in range(3000)]
    made = spark.createDataFrame(rows, "key bigint, d bigint, l bigint, r bigint").repartition(7)
    least = {}
    for key, d, left, right in sorted(rows):
        least.setdefault(key, (d, left, right))
    for hot in ([], [5], [5, 7, 99]):
        got = [tuple(r) for r in passages.tied(made, hot).select("key", "d", "l", "r", "e", "xl", "xr").collect()]
        assert sorted(got) == sorted((*r, *least[r[0]]) for r in rows if r[1] > least[r[0]][0])


def test_hot_keys_of_windows(spark):
    one = made_up(100, 7)
    rows = [(i, one if i % 3 == 0 else made_up(100, 5000 + i)) for i in range(6000)]
    hot = passages.hot_keys(spark.createDataFrame(rows, "d bigint, text string").repartition(4))
    keys = {r.key for r in passages.windows(spark.createDataFrame([(1, one)], "d bigint, text string")).collect()}
    assert set(hot) <= keys and passages.hot_keys(spark.createDataFrame([], "d bigint, text string")) == []


def test_windows_of_the_earliest_text_at_other_places_are_tied(spark):
    """The first text has all shingles of the passage before it too, in parts with too little of it: every key's earliest window is in one of them."""
    passage = made_up(120, 3000).split()
    parts = [" ".join([made_up(60, 3100 + i), *passage[9 * i:9 * i + 30], made_up(60, 3200 + i)]) for i in range(11)]
    before = " ".join([*parts, made_up(60, 3300)]).split()
    own = spark.createDataFrame([(1, " ".join([*before, *passage])), (2, " ".join([*edited(passage), made_up(50, 3301)]))], "d bigint, text string")
    links = spark.createDataFrame([], "doc_id bigint, begin bigint, end bigint, ref_doc_id bigint, ref_begin bigint, ref_end bigint, similarity double")
    ties = passages.tied(passages.windows(own), others=True)
    assert {r["e"] for r in ties.collect()} == {1} and ties.filter("d = e AND many").count()
    found = passages.unlinked(ties, links, own).collect()
    assert {(r["d"], r["e"]) for r in found} == {(2, 1)} and len({r["key"] & 7 for r in found if r["xl"] >= len(before)}) >= 2


def test_windows_that_differ_beside_the_least_place_are_tied(spark):
    """Four new words on either side of it: eight in ten shingles are the same, but hardly one of those nearby."""
    def least(text):
        runs = passages.shingles_of(*passages._one(" ".join(text).encode()))[0]
        values = runs * passages.FACTORS[0] + passages.TERMS[0]
        c = int((values >> np.uint64(32)).argmin())
        return c, int(((values[c] & ~passages.LOW)).view(np.int64))

    for seed in range(3700, 3800):
        passage = made_up(330, seed).split()
        c, key = least(passage)
        places = {x for j in range(4) for x in (c - 1 - 6 * j, c + 5 + 6 * j)}
        near = [f"new{i}" if i in places else w for i, w in enumerate(passage)]
        part = [*made_up(60, 1).split(), *passage[c:c + 5], *made_up(60, 2).split()]
        if 60 < c < 260 and least(near) == (c, key) and least(part) == (60, key):
            break
    own = spark.createDataFrame([(1, " ".join(part)), (2, " ".join(passage)), (3, " ".join(near))], "d bigint, text string")
    links = spark.createDataFrame([], "doc_id bigint, begin bigint, end bigint, ref_doc_id bigint, ref_begin bigint, ref_end bigint, similarity double")
    found = passages.unlinked(passages.tied(passages.windows(own)), links, own).collect()
    assert (key, 3, 2) in {(r["key"], r["d"], r["e"]) for r in found}


def test_marks_of_ranges():
    """The shared bits and what is lost are at least the shared shingles; the need is that of the run of least different ones."""
    rng = np.random.default_rng(5)
    runs = rng.choice(rng.integers(0, 1 << 63, 400, dtype=np.uint64), 900)
    heads = np.array([0, 300, 900])
    text = np.repeat([0, 1], np.diff(heads))
    of = rng.integers(0, 2, 200)
    left = heads[of] + rng.integers(0, 250, 200)
    right = np.minimum(left + rng.integers(passages.LEAST - 1, 300, 200), heads[of + 1] - 1)
    marks, lost, need = passages.marked(runs, text, left, right)
    sets = [set(runs[a:b + 1].tolist()) for a, b in zip(left, right)]
    bits = np.unpackbits(marks.view(np.uint8), axis=1)
    assert lost.tolist() == [len(s) - int(m.sum()) for s, m in zip(sets, bits)]
    for i, j in itertools.product(range(0, 200, 7), range(200)):
        assert int((bits[i] & bits[j]).sum()) + min(lost[i], lost[j]) >= len(sets[i] & sets[j])
    for a, b, n in zip(left, right, need):
        assert n == np.ceil(0.75 * min(len(set(runs[i:i + passages.LEAST].tolist())) for i in range(a, b - passages.LEAST + 2)))


def test_passages_found_of_all_near_repeats(spark):
    """Recall against all pairs of runs of 46 shingles, of passages edited to similarities around 0.75 and up."""
    rng = random.Random(77)
    passages_of = [made_up(rng.randint(55, 140), 1000 + i).split() for i in range(25)]
    texts = []
    for i in range(150):
        own = [w if rng.random() > rng.choice([0, 0, 0.01, 0.03]) else f"edit{i}x{j}" for j, w in enumerate(rng.choice(passages_of))]
        texts.append([*made_up(rng.randint(0, 80), 2000 + i).split(), *own, *made_up(rng.randint(0, 80), 3000 + i).split()])
    rows = passage_rows(spark, *(" ".join(t) for t in texts))
    found, asked, hit = {}, 0, 0
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["begin"], r["end"]))
    sets = [[{hash(tuple(t[k:k + 5])) for k in range(a, a + 46)} for a in range(len(t) - 49)] for t in texts]
    flat = [set().union(*s) if s else set() for s in sets]
    for d in range(1, len(texts)):
        near = [e for e in range(d) if len(flat[d] & flat[e]) >= 36]
        for a, one in enumerate(sets[d]):
            if any(len(one & other) * 100 >= 75 * len(one | other) for e in near for other in sets[e]):
                asked += 1
                hit += any(b < a + 50 and a < c for b, c in found.get(d + 1, []))
    print("passages found:", hit, "of", asked)
    assert asked > 2000 and hit >= 0.9 * asked


def test_bpe(docs, empty, texts):
    from tokenizers import Tokenizer

    path = vocabulary()
    known = Tokenizer.from_file(path)
    rng = random.Random(1)
    more = ["".join(rng.choice("etaoin shrdlu'é日本\U0001F600\n\t.,-=0123") for _ in range(rng.randint(1, 600))) for _ in range(200)] + ["é" * 3000, "the" * 4000, "#" * 1000 + "=" * 999]
    for text in [t or "" for t in texts] + more:
        ids = known.encode(text, add_special_tokens=False).ids
        packed = bpe.encode_text(text, path)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert bpe.decode_ids(packed, path) == known.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in bpe.digest(docs, path).collect()}
    assert got[0] == (0, hashlib.sha256(b"").hexdigest()) and got[15][1] == hashlib.sha256(texts[15].encode()).hexdigest()
    assert bpe.digest(empty, path).count() == 0


def test_bpe_keeps_a_bounded_part_of_a_stream():
    merges, _ = bpe.machine(vocabulary())
    machine, out, most = bpe.Transducer(merges), [], 0
    data = made_up(20_000, 8).replace(" ", "").encode()
    for i in range(0, len(data), 64):
        out += machine.feed(data[i:i + 64])
        most = max(most, len(machine.kept))
    whole = bpe.Transducer(merges)
    assert out + machine.finish() == whole.feed(data) + whole.finish() and most < 4 * merges.lookahead


def test_decoder_of_broken_bytes():
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(rng.randrange(1, 40)))
        decoder, out, i = bpe.TextDecoder(), "", 0
        while i < len(data):
            n = rng.randrange(1, 5)
            out += decoder.feed(data[i:i + n])
            i += n
        assert out + decoder.feed(b"", final=True) == data.decode("utf-8", errors="replace")


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    text = pa.array([made_up(25, 1, 5), made_up(9, 2, 5)])
    own = toxicity.text_words(*tb.packed(text))
    net = toxicity.Network.fresh(own["hashes"][::2], np.ones(len(own["hashes"][::2])), np.zeros(toxicity.TRIGRAMS))
    net.w = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float64) for k, v in net.w.items()}
    start, size, _ = toxicity.windows(own["firsts"])
    at, sizes = net.places(own, start, size)

    def loss():
        return net.forward(net.inputs(own) @ net.w["input"] + net.w["bias"], at, sizes).astype(np.float64).sum()

    vectors = net.inputs(own)
    _, saved = net.forward(vectors @ net.w["input"] + net.w["bias"], at, sizes, keep=True)
    grad = net.backward(own, vectors, at, saved, np.ones(2, np.float32))
    for name in ("words", "input", "bias", "state", "look", "seen", "out"):
        place = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        value, step = net.w[name][place], 1e-2
        net.w[name][place] = value + step
        above = loss()
        net.w[name][place] = value - step
        slope = (above - loss()) / (2 * step)
        net.w[name][place] = value
        assert abs(slope - grad[name][place]) < 0.05 * abs(slope) + 5e-3, name


def test_toxicity(spark, docs, empty, texts):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(300):
        w, bad = made_up(rng.randrange(20, 150), i).split(), i % 2
        for _ in range(3 * bad):
            w[rng.randrange(len(w))] = rng.choice(["rotter", "scoundrel"])
        rows.append((i, " ".join(w)))
        marks.append((i, bad))
    train, labels = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(marks + [(None, 1), (5, None), (6, 7)], "doc_id bigint, toxic int")
    got = toxicity.digest(train, labels).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(300)}
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.9
    assert sorted(map(tuple, got)) == sorted(map(tuple, toxicity.digest(train, labels).collect()))
    model = toxicity.fit(train, labels)
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert scores[0] == scores[1] == scores[2] == 0.0 and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.accepted(docs, labels.limit(0)).columns == docs.columns and toxicity.digest(empty, labels).count() == 0


def test_bpe_of_many_texts_in_sorted_order(texts, monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary()
    known, rng = Tokenizer.from_file(path), random.Random(7)
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 50)
    monkeypatch.setattr(bpe, "KNOWN_PAIRS", 40)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 900)
    many = [t or "" for t in texts] + ["".join(rng.choice("theandé \n") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    many += ["a" * n for n in (bpe.CHUNK - 1, bpe.CHUNK, bpe.CHUNK + 1, 5 * bpe.CHUNK)] + ["b" * 3000 + " " + "b" * 40]
    got = bpe.encode_texts(many, path)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [known.encode(t, add_special_tokens=False).ids for t in many]
