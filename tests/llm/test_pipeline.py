"""The pipeline on the smallest tables against a brute-force version of each stage."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import corpus_pipeline
from runweave.llm import textbytes as tb
from runweave.llm import toxicity
from runweave.llm.settings import vocabulary

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM, SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"


def words(text, kind):
    return re.findall(kind, (text or "").translate(LOWER))


def toxic_score(net, text):
    """Each window for itself."""
    n, best = len(words(text, ALNUM)), None
    begins = [min(i * 30, max(n - 40, 0)) for i in range(1 + max(0, -(-(n - 40) // 30)))] if n else []
    for begin in begins:
        part = " ".join(words(text, ALNUM)[begin:begin + 40])
        own = toxicity.text_words(*tb.packed(pa.array([part])))
        at = own["number"][None, :]
        score = net.forward(net.inputs(own) @ net.w["input"] + net.w["bias"], at, np.array([at.shape[1]]))[0]
        best = score if best is None else max(best, score)
    return 0.0 if best is None else 1 / (1 + np.exp(-(net.w["scale"][0] * best + net.w["scale"][1])))


def without_boilerplate(docs):
    pages, seen = {}, {}
    for d in docs:
        pages.setdefault(d["source"], set()).add(d["text"])
    for source, texts in pages.items():
        for text in texts:
            for line in {x.strip(" \t\n\x0b\x0c\r") for x in text.split("\n")} - {""}:
                seen[source, line] = seen.get((source, line), 0) + 1
    drop = {k for k, n in seen.items() if n >= 3 and n > 0.1 * len(pages[k[0]])}
    return [d | {"text": "\n".join(x for x in d["text"].split("\n") if (d["source"], x.strip(" \t\n\x0b\x0c\r")) not in drop)} for d in docs]


def without_near_copies(docs):
    sets = []
    for d in docs:
        w = words(d["text"], SPACED)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return [d for i, d in enumerate(docs) if root[i] == i]


def without_contaminated(docs, items):
    windows = set()
    for item in items:
        w = words(item["text"], ALNUM)
        n = min(13, len(w))
        windows |= {tuple(w[a:a + n]) for a in range(len(w) - n + 1)} if n else set()
    out = []
    for d in docs:
        w, hit = words(d["text"], ALNUM), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(d)
    return out


def test_pipeline(spark):
    docs = sorted(pq.read_table(f"{SF}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"])
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    net = toxicity.Network.unpacked(model)
    docs = [d for d in docs if toxic_score(net, d["text"]) < 0.7]
    docs = without_contaminated(without_near_copies(without_boilerplate(docs)), pq.read_table(f"{SF}/benchmark.parquet").to_pylist())
    known, want = Tokenizer.from_file(vocabulary()), set()
    for d in docs:
        ids = known.encode(d["text"], add_special_tokens=False).ids
        text = known.decode(ids, skip_special_tokens=False)
        want.add((d["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_stages_keep_the_columns_of_odd_tables(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, hits int, `_drop` string"
    odd = spark.createDataFrame([(1, None, None, None, None, 1, "x"), (None, "", "en", "s", 0, 2, "y"), (3, "a b c", "en", "s", 5, None, None)], schema)
    for rows in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, SF)
            assert out.columns == odd.columns and out.count() == rows.count()
        assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
