"""Toxicity of documents: a bidirectional gated recurrent network with attention pooling, in numpy.

**Model.** A word is a learned vector of the word, if it is one of the vocabulary, beside the mean of learned vectors of
its character trigrams. A window of words runs through gated recurrent units in both directions; attention weighs
the states of its words and a linear layer gives the window's score. Windows of 40 words begin every 30 words and at the
end, so they overlap and cover the whole text; a document scores as its highest window, put on a probability scale.

**Training.** On a sample of at most `SAMPLE` labelled rows of each class (the lowest hashes of their ids), never on rows
held out; whole texts, in one task, as the sample is bounded. Labels are of documents, so each pass learns from the
window of every document that scores highest, first by the words' own log odds, then by the network. Equal texts count
once, words are left out at random and weights decay, as labels are noisy. A fifth of the sample chooses the pass whose
weights are kept and fits the scale, with the classes weighed as among all labelled rows. Same rows, same weights, on whichever executor it runs.

**Scoring.** One pass over all rows with a broadcast of fixed size (the weights), no shuffle. Input vectors are
computed once per distinct word of a piece of some MB.

**Cases.** Null and empty texts, and texts without words, score 0. If the labelled rows lack a class, all scores are 0.
Labels other than 0 and 1 and rows with a null id are not learned from. Rows are scored one by one, so copies score
alike. Other columns are passed on; `score` takes the place of one of that name.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runweave.llm import textbytes as tb
from runweave.llm.columns import set_aside, without

WINDOW, STRIDE = 40, 30
HIDDEN, WORD, CHARS = 8, 8, 8
VOCABULARY, TRIGRAMS = 8192, 16384
SAMPLE = 1500
PASSES, BATCH, RATE, DECAY, LEFT_OUT = 8, 128, 0.005, 0.02, 0.2
STEPS = 250  # updates at least, in as many passes as that takes
WORD_TEXTS, WORD_SURE = 3, 2.5  # texts that a telling word or trigram is in at least, and its log odds over their deviation
SCORED_AT_ONCE = 4096
TOXIC = 0.7
F32 = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return F32(0.5) * np.tanh(F32(0.5) * x) + F32(0.5)


def text_words(data: np.ndarray, borders: np.ndarray) -> dict:
    """Distinct words of a piece (hash, character trigrams) and the number of the distinct word at each place."""
    data = tb.LOWER[data]
    starts, ends, firsts = tb.words(data, borders, tb.ALNUM)
    hashes, first, number = np.unique(tb.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    s, n = starts[first], (ends - starts)[first]
    heads = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(heads[-1]) - heads[owner] + s[owner]
    wide = np.concatenate([[32], data, [32]]).astype(np.uint32)
    left = np.where(at == s[owner], 32, wide[at])
    right = np.where(at + 1 == s[owner] + n[owner], 32, wide[at + 2])
    code = (left * np.uint32(65599) + wide[at + 1]) * np.uint32(65599) + right
    code = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    return {"hashes": hashes, "number": number, "firsts": firsts, "codes": code, "heads": heads, "sizes": n}


def windows(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, words and text of every window."""
    n = np.diff(firsts)
    counts = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), counts)
    rank = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    start = np.minimum(rank * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return firsts[text] + start, np.minimum(n[text], WINDOW), text


class Network:
    """Weights by name, and the forward and backward pass."""

    def __init__(self, vocabulary: np.ndarray, weights: dict[str, np.ndarray]):
        self.vocabulary, self.w = vocabulary, weights

    @classmethod
    def fresh(cls, vocabulary: np.ndarray, odds: np.ndarray, odds_of_chars: np.ndarray) -> Network:
        rng = np.random.default_rng(11)
        scaled = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(F32)
        words = (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD))).astype(F32)
        chars = (0.1 * rng.standard_normal((TRIGRAMS, CHARS))).astype(F32)
        words[1:, 0], chars[:, 0] = odds, odds_of_chars  # where the first pass starts from
        return cls(vocabulary, {
            "words": words, "chars": chars,
            "input": scaled(WORD + CHARS, 6 * HIDDEN), "bias": np.zeros(6 * HIDDEN, F32), "state": scaled(2, HIDDEN, 3 * HIDDEN),
            "look": scaled(2 * HIDDEN, HIDDEN), "seen": scaled(HIDDEN, 1), "out": scaled(2 * HIDDEN, 1), "level": np.zeros(1, F32),
            "scale": np.array([1, 0], F32)})

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vocabulary=self.vocabulary, **self.w)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Network:
        held = dict(np.load(io.BytesIO(data)))
        return cls(held.pop("vocabulary"), held)

    def rows(self, words: dict) -> np.ndarray:
        """Row of the word table of each distinct word; 0 for words out of the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(words["hashes"]), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words["hashes"]), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words["hashes"], at + 1, 0)

    def inputs(self, words: dict) -> np.ndarray:
        """Input vector of each distinct word."""
        if not len(words["hashes"]):
            return np.zeros((0, WORD + CHARS), F32)
        chars = np.add.reduceat(self.w["chars"][words["codes"]], words["heads"][:-1], axis=0) / words["sizes"][:, None].astype(F32)
        return np.concatenate([self.w["words"][self.rows(words)], chars], axis=1)

    def forward(self, drive: np.ndarray, at: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Scores of windows. drive: input of gates of each distinct word; at: window x place; sizes: words in each."""
        w, (b, n) = self.w, at.shape
        h = np.zeros((2, b, HIDDEN), F32)
        states = np.zeros((n, b, 2 * HIDDEN), F32)
        short, kept = bool((sizes < n).any()), []
        x = np.empty((2, b, 3 * HIDDEN), F32)
        for t in range(n):
            back = n - 1 - t
            x[0], x[1] = drive[at[:, t], :3 * HIDDEN], drive[at[:, back], 3 * HIDDEN:]
            g = h @ w["state"]
            gates = _sigmoid(x[..., :2 * HIDDEN] + g[..., :2 * HIDDEN])
            z, r = gates[..., :HIDDEN], gates[..., HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN:] + r * g[..., 2 * HIDDEN:])
            on = np.stack([sizes > t, sizes > back])[..., None].astype(F32) if short else F32(1)
            if keep:
                kept.append((h, g, z, r, c, on))
            h = h + on * (F32(1) - z) * (c - h)
            states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
        look = np.tanh(states @ w["look"])
        weight = (look @ w["seen"])[..., 0]
        if short:
            weight = np.where(np.arange(n)[:, None] < sizes, weight, F32(-1e9))
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        score = (pooled @ w["out"])[:, 0] + w["level"][0]
        return (score, (kept, states, look, weight, pooled)) if keep else score

    def backward(self, words: dict, vectors: np.ndarray, at: np.ndarray, saved, d_score: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of all weights."""
        w, (kept, states, look, weight, pooled) = self.w, saved
        b, n = at.shape
        grad = {"out": pooled.T @ d_score[:, None], "level": np.array([d_score.sum()], F32)}
        d_pooled = d_score[:, None] * w["out"][:, 0]
        d_states = weight[..., None] * d_pooled
        d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
        d_weight = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["seen"] = np.einsum("tbk,tb->k", look, d_weight)[:, None]
        d_look = d_weight[..., None] * w["seen"][:, 0] * (1 - look**2)
        grad["look"] = np.einsum("tbh,tbk->hk", states, d_look)
        d_states += d_look @ w["look"].T
        grad["state"] = np.zeros_like(w["state"])
        d_drive = np.zeros((len(vectors), 6 * HIDDEN), F32)
        dh = np.zeros((2, b, HIDDEN), F32)
        for t in range(n - 1, -1, -1):
            back = n - 1 - t
            h, g, z, r, c, on = kept[t]
            dh = dh + np.stack([d_states[t, :, :HIDDEN], d_states[back, :, HIDDEN:]])
            d_c = dh * on * (1 - z) * (1 - c**2)
            d_z = -dh * on * (c - h) * z * (1 - z)
            d_r = d_c * g[..., 2 * HIDDEN:] * r * (1 - r)
            d_g = np.concatenate([d_z, d_r, d_c * r], axis=2)
            d_x = np.concatenate([d_z, d_r, d_c], axis=2)
            grad["state"] += h.transpose(0, 2, 1) @ d_g
            np.add.at(d_drive[:, :3 * HIDDEN], at[:, t], d_x[0])
            np.add.at(d_drive[:, 3 * HIDDEN:], at[:, back], d_x[1])
            dh = dh * (1 - on * (1 - z)) + d_g @ w["state"].transpose(0, 2, 1)
        grad["input"], grad["bias"] = vectors.T @ d_drive, d_drive.sum(axis=0)
        d_vectors = d_drive @ w["input"].T
        grad["words"] = np.zeros_like(w["words"])
        np.add.at(grad["words"], self.rows(words), d_vectors[:, :WORD])
        grad["words"][0] = 0
        grad["chars"] = np.zeros_like(w["chars"])
        owner = np.repeat(np.arange(len(words["sizes"])), words["sizes"])
        np.add.at(grad["chars"], words["codes"], (d_vectors[:, WORD:] / words["sizes"][:, None].astype(F32))[owner])
        return grad

    def scores(self, words: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Score of every window, and the windows."""
        start, size, text = windows(words["firsts"])
        drive = self.inputs(words) @ self.w["input"] + self.w["bias"]
        out = np.zeros(len(start), F32)
        for part in (np.flatnonzero(size == WINDOW), np.flatnonzero(size < WINDOW)):
            for i in range(0, len(part), SCORED_AT_ONCE):
                some = part[i:i + SCORED_AT_ONCE]
                out[some] = self.forward(drive, *self.places(words, start[some], size[some]))
        return out, start, size, text

    @staticmethod
    def places(words: dict, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = int(size.max())
        return words["number"][np.minimum(start[:, None] + np.arange(width), start[:, None] + size[:, None] - 1)], size

    def documents(self, words: dict) -> np.ndarray:
        """Probability of each text; 0 without words."""
        score, _, _, text = self.scores(words)
        best = np.full(len(words["firsts"]) - 1, -np.inf)
        np.maximum.at(best, text, score)
        some = np.isfinite(best)
        out = np.zeros(len(best))
        out[some] = 1 / (1 + np.exp(-np.clip(self.w["scale"][0] * best[some] + self.w["scale"][1], -30, 30)))
        return out


def _subset(words: dict, at: np.ndarray) -> tuple[dict, np.ndarray]:
    """The distinct words of some windows alone, and the windows in their numbers."""
    used, at = np.unique(at, return_inverse=True)
    n = words["sizes"][used]
    heads = np.concatenate([[0], np.cumsum(n)])
    codes = words["codes"][np.repeat(words["heads"][used] - heads[:-1], n) + np.arange(heads[-1])]
    return {"hashes": words["hashes"][used], "codes": codes, "heads": heads, "sizes": n}, at.reshape(-1, at.shape[-1])


def _odds(feature: np.ndarray, label: np.ndarray, toxic: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of n features, given by the distinct texts each is in and their labels, and how sure they are (0: not enough)."""
    ones = np.bincount(feature, weights=label, minlength=n)
    zeros = np.bincount(feature, weights=1 - label, minlength=n)
    odds = np.log((ones + 0.5) / (toxic.sum() + 1)) - np.log((zeros + 0.5) / ((1 - toxic).sum() + 1))
    sure = np.abs(odds) / np.sqrt(1 / (ones + 0.5) + 1 / (zeros + 0.5))
    sure[(ones + zeros < WORD_TEXTS) | (sure < WORD_SURE)] = 0
    return np.clip(odds, -3, 3), sure


def trained(texts: pa.Array, toxic: np.ndarray, share: float) -> Network:
    """A network fitted to labelled texts. share: part of toxic rows among all labelled ones."""
    words = text_words(*tb.packed(texts))
    n_words = np.diff(words["firsts"])
    text = np.repeat(np.arange(len(toxic)), n_words)
    # a fifth is not learned from, but chooses weights and scale
    learn = np.arange(len(toxic)) % 5 != 4
    pairs = np.unique(words["number"].astype(np.int64) * len(toxic) + text)
    pairs = pairs[learn[pairs % len(toxic)]]
    label = toxic[pairs % len(toxic)]
    odds, sure = _odds(pairs // len(toxic), label, toxic[learn], len(words["hashes"]))
    chosen = np.lexsort((words["hashes"], -sure))[:VOCABULARY]
    chosen = np.sort(chosen[sure[chosen] > 0])
    n = words["sizes"][pairs // len(toxic)]
    at = np.repeat(words["heads"][pairs // len(toxic)] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    spelled = np.unique(words["codes"][at] * len(toxic) + np.repeat(pairs % len(toxic), n))
    odds_of_chars, sure_of_chars = _odds(spelled // len(toxic), toxic[spelled % len(toxic)], toxic[learn], TRIGRAMS)
    net = Network.fresh(words["hashes"][chosen], odds[chosen], np.where(sure_of_chars > 0, odds_of_chars, 0))
    # how telling each word is, for the first choice of windows
    spelling = np.add.reduceat(net.w["chars"][:, 0][words["codes"]], words["heads"][:-1]) / words["sizes"]
    first = np.where(sure > 0, odds, 0) + np.maximum(spelling, 0)

    start, size, owner = windows(words["firsts"])
    total = np.concatenate([[0], np.cumsum(np.maximum(first[words["number"]], 0) ** 2)])
    score = total[start + size] - total[start]
    rng, moments, step = np.random.default_rng(5), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}, 0
    turn = 0
    kept, least = None, np.inf
    weigh = np.where(toxic == 1, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    while turn < PASSES or step < STEPS:
        turn += 1
        order = np.lexsort((rng.random(len(owner)), -score, owner))
        best = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        best = best[learn[owner[best]]]
        clean = np.flatnonzero((toxic[owner] == 0) & learn[owner])
        more = rng.choice(clean, min(len(clean), len(best) // 2), replace=False) if len(clean) else clean
        todo = rng.permutation(np.concatenate([best, more]))
        for i in range(0, len(todo), BATCH):
            some = todo[i:i + BATCH]
            at, sizes = net.places(words, start[some], size[some])
            own, at = _subset(words, at)
            vectors = net.inputs(own) * (rng.random((len(own["sizes"]), 1)) >= LEFT_OUT).astype(F32)
            out, saved = net.forward(vectors @ net.w["input"] + net.w["bias"], at, sizes, keep=True)
            grad = net.backward(own, vectors, at, saved, ((_sigmoid(out) - toxic[owner[some]]) / len(some)).astype(F32))
            step += 1
            for k, g in grad.items():
                m, v = moments[k]
                m += F32(0.1) * (g - m)
                v += F32(0.001) * (g * g - v)
                net.w[k] = net.w[k] - F32(RATE) * (
                    (m / F32(1 - 0.9**step)) / (np.sqrt(v / F32(1 - 0.999**step)) + F32(1e-7)) + (F32(DECAY) * net.w[k] if k in ("words", "chars") else 0))
        score = net.scores(words)[0]
        best = np.full(len(toxic), -np.inf)
        np.maximum.at(best, owner, score)
        judge = np.isfinite(best) & ~learn
        line = _scale(best[judge], toxic[judge], weigh[judge])
        p = 1 / (1 + np.exp(-np.clip(line[0] * best[judge] + line[1], -30, 30)))
        loss = -(weigh[judge] * np.log(np.where(toxic[judge] == 1, p, 1 - p))).sum()
        if loss < least:
            least, kept = loss, net.w | {"scale": line}
    net.w = kept or net.w
    return net


def _scale(score: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slope and level of a logistic curve through the scores, by Newton's method on weighed rows."""
    line = np.array([1.0, 0.0])
    design = np.stack([score, np.ones_like(score)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ line, -30, 30)))
        slope = design.T @ (weight * (p - toxic)) + 0.01 * (line - [1, 0])
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        line = line - np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-6:
            break
    return np.maximum(line, [0.05, -50]).astype(F32)


def held_out(key) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> bytes | None:
    """Weights learned from at most `sample` rows of each class that are not held out; None if a class is missing."""
    rows = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)").filter(~held_out("k"))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    share = counts[1] / (counts[0] + counts[1])
    some = [rows.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(sample) for y in (0, 1)]
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(some[0].unionAll(some[1])), "k")

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by([("k", "ascending"), ("y", "ascending"), ("t", "ascending")])
        seen: set[tuple] = set()
        table = table.filter(pa.array([not (x in seen or seen.add(x)) for x in zip(table["y"].to_pylist(), table["t"].to_pylist())], pa.bool_()))
        toxic = table["y"].to_numpy().astype(np.float64)
        if len(set(toxic)) < 2:
            return pa.table({"model": pa.array([], pa.binary())})
        column = table["t"].combine_chunks()
        net = trained(column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks), toxic, share)
        return pa.table({"model": pa.array([net.packed()], pa.binary())})

    found = texts.groupBy(F.lit(0).alias("all")).applyInArrow(task, "model binary").collect()
    return bytes(found[0].model) if found else None


def scored(docs: DataFrame, model: bytes | None, text: str = "text", keep: list[str] | None = None, score: str = "score") -> DataFrame:
    """The columns `keep` of docs (default all) and the score of each text."""
    keep = without(docs, score).columns if keep is None else keep
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(score))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.unpacked(shared.value)
        for batch, data, borders in tb.pieces(batches, text, 1 << 20):
            found = net.documents(text_words(data, borders))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(found, pa.float64())], names=[*keep, score])

    return docs.mapInArrow(task, T.StructType([*(docs.schema[c] for c in keep), T.StructField(score, T.DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted of each text."""
    out = scored(docs.select(key, "text"), fit(docs, labels, key), keep=[key])
    return out.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs that score below `TOXIC`, with their columns."""
    rows, restored = set_aside(docs, "text")
    return restored(scored(rows, fit(docs, labels, key)).filter(F.col("score") < TOXIC))
