"""Operator 2, toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as two learned vectors: one for the hashed word, and the average
of those of its hashed character 3- and 4-grams (edges marked, A-Z lower-cased).
Two gated recurrent units read a window of ``WINDOW`` words forwards and
backwards, attention pools their states, and a logistic output scores the
window. Windows overlap by half; every text is covered to its end, and its score
is that of its highest window.

The network is trained in numpy by back-propagation through time. A document is
toxic when one of its windows is (noisy-or over the windows), so labels of
documents suffice. The training rows are a bounded sample: the ``TRAIN_ROWS``
labelled rows of either class with the smallest keyed hash of doc_id outside the
held-out fold; a step takes up to ``TRAIN_WINDOWS`` of a document's windows.

Scoring covers every word of every text in one pass without a shuffle. Word
inputs are computed once per distinct word of a chunk.

Defined results: a null or empty text, or one without words, gets the score of
no input (the output bias); rows with a null label are not trained on; repeated
rows get equal scores; without any label of one of the classes, all scores are
the share of label 1 (0.5 without labels). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, picked, table
from .textbatch import TextBatch, as_large, chunks

WINDOW, STRIDE = 16, 8
BITS = 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
TRAIN_ROWS = 1500
TRAIN_WINDOWS = 32
STEPS = 500
BATCH = (18, 8)  # clean and toxic documents in a step
RATE, TABLE_RATE = 0.01, 0.1
SEED = 23
HELD_OUT = 2
BLOCK = 8192

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

Net = dict[str, np.ndarray]


def new_net(seed: int = SEED) -> Net:
    rng = np.random.Generator(np.random.PCG64(seed))
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    x = WORD_DIM + CHAR_DIM
    net = {"words": normal(1 << BITS, WORD_DIM, scale=0.1), "grams": normal(1 << BITS, CHAR_DIM, scale=0.1)}
    for d in "fb":
        net |= {f"W{d}": normal(x, 3 * HIDDEN, scale=x**-0.5), f"U{d}": normal(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"B{d}": np.zeros(3 * HIDDEN, np.float32)}
    net |= {"Wa": normal(2 * HIDDEN, ATTENTION, scale=0.25), "Ba": np.zeros(ATTENTION, np.float32), "Va": normal(ATTENTION, scale=0.25)}
    return net | {"out": normal(2 * HIDDEN, scale=0.25), "bias": np.full(1, -3.0, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Vocabulary:
    """The distinct words of a batch: word slots, and character n-gram slots by word."""

    def __init__(self, batch: TextBatch):
        h = batch.word_hashes(lower=True)
        distinct, first, self.index = np.unique(h, return_index=True, return_inverse=True)
        self.word_slot = (distinct >> np.uint64(64 - BITS)).astype(np.int64)
        start, size = batch.start[first], (batch.end - batch.start)[first]
        owner = np.repeat(np.arange(len(first)), size)
        at = np.repeat(start - np.concatenate(([0], np.cumsum(size)))[:-1], size) + np.arange(int(size.sum()))
        b = _LOWER[batch.bytes[at]].astype(np.uint32)
        n = len(b)
        before, after, second = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        if n:
            same = owner[1:] == owner[:-1]
            before[1:] = np.where(same, b[:-1], 0)
            after[:-1] = np.where(same, b[1:], 0)
            second[:-1] = np.where(same, after[1:], 0)
        three = before << np.uint32(16) | b << np.uint32(8) | after
        four = (three ^ second << np.uint32(24)) * np.uint32(0x85EBCA6B) ^ np.uint32(0x5BD1E995)
        slots = np.stack([(three * np.uint32(2) + np.uint32(1)) * np.uint32(0x9E3779B1), four * np.uint32(0x9E3779B1)], axis=1).ravel()
        self.gram_slot = (slots >> np.uint32(32 - BITS)).astype(np.int64)
        self.gram_of = np.repeat(owner, 2)
        self.n_grams = 2 * size

    def inputs(self, net: Net, words: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of all distinct words, or of the given ones."""
        if words is None:
            grams, n, slot = self.gram_slot, self.n_grams, self.word_slot
        else:
            ends = np.concatenate(([0], np.cumsum(self.n_grams)))
            n, slot = self.n_grams[words], self.word_slot[words]
            grams = self.gram_slot[np.repeat(ends[words] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))]
        out = np.zeros((len(n), WORD_DIM + CHAR_DIM), np.float32)
        if len(n):
            out[:, :WORD_DIM] = net["words"][slot]
            out[:, WORD_DIM:] = np.add.reduceat(net["grams"][grams], np.cumsum(n) - n, axis=0) / n[:, None]
        return out


def windows(batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, text) of every window; consecutive windows of a text overlap by half."""
    n = batch.n_words
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(batch.n_docs), count)
    place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = batch.word_at[:-1][doc] + place * STRIDE
    return first, np.minimum(WINDOW, batch.word_at[1:][doc] - first), doc


def forward(net: Net, projected: dict[str, np.ndarray], index: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict | None]:
    """Logits of windows. ``index`` (windows, WINDOW) has rows of ``projected``, beyond ``size`` any."""
    n, steps = index.shape
    h_all = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    cache: dict = {"steps": {}}
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h = np.zeros((n, HIDDEN), np.float32)
        side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        for t in order:
            gx, gh = projected[d][index[:, t]], h @ net[f"U{d}"]
            zr = _sigmoid(gx[:, :2 * HIDDEN] + gh[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(gx[:, 2 * HIDDEN:] + r * gh[:, 2 * HIDDEN:])
            step = np.where((t < size)[:, None], new + z * (h - new), h)
            if keep:
                cache["steps"][d, t] = (h, z, r, new, gh[:, 2 * HIDDEN:])
            h = step
            h_all[t, :, side] = h
    inner = np.tanh(h_all @ net["Wa"] + net["Ba"])
    e = inner @ net["Va"]
    e[np.arange(steps)[:, None] >= size[None, :]] = -30
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[:, :, None] * h_all).sum(axis=0)
    logit = pooled @ net["out"] + net["bias"][0]
    if keep:
        cache |= {"h": h_all, "inner": inner, "a": a, "pooled": pooled}
    return logit, cache if keep else None


def backward(net: Net, cache: dict, index: np.ndarray, size: np.ndarray, d_logit: np.ndarray, n_rows: int) -> tuple[Net, dict[str, np.ndarray]]:
    """Gradients of all weights, and of the projected inputs."""
    h_all, inner, a, pooled = cache["h"], cache["inner"], cache["a"], cache["pooled"]
    steps = len(h_all)
    g: Net = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * net["out"]
    d_a = (h_all * d_pooled).sum(axis=2)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    d_inner = d_e[:, :, None] * net["Va"] * (1 - inner * inner)
    g["Va"] = np.einsum("tn,tnk->k", d_e, inner)
    g["Wa"], g["Ba"] = np.einsum("tnh,tnk->hk", h_all, d_inner), d_inner.sum(axis=(0, 1))
    d_h = a[:, :, None] * d_pooled + d_inner @ net["Wa"].T
    d_in: dict[str, np.ndarray] = {}
    for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
        d_in[d] = np.zeros((n_rows, 3 * HIDDEN), np.float32)
        g[f"U{d}"] = np.zeros_like(net[f"U{d}"])
        back = np.zeros((len(size), HIDDEN), np.float32)
        for t in order:
            h, z, r, new, gh_new = cache["steps"][d, t]
            live = (t < size)[:, None]
            total = d_h[t][:, side] + back
            grad = np.where(live, total, 0)
            d_new = grad * (1 - z) * (1 - new * new)
            d_z = grad * (h - new) * z * (1 - z)
            d_r = d_new * gh_new * r * (1 - r)
            d_gh = np.concatenate([d_z, d_r, d_new * r], axis=1)
            g[f"U{d}"] += h.T @ d_gh
            back = np.where(live, grad * z, total) + d_gh @ net[f"U{d}"].T
            np.add.at(d_in[d], index[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
    return g, d_in


def project(net: Net, x: np.ndarray) -> dict[str, np.ndarray]:
    return {d: x @ net[f"W{d}"] + net[f"B{d}"] for d in "fb"}


def train(texts: pa.Array, labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Net:
    """A network trained over whole labelled texts."""
    batch = TextBatch(texts)
    vocabulary = Vocabulary(batch)
    first, size, doc = windows(batch)
    begin = np.searchsorted(doc, np.arange(batch.n_docs + 1))
    usable = np.flatnonzero(batch.n_words > 0)
    sides = [usable[labels[usable] == y] for y in (0, 1)]
    net = new_net(seed)
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    squares = {k: np.full(len(net[k]), 1e-3, np.float32) for k in ("words", "grams")}
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.items() if k not in squares}
    gram_ends = np.concatenate(([0], np.cumsum(vocabulary.n_grams)))
    for step in range(1, steps + 1):
        docs = np.concatenate([rng.choice(s, n) for s, n in zip(sides, BATCH)])
        picks = [begin[d] + (np.arange(begin[d + 1] - begin[d]) if begin[d + 1] - begin[d] <= TRAIN_WINDOWS else rng.choice(begin[d + 1] - begin[d], TRAIN_WINDOWS, replace=False)) for d in docs]
        at, owner = np.concatenate(picks), np.repeat(np.arange(len(docs)), [len(p) for p in picks])
        place = np.minimum(first[at][:, None] + np.arange(WINDOW), len(batch.start) - 1)
        words, index = np.unique(vocabulary.index[place], return_inverse=True)
        index = index.reshape(place.shape)
        x = vocabulary.inputs(net, words)
        logit, cache = forward(net, project(net, x), index, size[at], keep=True)
        p = _sigmoid(logit)
        rest = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-6)), len(docs))
        toxic = -np.expm1(rest)
        weight = np.where(labels[docs] == 1, -(1 - toxic) / np.maximum(toxic, 1e-4), 1.0)
        d_logit = (weight[owner] * p / len(docs)).astype(np.float32)
        g, d_in = backward(net, cache, index, size[at], d_logit, len(words))
        d_x = np.zeros_like(x)
        for d in "fb":
            g[f"W{d}"], g[f"B{d}"] = x.T @ d_in[d], d_in[d].sum(axis=0)
            d_x += d_in[d] @ net[f"W{d}"].T
        rate = min(1.0, 2 * (1 - step / (steps + 1)))
        for k, (m, v) in moment.items():
            m += 0.1 * (g[k] - m)
            v += 0.001 * (g[k] * g[k] - v)
            net[k] -= RATE * rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        n = vocabulary.n_grams[words]
        rows = np.repeat(gram_ends[words] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))
        for k, slots, grad in (("words", vocabulary.word_slot[words], d_x[:, :WORD_DIM]), ("grams", vocabulary.gram_slot[rows], np.repeat(d_x[:, WORD_DIM:] / n[:, None], n, axis=0))):
            order = np.argsort(slots, kind="stable")
            head = np.flatnonzero(np.r_[True, slots[order][1:] != slots[order][:-1]])
            total, held = np.add.reduceat(grad[order], head, axis=0), slots[order][head]
            squares[k][held] += (total * total).mean(axis=1)
            net[k][held] -= TABLE_RATE * rate * total / np.sqrt(squares[k][held])[:, None]
    return net


def score_texts(batch: TextBatch, net: Net) -> np.ndarray:
    """The highest window's score of each text."""
    best = np.full(batch.n_docs, -np.inf)
    if len(batch.start):
        vocabulary = Vocabulary(batch)
        projected = project(net, vocabulary.inputs(net))
        first, size, doc = windows(batch)
        for a in range(0, len(first), BLOCK):
            at = slice(a, a + BLOCK)
            place = np.minimum(first[at, None] + np.arange(WINDOW), len(batch.start) - 1)
            logit, _ = forward(net, projected, vocabulary.index[place], size[at])
            np.maximum.at(best, doc[at], logit)
    best[np.isneginf(best)] = float(net["bias"][0])
    return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(key, label, text): at most ``rows`` labelled documents of either class outside the held-out fold."""
    held = picked(labels, **{"doc_id": "long", label: "int"}).withColumnRenamed(label, "label").where("label IS NOT NULL AND doc_id IS NOT NULL")
    held = held.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("key", F.xxhash64("doc_id", F.lit(SEED)))
    chosen = [held.where(F.col("label") == y).orderBy("key", "doc_id").limit(rows) for y in (0, 1)]
    return picked(docs, doc_id="long", text="string").join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").select("key", "label", F.coalesce("text", F.lit("")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> Net:
    found = training_sample(docs, labels, label, rows).limit(4 * rows).toArrow().sort_by([("key", "ascending"), ("text", "ascending")])
    y = np.array(found.column("label").to_pylist(), np.int64)
    if len(set(y.tolist())) < 2:
        net = {k: v * 0 for k, v in new_net().items()}
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return net | {"bias": np.array([np.log(share / (1 - share))], np.float32)}
    return train(as_large(found.column("text")), y)


def scorer(net: Net) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = as_large(part.column("text"))
            for lo, hi in chunks(texts):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(lo, hi - lo), pa.array(score_texts(TextBatch(texts, lo, hi), net))], ["doc_id", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) for every row of ``docs``; the labels' fold 2 is never trained on."""
    net = fit(docs, labels, label, rows)
    return picked(docs, doc_id="long", text="string").mapInArrow(scorer(net), "doc_id long, score double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all of ``documents`` as ``labels.toxic`` marks it."""
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: A trained model: held-out accuracy is tested instead.
ORACLE_SQL: dict[str, str] = {}
