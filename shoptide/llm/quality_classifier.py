"""Operator 6, quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed features: each word,
each character 3-gram and 4-gram of its words (edges marked), and the mark
``again`` for a word that repeats one of the last ``LOOK_BACK`` words. A softmax
over the average gives the two class probabilities. Vectors and output layer
are trained together in numpy by stochastic gradient descent with a falling
step, over the ``TRAIN_ROWS`` labelled rows with the smallest keyed hash of
doc_id outside the held-out fold (a bounded sample; their texts are turned into
feature counts by the executors). Since the average enters the softmax only
through its products with the output weights, scoring sums one number per
feature: it is the same model with the products taken beforehand.

Scoring covers every byte of every text in one pass without a shuffle.

Defined results: a null or empty text, or one without words, gets the model's
score for no features (the output bias); rows with a null label are not
trained on; repeated rows get equal scores; without any label of one of the
classes, all scores are the share of label 1 (0.5 without labels). Extra
columns are ignored by :func:`scored` and kept by :func:`accepted`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, give_back, picked, table
from .textbatch import TextBatch, as_large, chunks

BITS = 17
DIM = 16
LOOK_BACK = 8
TRAIN_ROWS = 3000
STEPS = 600
BATCH = 32
RATE = 60.0
SEED = 11
AGAIN = 0
HELD_OUT = 2


def _slot(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)


def features(batch: TextBatch) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(slots, positions, by byte): feature slots with the byte (or word) at which each stands."""
    words = batch.word_hashes(lower=False)
    yield (words >> np.uint64(64 - BITS)).astype(np.int32), np.arange(len(words)), False
    again = np.zeros(len(words), bool)
    for back in range(1, LOOK_BACK + 1):
        again[back:] |= (words[back:] == words[:-back]) & (batch.doc[back:] == batch.doc[:-back])
    at = np.flatnonzero(again)
    yield np.full(len(at), AGAIN, np.int32), at, False
    n = len(batch.bytes)
    clean = np.where(batch.solid, batch.bytes, 0).astype(np.uint32)
    before, after, second = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    if n:
        before[1:] = np.where(batch.edge[1:-1], 0, clean[:-1])
        after[:-1] = np.where(batch.edge[1:-1], 0, clean[1:])
        second[:-1] = np.where(after[:-1] > 0, after[1:], 0)
    at = np.flatnonzero(batch.solid)
    three = (before << np.uint32(16) | clean << np.uint32(8) | after)[at]
    yield _slot(three * np.uint32(2) + np.uint32(1)), at, True
    yield _slot((three ^ second[at] << np.uint32(24)) * np.uint32(0x85EBCA6B) ^ np.uint32(0x5BD1E995)), at, True


def _doc_sums(batch: TextBatch, values: np.ndarray, at: np.ndarray, by_byte: bool) -> np.ndarray:
    edges = np.searchsorted(at, batch.doc_at if by_byte else batch.word_at)
    return np.diff(np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))[edges])


def score_texts(batch: TextBatch, weight: np.ndarray, bias: float) -> np.ndarray:
    """P(label 1) for each text, from one number per feature slot."""
    total, n = np.zeros(batch.n_docs), np.zeros(batch.n_docs)
    for slots, at, by_byte in features(batch):
        total += _doc_sums(batch, weight[slots], at, by_byte)
        n += np.diff(np.searchsorted(at, batch.doc_at if by_byte else batch.word_at))
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -30, 30)))


def count_features(batch: TextBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text, its distinct slots and their shares among all its features."""
    keys = []
    for slots, at, by_byte in features(batch):
        n = np.diff(np.searchsorted(at, batch.doc_at if by_byte else batch.word_at))
        keys.append(np.repeat(np.arange(batch.n_docs, dtype=np.int64), n) << BITS | slots)
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    ends = np.searchsorted(key, np.arange(batch.n_docs + 1, dtype=np.int64) << BITS)
    return [((key[a:b] & ((1 << BITS) - 1)).astype(np.int32), (n[a:b] / max(1, n[a:b].sum())).astype(np.float32)) for a, b in zip(ends[:-1], ends[1:])]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = STEPS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, output weights, output bias) after ``steps`` mini-batches over (slots, shares, label) rows."""
    rng = np.random.Generator(np.random.PCG64(seed))
    vectors = (rng.random((1 << BITS, DIM), dtype=np.float32) - 0.5) / DIM
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    order = np.empty(0, np.int64)
    for step in range(steps):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(rows))])
        pick, order = order[:BATCH], order[BATCH:]
        batch = [rows[i] for i in pick]
        slots = np.concatenate([r[0] for r in batch])
        share = np.concatenate([r[1] for r in batch])
        ends = np.cumsum([len(r[0]) for r in batch])
        owner = np.repeat(np.arange(len(batch)), np.diff(np.r_[0, ends]))
        mean = np.zeros((len(batch), DIM), np.float32)
        weighted = vectors[slots] * share[:, None]
        for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
            mean[i] = weighted[a:b].sum(axis=0)
        logit = mean @ out + bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(batch)), [r[2] for r in batch]] -= 1
        p /= len(batch)
        rate = RATE * (1 - step / steps)
        back = p @ out.T
        out -= rate * 0.05 * (mean.T @ p)
        bias -= rate * 0.01 * p.sum(axis=0)
        by_slot = np.argsort(slots, kind="stable")
        ordered = slots[by_slot]
        first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
        vectors[ordered[first]] -= rate * np.add.reduceat(back[owner[by_slot]] * share[by_slot, None], first, axis=0)
    return vectors, out, bias


def products(vectors: np.ndarray, out: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, float]:
    """Each slot's part in the difference of the two logits, and the bias's."""
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _extract(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        texts = as_large(part.column("text"))
        for lo, hi in chunks(texts):
            batch = TextBatch(texts, lo, hi)
            rows = count_features(batch)
            yield pa.RecordBatch.from_arrays(
                [part.column("key").slice(lo, hi - lo), part.column("label").slice(lo, hi - lo),
                 pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float32()))],
                ["key", "label", "slots", "shares"])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(key, label, text): at most ``rows`` labelled documents outside the held-out fold, by smallest keyed hash of doc_id."""
    held = picked(labels, **{"doc_id": "long", label: "int"}).withColumnRenamed(label, "label").where("label IS NOT NULL AND doc_id IS NOT NULL")
    held = held.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = held.withColumn("key", F.xxhash64("doc_id", F.lit(SEED))).orderBy("key", "doc_id").limit(rows)
    texts = picked(docs, doc_id="long", text="string")
    return texts.join(F.broadcast(chosen), "doc_id").select("key", "label", F.coalesce("text", F.lit("")).alias("text"))


def _training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(slots, shares, label) of the bounded sample, in the order of its keys."""
    sample = training_sample(docs, labels, label, rows)
    found = sample.mapInArrow(_extract, "key long, label int, slots array<int>, shares array<float>").limit(2 * rows).toArrow().sort_by("key")
    y = found.column("label").to_pylist()
    slots, shares = found.column("slots"), found.column("shares")
    return [(np.asarray(slots[i].values), np.asarray(shares[i].values), y[i]) for i in range(len(y))]


def fit(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """The scoring numbers of a model trained on a bounded sample."""
    data = _training_rows(docs, labels, label, rows)
    y = [r[2] for r in data]
    if len(set(y)) < 2:
        share = min(max(float(np.mean(y)) if y else 0.5, 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    model = products(*train(data))
    del data
    give_back()  # the driver goes on beside its JVM for all later stages
    return model


def scorer(weight: np.ndarray, bias: float) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = as_large(part.column("text"))
            for lo, hi in chunks(texts):
                score = score_texts(TextBatch(texts, lo, hi), weight, bias)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(lo, hi - lo), part.column("text_key").slice(lo, hi - lo), pa.array(score)], ["doc_id", "text_key", "score"])

    return run


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, text_key, score) for every row of ``docs``; the labels' fold 2 is never trained on."""
    weight, bias = fit(docs, labels, label, rows)
    held = picked(docs, doc_id="long", text="string").withColumn("text_key", F.xxhash64("text"))
    return held.mapInArrow(scorer(weight, bias), "doc_id long, text_key long, score double")


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = 0.7, training: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns; ``training`` holds the labelled texts if ``docs`` doesn't."""
    weight, bias = fit(docs if training is None else training, labels, label)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = as_large(part.column("text"))
            keep = [score_texts(TextBatch(texts, lo, hi), weight, bias) >= least for lo, hi in chunks(texts)]
            if keep:
                yield part.filter(pa.array(np.concatenate(keep))).select(["row"])

    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.text").cast("string").alias("text"))  # any names
    return rows.mapInArrow(run, T.StructType([T.StructField("row", docs.schema)])).select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all of ``documents`` as ``labels.quality`` marks it."""
    out = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: A trained model: held-out accuracy is tested instead.
ORACLE_SQL: dict[str, str] = {}
