import random

import numpy as np
import pyarrow as pa

from shoptide.llm import quality_classifier, toxicity
from shoptide.llm.common import fold
from shoptide.llm.textbatch import TextBatch, as_large

from .conftest import prose

from pyspark.sql import functions as F


def area(y, score):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def corpus(kind, n=400, seed=2):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(5, 120))
        y = i % 2
        if kind == "toxic" and y:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["rotzq", "zork" + rng.choice(["en", "ig", "a", "et"])]))
        if kind == "quality" and not y:
            words = [w.upper() + "!!" for w in words] if i % 4 == 0 else [w for w in words for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, y))
    return rows, labels


def test_toxicity_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = {k: v.astype(np.float64) for k, v in toxicity.new_net(3).items() if k not in ("words", "grams")}
    x = rng.standard_normal((9, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    index, size = rng.integers(0, 9, (4, toxicity.WINDOW)), np.array([toxicity.WINDOW, 5, 1, 11])
    weight = rng.standard_normal(4)
    value = lambda net, x: float((toxicity.forward(net, toxicity.project(net, x), index, size)[0] * weight).sum())
    _, cache = toxicity.forward(net, toxicity.project(net, x), index, size, keep=True)
    g, d_in = toxicity.backward(net, cache, index, size, weight, len(x))
    for d in "fb":
        g[f"W{d}"], g[f"B{d}"] = x.T @ d_in[d], d_in[d].sum(axis=0)
    g["x"] = sum(d_in[d] @ net[f"W{d}"].T for d in "fb")
    for name in g:
        target = x if name == "x" else net[name]
        for _ in range(4):
            at = tuple(int(rng.integers(0, s)) for s in target.shape)
            old, step = target[at], 1e-3
            target[at] = old + step
            up = value(net, x)
            target[at] = old - step
            down = value(net, x)
            target[at] = old
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name


def test_windows_cover_every_word():
    texts = as_large(pa.array([" ".join(["w"] * n) for n in range(0, 60)]))
    batch = TextBatch(texts)
    first, size, doc = toxicity.windows(batch)
    for d in range(60):
        covered = {int(a) + k for a, s, o in zip(first, size, doc) if o == d for k in range(s)}
        assert covered == set(range(int(batch.word_at[d]), int(batch.word_at[d + 1])))


def test_toxicity_learns_and_holds_out(spark, docs, odd_rows, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 120)
    rows, labels = corpus("toxic")
    y = dict(labels)
    marked = spark.createDataFrame([*labels, (5000, None), (None, 1)], "doc_id long, toxic int")
    more = [(None if i is None else 9000 + i, t) for i, t in odd_rows]
    out = toxicity.scored(docs(rows + more, clash=True), marked).withColumn("fold", fold(F.col("doc_id"))).collect()
    assert len(out) == len(rows) + len(more) and all(0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["doc_id"] in y and r["fold"] == 2]
    assert area(np.array([y[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])) > 0.95
    assert len({r["score"] for r in out if r["doc_id"] in (9001, 9002, 9003)}) == 1
    sample = toxicity.training_sample(docs(rows), marked, "toxic", 30).collect()
    assert len(sample) == 60
    none = toxicity.scored(docs(rows[:5]), marked.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.scored(docs([]), marked).count() == 0


def test_quality_learns_and_holds_out(spark, docs, odd_rows, monkeypatch):
    rows, labels = corpus("quality")
    y = dict(labels)
    marked = spark.createDataFrame([*labels, (None, 1)], "doc_id long, quality int")
    more = [(None if i is None else 9000 + i, t) for i, t in odd_rows]
    out = quality_classifier.scored(docs(rows + more, clash=True), marked).withColumn("fold", fold(F.col("doc_id"))).collect()
    held = [r for r in out if r["doc_id"] in y and r["fold"] == 2]
    assert area(np.array([y[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])) > 0.97
    kept = quality_classifier.accepted(docs(rows, clash=True), marked)
    assert kept.columns == docs(rows, clash=True).columns
    again = {r["doc_id"]: r["score"] for r in out}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows if again[i] >= 0.7}
    share = quality_classifier.scored(docs(rows[:4]), marked.where("quality = 1")).collect()
    assert all(r["score"] > 0.99 for r in share)


def test_products_score_as_the_network_does():
    rows, labels = corpus("quality", 60)
    batch = TextBatch(as_large(pa.array([t for _, t in rows] + [""])))
    data = [(s, w, y) for (s, w), (_, y) in zip(quality_classifier.count_features(batch), labels)]
    vectors, out, bias = quality_classifier.train(data, steps=30)
    got = quality_classifier.score_texts(batch, *quality_classifier.products(vectors, out, bias))
    for i, (slots, share, _) in enumerate(data):
        logit = (vectors[slots] * share[:, None]).sum(axis=0) @ out + bias
        p = np.exp(logit - logit.max())
        assert abs(got[i] - p[1] / p.sum()) < 1e-3


def test_training_leaves_nothing_in_the_driver(spark, monkeypatch):
    """The driver works on beside its JVM after training (was: the sample's memory stayed with it)."""
    held, left = pa.total_allocated_bytes(), []
    give_back = quality_classifier.give_back
    monkeypatch.setattr(quality_classifier, "give_back", lambda: (give_back(), left.append(pa.total_allocated_bytes() - held)))
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "bad line there") for i in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality")
    quality_classifier.fit(docs, labels, "quality")
    assert left and left[0] <= 0
