"""Approximate index against a plain search over all pairs, and vectors of decision texts."""

import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoptide.operators.similar import NO_CELL, append_index, build_index, search, text_vector, trace_vectors
from shoptide.session import checkpoint_dir

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture
def folder(spark):
    return f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex[:8]}"


def plain_best(ids, vecs, qid, k=5):
    """The k nearest of one row by one cosine at a time; ties by id."""
    q = vecs[ids.index(qid)]
    scored = []
    for i, v in zip(ids, vecs):
        if i != qid:
            dot = sum(float(a) * float(b) for a, b in zip(q, v))
            scored.append((-round(dot / (np.linalg.norm(q) * np.linalg.norm(v)), 10), i))
    return [(i, -s) for s, i in sorted(scored)[:k]]


def made(kind, n, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if kind == "clusters":
        x = x * 0.2 + rng.normal(size=(20, dim))[rng.integers(0, 20, n)]
    return x.astype(np.float32).astype(float)


@pytest.mark.parametrize("kind", ["clusters", "even"])
def test_recall_against_all_pairs(spark, folder, kind):
    x = made(kind, 1500)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    build_index(df, folder)
    assert spark.read.parquet(f"{folder}/cells").count() == 1500
    queries = df.where(F.col("vec_id") % 10 == 0)
    got = {}
    for r in search(queries, folder, block_rows=100).collect():
        got.setdefault(r.qid, []).append((r.rank, r.cid, r.score))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for qid in range(0, 1500, 10):
        s = u @ u[qid]
        s[qid] = -9
        top = np.argsort(-s, kind="stable")[:5]
        assert [r for r, _, _ in sorted(got[qid])] == [1, 2, 3, 4, 5]
        for _, cid, score in got[qid]:
            assert abs(s[cid] - score) < 1e-6  # exact rescoring
        hits += len(set(top) & {c for _, c, _ in got[qid]})
    assert hits >= 0.9 * 150 * 5
    model = spark.read.parquet(f"{folder}/model").collect()
    if kind == "clusters":
        assert model[0].probes <= len(model) / 3  # far from reading everything


def test_all_cells_equal_plain_search_with_ties_and_copies(spark, folder):
    x = made("even", 60, dim=4)
    x[20:50] = x[20]  # half of the rows are one vector: a hot cell and ties
    ids = list(range(60))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    build_index(df.union(df), folder, cells=5)  # repeated rows count once
    got = {}
    for r in search(df, folder, probes=5, block_rows=7).collect():
        got.setdefault(r.qid, {})[r.rank] = (r.cid, round(r.score, 6))
    for qid in ids:
        assert [got[qid][r] for r in sorted(got[qid])] == [(i, round(s, 6)) for i, s in plain_best(ids, x, qid)], qid


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_exact_search_over_many_blocks(spark, coalesce):
    """Blocks of both sides meet, however the shuffle is read."""
    from shoptide.operators.vectors import cosine_topk
    x = made("even", 300, dim=6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        rows = cosine_topk(df.where("vec_id % 7 = 0"), df, block_rows=20).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = {}
    for r in rows:
        got.setdefault(r.qid, {})[r["rank"]] = r.cid
    for qid in range(0, 300, 7):
        assert [got[qid][i] for i in sorted(got[qid])] == [i for i, _ in plain_best(list(range(300)), x, qid)]


def test_rows_without_direction_append_and_other_ids(spark, folder):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("zero", [0.0, 0.0]), ("none", None),
            ("empty", []), ("long", [1.0, 2.0, 3.0]), ("hole", [1.0, None]), ("nan", [float("nan"), 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").withColumn("cell", F.lit("extra"))
    build_index(df, folder, cells=2)
    held = {r.id: r.cell for r in spark.read.parquet(f"{folder}/cells").collect()}
    assert set(held) == {"a", "b", "c", "zero", "none", "empty", "long", "hole", "nan"}
    assert {i for i, c in held.items() if c == NO_CELL} == {"zero", "none", "empty", "long", "hole", "nan"}
    best = {r.qid: r.cid for r in search(df, folder, k=1, probes=2).collect()}
    assert best == {"a": "b", "b": "a", "c": "b"}
    more = spark.createDataFrame([("d", [0.0, 2.0]), ("a", [0.0, 1.0])], "vec_id string, embedding array<double>")
    append_index(more, folder)
    append_index(more, folder)
    assert spark.read.parquet(f"{folder}/cells").count() == 10
    best = {r.qid: r.cid for r in search(df, folder, k=1, probes=2).collect()}
    assert best == {"a": "b", "b": "a", "c": "d"}  # "a" kept its vector


def test_empty_table(spark, folder):
    df = spark.createDataFrame([], SCHEMA)
    build_index(df, folder)
    assert search(df, folder).collect() == []
    append_index(spark.createDataFrame([(1, [1.0])], SCHEMA), folder)
    assert search(spark.createDataFrame([(1, [1.0])], SCHEMA), folder).collect() == []


def plain_vector(text, dim):
    words, w = [], ""
    for ch in (text or "").lower() + " ":
        if ch.isascii() and (ch.isalnum() or ch == "_"):
            w += ch
        elif w:
            words.append(w)
            w = ""
    out = [0.0] * dim
    for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
        h = int(hashlib.md5(f"decision:{f}".encode()).hexdigest()[:8], 16)
        out[h % dim] += 1.0 if h // dim % 2 == 0 else -1.0
    return out


def test_text_vectors(spark):
    texts = ["User exhibited BROWSING intent. SLM proposed SHOW_DEALS. OPA verdict: DENIED.", "one", "", None, "a a a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", text_vector(F.col("t"), 32).alias("v")).collect():
        assert r.v == plain_vector(r.t, 32)


def test_traces_are_searched_by_their_vectors(spark, folder):
    """Same action and intent are nearest, then the same action."""
    texts = {t: f"User exhibited {i} intent. SLM proposed {a}. OPA verdict: DENIED."
             for t, i, a in [("t1", "BROWSING", "OFFER_X"), ("t2", "BROWSING", "OFFER_X"), ("t3", "CARTING", "OFFER_X"),
                             ("t4", "LOYAL_RETURNER", "SEND_MAIL")]}
    df = trace_vectors(spark.createDataFrame(list(texts.items()), "trace_id string, summary string"))
    build_index(df, folder, "trace_id", "vector", cells=1)
    near = {r.rank: (r.cid, r.score) for r in search(df.where("trace_id = 't1'"), folder, 3, "trace_id", "vector").collect()}
    assert near[1] == ("t2", 1.0) and near[2][0] == "t3" and near[3][0] == "t4"


def test_a_full_block_is_compared_in_bounded_memory():
    """Two blocks of 4,096 rows: their whole matrix (128 MB, and copies of it) is never held."""
    import tracemalloc

    import pandas as pd

    from shoptide.operators import similar, vectors

    v = np.random.default_rng(1).normal(size=(8192, 8))
    rows = lambda lo, name: pd.DataFrame({name: np.arange(lo, lo + 4096), "vec": list(v[lo:lo + 4096])})
    for fn, q, c in ((vectors._block_topk(5, True), rows(0, "qid"), rows(4096, "cid")), (similar._best(5, True), rows(0, "id"), rows(4096, "id"))):
        tracemalloc.start()
        out = fn(q, c)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(out) == 5 * 4096 and peak < 100 << 20
