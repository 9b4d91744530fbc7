import collections
import random
from functools import lru_cache

import numpy as np
import pyarrow as pa

import corpus_pipeline
from shoptide.llm import length_packing, quality_classifier, token_records
from shoptide.llm.common import table
from shoptide.llm.textbatch import TextBatch, as_large

from .conftest import prose
from .test_dedup_and_join import plain_components
from .test_models import corpus
from .test_words_and_rules import plain_rules

LIMITS = (20, 0.0, 0.2)  # of the rules, as the query has them


def fixture():
    rng = random.Random(12)
    rows, labels = corpus("quality", 240)
    rows = [(i, t, f"s{i % 3}") for i, t in rows]
    rows += [(1000 + i, "Read more of this  here\n" + " ".join(prose(rng, 40)), "s1") for i in range(30)]  # a line that goes
    rows += [(1100 + i, "Read more of this here\n" + " ".join(prose(rng, 40)), "s2") for i in range(9)]  # a line that stays
    rows += [(1200 + i, "read MORE of this here\n" * 9 + f"tail {i} a b c d e f g h", "s1") for i in range(4)]
    base = prose(rng, 60)
    rows += [(2000 - i, " ".join([*base, *prose(rng, i % 3)]), "s0") for i in range(9)]  # exact and near copies
    rows += [(None, " ".join([*base, "another", "end"]), "s0"), (None, " ".join(prose(rng, 50)), None)]
    lone = prose(rng, 50)
    rows += [(None, " ".join([*lone, *more]), "s1") for more in ([], ["x"], ["y", "z"], ["x"])]  # near copies without ids
    rows += [(3000, None, "s0"), (3001, "", "s0"), (None, None, None), (3002, "too few words", "s0"), (3003, "a b c " * 30, "s0")]
    return rows, labels


def plain_pipeline(rows, weight, bias):
    """(doc_id or None, text) after all stages but packing."""
    rows = [(r[0], r[9] if r[8] else t) for r, (_, t, _) in zip(plain_rules(rows, *LIMITS), rows) if r[7]]
    after = [len(rows)]
    features = quality_classifier.count_features(TextBatch(as_large(pa.array([t for _, t in rows]))))
    score = [1 / (1 + np.exp(-(float((weight[slots].astype(float) * share).sum()) + bias))) for slots, share in features]
    assert min(abs(s - 0.7) for s in score) > 1e-4
    rows = [r for r, s in zip(rows, score) if s >= 0.7]
    after.append(len(rows))
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    rows = [(max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items()]
    after.append(len(rows))
    numbered = [(10**6 + k if i is None else i, t) for k, (i, t) in enumerate(rows)]  # rows without ids come last
    first = {d for d, _, name in plain_components(numbered) if d == name}
    rows = [r for r, (i, _) in zip(rows, numbered) if i in first]
    return rows, [*after, len(rows)]


def least_padding(lengths, buckets):
    n = collections.Counter(lengths)
    d = sorted(n)

    @lru_cache(None)
    def best(j, k):
        if j == 0:
            return 0
        return min((best(i, k - 1) + sum(n[x] * (d[j - 1] - x) for x in d[i:j]) for i in range(j)), default=0) if k else float("inf")

    return best(len(d), buckets)


def test_the_pipeline_against_a_plain_rebuild(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    rows, labels = fixture()
    docs(rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    weight, bias = quality_classifier.fit(table(spark, str(tmp_path), "documents"), table(spark, str(tmp_path), "labels"), "quality")
    left, after = plain_pipeline(rows, weight, bias)
    assert len(rows) > after[0] > after[1] > after[2] > after[3] > 0  # each stage has something to do

    tokenizer = Tokenizer.from_file(token_records.default_tokenizer())
    tokenizer.encode_special_tokens = True
    lengths = [(i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in left]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Among near copies without ids, a hash of the text says which stays, so their lengths may differ by its last words.
    named = lambda x: sorted((i, n) for i, n in x if i is not None)
    assert named((r["doc_id"], r["n_tokens"]) for r in out) == named(lengths)
    assert sum(r["doc_id"] is None for r in out) == sum(i is None for i, _ in left)

    assert sum(r["bucket_tokens"] - r["n_tokens"] for r in out) == least_padding([r["n_tokens"] for r in out], length_packing.BUCKETS)
    for bucket in {r["bucket"] for r in out}:
        mine = [r for r in out if r["bucket"] == bucket]
        assert len({r["bucket_tokens"] for r in mine}) == 1
        capacity = max(1, length_packing.BUDGET // mine[0]["bucket_tokens"])
        assert sorted((r["batch"], r["slot"]) for r in mine) == [divmod(k, capacity) for k in range(len(mine))]


def test_the_pipeline_over_an_empty_table(spark, docs, tmp_path):
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
