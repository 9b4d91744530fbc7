import hashlib
import random

import numpy as np
import pytest

from shoptide.llm import segment_bpe as sb

from .conftest import SCHEMA
from .test_tokens import hard_texts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(sb.default_tokenizer())


@pytest.fixture(scope="module")
def bpe():
    return sb.SegmentTreeBpe(sb.default_tokenizer())


def test_tree_root_is_the_least_value():
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 8, 9, 33):
        leaves = [rng.randrange(100) for _ in range(n)]
        tree = sb.PairTree(list(leaves), 1000)
        for _ in range(200):
            i, value = rng.randrange(n), rng.choice([1000, rng.randrange(100)])
            leaves[i] = value
            tree.put(i, value)
            assert tree.root() == min(leaves)


def by_definition(bpe, data):
    ids = [bpe.first[b] for b in data]
    while True:
        ranks = [(bpe.rank_of[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in bpe.rank_of]
        if not ranks:
            return ids
        rank, i = min(ranks)
        ids[i:i + 2] = [bpe.merged[rank]]


def test_pieces_against_merging_by_definition(bpe):
    rng = random.Random(6)
    for n in range(1, 80):
        some = [bytes(rng.choice(b"abcdeinrst \xc3\xa9") for _ in range(n)) for _ in range(20)]
        want = [by_definition(bpe, data) for data in some]
        assert [bpe.merge(data) for data in some] == want
        assert [np.frombuffer(ids, np.uint32).tolist() for ids in bpe.merge_many(some)] == want


def test_texts_against_the_library(bpe, library):
    texts = hard_texts(1500, 9) + ["".join(map(chr, range(a, a + 40))) for a in range(0, 0xD000, 40)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text).tolist() == ids
        assert bpe.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_any_ids_decode_as_in_the_library(bpe, library):
    rng = np.random.default_rng(7)
    for _ in range(300):
        ids = rng.integers(0, 50257, rng.integers(0, 12))
        assert bpe.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_slices_and_kept_pieces_change_nothing(bpe, library, monkeypatch):
    texts = hard_texts(200, 10) + [" ".join(hard_texts(300, 11)), "no_space" * 3000]
    monkeypatch.setattr(sb, "GROUP_CHARS", 50)
    monkeypatch.setattr(sb, "HELD", 20)
    small = sb.SegmentTreeBpe(sb.default_tokenizer())
    for text in texts:
        assert small.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in small.encode_many(texts)] == want
    assert len(small.held) <= 20 and len(small.older) <= 20 + 50


def test_query_rows(spark, docs, odd_rows, library, tmp_path):
    rows = odd_rows + [(20 + i, t) for i, t in enumerate(hard_texts(80, 12))]
    df = docs(rows, clash=True).selectExpr("*", "'x' AS ids")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in sb.op13_segment_tree_bpe(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table_and_other_tokenizers(spark, tmp_path):
    import public_tokenizers

    path = sb.default_tokenizer()
    assert sb.decoded(sb.encoded(spark.createDataFrame([], SCHEMA), path), path).collect() == []
    with pytest.raises(ValueError):
        sb.SegmentTreeBpe(public_tokenizers.path("word_bpe_49k.json"))
