import collections
import hashlib
import random
import re

import numpy as np

from shoptide.llm import exact_dedup, ngram_jaccard_join
from shoptide.llm.components import components

from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    name = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return sorted(((d, len(sets[i]), name[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_exact_dedup_against_a_plain_one(docs, odd_rows):
    rows = odd_rows + [(50 + i, "the same text") for i in range(30)]
    out = exact_dedup.deduplicate(docs(rows, clash=True)).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(out) == len(rows)
    stays = collections.Counter()
    for r in out:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = groups[text]
        assert r["group_size"] == len(ids) and r["doc_id"] in ids
        assert r["keep_id"] == max((x for x in ids if x is not None), default=None)
        if r["kept"]:
            stays[text] += 1
            assert r["doc_id"] == r["keep_id"]
    assert stays == {t: 1 for t in groups}
    kept = exact_dedup.kept_rows(docs(rows, clash=True))
    assert kept.columns == docs(rows, clash=True).columns
    assert sorted(t or "" for (t,) in kept.select("text").collect()) == sorted(groups)
    assert exact_dedup.deduplicate(docs([])).count() == 0


def test_digest_index_keeps_what_came_first(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.deduplicate(docs([(1, "a"), (2, "b"), (3, "a")]), index).collect()
    assert {r["doc_id"] for r in first if r["kept"]} == {2, 3}
    second = exact_dedup.deduplicate(docs([(9, "a"), (8, "c")]), index).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in second} == {(9, 3, False), (8, 8, True)}
    again = exact_dedup.DigestIndex(spark, path=index.path, buckets=4)
    assert again.rows().count() == 3
    plan = index.rows().select("digest").join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000, 5001), (5001, 5000), (7, 7)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and all(out[1000 + i] == 1000 for i in range(40)) and out[5001] == 5000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signatures_of_linked_sets_always_meet():
    rng = np.random.default_rng(8)
    for n in (4, 5, 6, 9, 13, 20, 33, 60, 150, 400, 1500):
        for _ in range(40):
            pool = rng.integers(1, 1 << 63, 3 * n, dtype=np.int64).astype(np.uint64)
            x = np.unique(pool[:n])
            changed = int(rng.integers(0, n // 4 + 1))
            lost = int(rng.integers(0, changed + 1))
            y = np.unique(np.concatenate([x[lost:], pool[n:n + changed - lost]]))
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            key, owner = ngram_jaccard_join.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]))
            assert np.array_equal(x, y) or set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_near_copies_shared_passages_and_odd_rows(docs, odd_rows, monkeypatch):
    rng = random.Random(6)
    base, passage = prose(rng, 70), prose(rng, 45)
    rows = list(odd_rows)
    for i in range(90):  # a dense group: copies with up to a few changed words, and changed ends
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "".join(rng.choice("klmnop") for _ in range(5))
        rows.append((1000 + i, " ".join(words[:rng.randint(60, 70)])))
    rows += [(2000 + i, " ".join(prose(rng, 25) + passage + prose(rng, 25))) for i in range(60)]  # one passage in different texts
    rows += [(3000 + i, " ".join(prose(rng, 8))) for i in range(20)] + [(3100 + i, "A b C d e f g h") for i in range(5)] + [(3200, "a B c D e f g H i")]
    expected = plain_components(rows)
    assert got(ngram_jaccard_join.link_components(docs(rows, clash=True))) == expected
    for name, value in (("SMALL", (2, 16)), ("SAMPLE", 8), ("GROUP_SETS", 40)):  # large groups are divided
        monkeypatch.setattr(ngram_jaccard_join, name, value)
    assert got(ngram_jaccard_join.link_components(docs(rows))) == expected


def test_a_settled_group_has_the_components_of_all_its_links():
    rng = np.random.default_rng(5)
    base = rng.integers(1, 1 << 63, 120).astype(np.uint64)
    for spread in (6, 14, 22, 40):
        sets = []
        for _ in range(60):
            gone = int(rng.integers(0, spread))
            sets.append(np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(1, 1 << 63, int(rng.integers(0, spread))).astype(np.uint64)])))
        sets += [rng.integers(1, 1 << 63, 30).astype(np.uint64) for _ in range(3)]
        root = list(range(len(sets)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    root[find(i)] = find(j)
        wanted = {frozenset(j for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets))}
        links = ngram_jaccard_join._settle([np.sort(x) for x in sets])
        assert len(links) < len(sets)
        root = list(range(len(sets)))
        for i, j in links:
            root[find(i)] = find(j)
        assert {frozenset(j for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets))} == wanted


def test_one_row_of_a_component_stays(docs):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (7, "other words that are not the same"), (8, None), (9, "")]
    kept = ngram_jaccard_join.one_per_component(docs(rows, clash=True))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8, 9]
    assert ngram_jaccard_join.link_components(docs([])).count() == 0
    assert ngram_jaccard_join.one_per_component(docs([])).count() == 0


def test_one_row_of_a_component_stays_without_ids(docs):
    near = [f"a b c d e f g h i j k l m n o p q r s t u v w x y {end}" for end in ("z", "Y1", "Y2")]
    alone = "words that stand in no other row of the table at all"
    rows = [(None, near[0]), (None, near[1]), (4, near[2]), (None, alone), (None, alone), (None, "P q r s t"), (None, "p q r s t")]
    rows += [(9, "one text of the id nine"), (9, "another text of the same id"), (2, "twice the same row"), (2, "twice the same row"), (None, None), (None, None), (None, " \n")]
    kept = ngram_jaccard_join.one_per_component(docs(rows, clash=True))
    assert kept.columns == docs(rows, clash=True).columns
    out = collections.Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect())
    assert out == collections.Counter([(4, near[2].lower()), (None, alone), (None, "p q r s t"), (9, rows[7][1]), (9, rows[8][1]), (2, rows[9][1]), (None, ""), (None, ""), (None, " \n")])
