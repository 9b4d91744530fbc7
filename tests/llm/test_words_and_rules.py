import collections
import re

import numpy as np
import pyarrow as pa

from shoptide.llm import length_packing, quality_rules
from shoptide.llm.textbatch import TextBatch, as_large, chunks, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    n = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def plain_rules(rows, min_docs, share, least_left):
    """The operator restated row by row."""
    norm = lambda line: tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(line))
    held, hosts = collections.defaultdict(set), collections.defaultdict(set)
    for _, text, host in rows:
        hosts[host].add(text)
        for line in (text or "").split("\n"):
            if norm(line):
                held[host, norm(line)].add(text)
    frequent = {k for k, v in held.items() if len(v) > min_docs and len(v) > share * len(hosts[k[0]])}
    out = []
    for doc_id, text, host in rows:
        counts = plain_counts(text)
        lines = (text or "").split("\n")
        gone = [i for i, line in enumerate(lines) if (host, norm(line)) in frequent]
        removed = sum(len(norm(lines[i])) for i in gone)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        out.append((doc_id, *counts, failed, not failed and counts[0] - removed >= least_left * counts[0], removed, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_words_and_shingles_of_any_bytes():
    texts = ["", "a b", " lead  and trail \n", "Same same SAME same same same same", "é à b ▁ 漢字 x\x0by\x0cz\r\n" * 3, None, "x" * 3000]
    arr = as_large(pa.array(texts))
    assert [hi for _, hi in chunks(arr, 10)][-1] == len(texts)
    batch = TextBatch(arr)
    for d, text in enumerate(texts):
        words = (text or "").encode().split()
        got = [bytes(batch.bytes[a:b]) for a, b in zip(batch.start[batch.word_at[d]:batch.word_at[d + 1]], batch.end[batch.word_at[d]:batch.word_at[d + 1]])]
        assert got == words
        low = [w.lower() for w in words]
        expected = set(zip(low, low[1:], low[2:], low[3:], low[4:])) if len(low) >= 5 else {tuple(low)} - {()}
        doc, h = shingle_sets(batch)
        assert len(set(h[doc == d].tolist())) == (doc == d).sum() == len(expected)


def test_base_counts_match_plain_ones(odd_rows):
    texts = [t for _, t in odd_rows] + ["x y z a b x y z a b x", "p q\np q\n\n  \np q", "#a* $%&|<>", "a\n\na\nb \nb"]
    arr = as_large(pa.array(texts))
    batch = TextBatch(arr)
    counts = quality_rules.base_counts(batch)
    doc, _, _, _, raw = quality_rules.lines_of(batch)
    counts["n_dup_lines"] = batch.per_doc(doc) - quality_rules._distinct_per_doc(batch, doc, raw)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert list(zip(*(counts[c].tolist() for c in names))) == [plain_counts(t) for t in texts]


def test_line_frequency_against_a_plain_restatement(spark, docs, odd_rows):
    body = lambda i: " ".join(f"w{i}v{k}" for k in range(30))
    rows = [(100 + i, f"Shared  Header line\n{body(i)}\nfooter {i % 3}", "h1") for i in range(12)]
    rows += [(200 + i, "shared header line\nfooter 0 and some more words to reach ten in all of it", "h1") for i in range(4)]  # copies count once
    rows += [(300 + i, f"shared header line\n{body(i)}", "h2") for i in range(3)]
    rows += [(400 + i, ("footer 1\n" * 12) + f"tail {i}", "h1") for i in range(5)]
    rows += [(500 + i, f"one long banner line of twelve words that every page here has\nt{i}", "h3") for i in range(6)]  # depleted
    rows += [(i, t, None) for i, t in odd_rows]
    expected = plain_rules(rows, 4, 0.05, 0.2)
    got = quality_rules.line_verdicts(docs(rows, clash=True), min_docs=4, share=0.05).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words"]
    assert sorted((tuple(r[c] for c in names) for r in got), key=key) == sorted((r[:9] for r in expected), key=key)
    assert any(r[8] for r in expected) and any(not r[6] and not r[7] for r in expected)
    kept = quality_rules.cleaned(docs(rows, clash=True), min_docs=4, share=0.05)
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()) == sorted((r[0], r[9], len(r[9])) for r in expected if r[7])
    assert kept.columns == docs(rows, clash=True).columns


def test_rules_on_an_empty_table(docs):
    assert quality_rules.line_verdicts(docs([])).count() == 0
    assert quality_rules.cleaned(docs([])).count() == 0


def least_padding(lengths, counts, buckets):
    """All ways to choose the ends, tried one after another."""
    import itertools

    d = len(lengths)
    best = None
    for k in range(min(buckets, d)):
        for cuts in itertools.combinations(range(d - 1), k):
            ends = [*cuts, d - 1]
            padding, at = 0, 0
            for e in ends:
                padding += sum(counts[i] * (lengths[e] - lengths[i]) for i in range(at, e + 1))
                at = e + 1
            best = padding if best is None else min(best, padding)
    return best


def test_bucket_ends_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(60):
        d = int(rng.integers(1, 10))
        lengths = np.sort(rng.choice(60, d, replace=False)) + 1
        counts = rng.integers(1, 9, d)
        for buckets in (1, 2, 3, 5, 20):
            ends, padding = length_packing.bucket_ends(lengths, counts, buckets)
            assert padding == least_padding(lengths.tolist(), counts.tolist(), buckets)
            assert len(ends) <= buckets and ends[-1] == lengths[-1] and ends == sorted(set(ends))
            place = np.searchsorted(ends, lengths)
            assert int((counts * (np.array(ends)[place] - lengths)).sum()) == padding


def test_batches_hold_the_budget_and_every_row_once(docs, odd_rows):
    rows = odd_rows + [(1000 + i, " ".join(["w"] * (i % 37))) for i in range(400)] + [(7777, "same row")] * 50
    out = length_packing.packed(length_packing.sequence_lengths(docs(rows, clash=True)), buckets=4, budget=256).collect()
    expected = sorted(((i is None, i or 0), len(WORD.findall(t or "")) + 1) for i, t in rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"]) for r in out) == expected
    places = collections.defaultdict(set)
    for r in out:
        assert r["n_tokens"] <= r["bucket_tokens"]
        capacity = max(1, 256 // r["bucket_tokens"])
        assert 0 <= r["slot"] < capacity and r["slot"] not in places[r["bucket"], r["batch"]]
        places[r["bucket"], r["batch"]].add(r["slot"])
    sizes = collections.defaultdict(dict)
    for (bucket, batch), slots in places.items():
        sizes[bucket][batch] = len(slots)
    for bucket, batches in sizes.items():  # every batch but the last is full
        assert sorted(batches) == list(range(len(batches)))
        assert len({n for b, n in batches.items() if b < len(batches) - 1}) <= 1
    again = length_packing.packed(length_packing.sequence_lengths(docs(rows).repartition(7)), buckets=4, budget=256).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert length_packing.packed(length_packing.sequence_lengths(docs([]))).count() == 0


def test_a_line_of_many_documents_goes_from_hosts_of_any_size(docs):
    rows = [(i, f"the footer of this page\n{' '.join(f'w{i}v{k}' for k in range(12))}", "small") for i in range(21)]
    rows += [(100 + i, ("the footer of this page\n" if i < 21 else "") + " ".join(f"w{i}v{k}" for k in range(12)), "large") for i in range(2200)]
    out = quality_rules.line_verdicts(docs(rows)).where("removed_words > 0").groupBy("host").count().collect()
    assert {r["host"]: r["count"] for r in out} == {"small": 21, "large": 21}
