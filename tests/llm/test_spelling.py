import random
import re
import zlib
from collections import Counter

from shoptide.llm import spelling_variants as sv

from .conftest import SCHEMA


def one_error(a, b):
    """By definition: one insertion, deletion or replacement turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if one_error(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def misspelt(rng, word):
    k, c = rng.randrange(len(word)), rng.choice("abcdeé")
    return rng.choice([word[:k] + word[k + 1:], word[:k] + c + word[k:], word[:k] + c + word[k + 1:]])


def corpus(seed, n_words=60, n_docs=150):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdeÀÿß") for _ in range(rng.randint(5, 9))) for _ in range(n_words)]
    stems += [misspelt(rng, rng.choice(stems)) for _ in range(n_words)]
    rows = []
    for i in range(n_docs):
        words = [rng.choice(stems[:20] if rng.random() < 0.5 else stems) for _ in range(40)]
        rows.append((i, " ".join(misspelt(rng, w) if rng.random() < 0.1 else w.upper() if rng.random() < 0.2 else w for w in words)))
    return rows


def test_words_forms_and_roots(docs, odd_rows):
    rows = corpus(1) + [(1000 + (i or 0), t) for i, t in odd_rows] + [(None, "loose words without number loose words loose words")] * 3
    want = plain(rows)
    df = docs(rows, clash=True)
    for name in ("word", "n", "size", "last", "part", "block", "target"):
        df = df.selectExpr("*", f"'x' AS {name}")
    assert found(sv.variants(df)) == want
    assert any(v[0] for v in want.values()) and any(v[0] and v[1] != v[0] for v in want.values())
    assert len(want) > 150


def test_altered_words_do_occur(docs):
    rows = corpus(2, n_docs=400)
    unaltered = Counter(w for _, t in rows for w in re.findall("[a-zÀ-ÿ]+", t.translate({c: c + 32 for c in range(65, 91)})))
    got = found(sv.variants(docs(rows)))
    assert got == plain(rows)
    assert any(unaltered[w] != v[2] for w, v in got.items())


def test_keys_with_more_words_than_a_block(spark):
    """All words share their first half: one key is dealt over many blocks."""
    rng = random.Random(3)
    words = {"abcde" + "".join(rng.choice("fgh") for _ in range(rng.randint(4, 6))) for _ in range(700)}
    rows = [(w, rng.randint(3, 50)) for w in sorted(words)]
    count = dict(rows)
    got = {r["word"]: (r["n_near"], r["near_n"], r["near"]) for r in sv.near_words(spark.createDataFrame(rows, "word string, n long"), block_words=32).collect()}
    want = {}
    for w in count:
        near = [x for x in count if one_error(w, x)]
        if near:
            best = min(near, key=lambda x: (-count[x], x))
            want[w] = (len(near), count[best], best)
    assert got == want


def test_each_kind_of_error_at_each_position():
    word = "abcdefg"
    others = {word[:k] + word[k + 1:] for k in range(7)} | {word[:k] + "x" + word[k:] for k in range(8)} | {word[:k] + "x" + word[k + 1:] for k in range(7)}
    far = {"bacdefg", "abcdefgxy", "abcde", "xbcdefx", word, "gfedcba"}
    words = sorted(others | far)
    longer, shorter, _ = sv.PositionIndex(words).near(word, (1 << len(words)) - 1, 0)
    assert {words[k] for k in sv._bits(longer | shorter)} == others


def test_long_texts_are_cut_between_words():
    text = "abcdefgh " * 3000 + "x" * 5000 + "," + "tail words"
    assert "".join(sv.slices(text, 1000)) == text
    assert [w for s in sv.slices(text, 1000) for w in sv.RUNS.findall(s)] == sv.RUNS.findall(text)


def test_empty_table_and_no_frequent_words(spark, docs):
    assert sv.variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert sv.variants(docs([(1, "only once here"), (2, None), (3, "")])).collect() == []


def test_chains_end_at_their_last_form(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(40)] + [("a", "w3"), ("b", "w40")]
    got = {r["word"]: r["root"] for r in sv.last_forms(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w40" for w, _ in chain}
