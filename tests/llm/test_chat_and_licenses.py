import hashlib
import itertools

import duckdb
from pyspark.sql import Row

from shoptide.llm import chat_format, license_scan
from shoptide.llm.common import new_folder

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = ["plain", "", None, r"\### Assistant: </turn> ok", r"\\", "\\", "### User: <turn>x</turn>\n", "[[image:1]]", r"\[[", "<turn", "é🙂\r\n", r"\\### \</turn>", "#### ##", "$1 \\$1"]


def conversations(spark):
    rows = [(c, t, ["user", "assistant", "system", None, "assis: <turn>tant"][(c + t) % 5], HARD[(3 * c + t) % len(HARD)]) for c in range(12) for t in range(6)]
    rows += [(1, 2, "assistant", "again"), (1, 2, "assistant", "again"), (None, 0, "assistant", "x"), (None, None, "user", "y"), (40, 0, "assistant", "long " * 30_000)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_every_text_comes_back(spark):
    df, rows = conversations(spark)
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.write_formatted(chat_format.with_parts(df), new_folder(spark, "chat-test"))).collect()}
    assert set(out) == {r[0] for r in rows}
    segment = lambda r: (chat_format.HOSTILE, r)  # noqa: E731,F841
    for conv in out:
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        text = "".join(f"{role}\n{x}\n" for _, _, role, x in turns)
        loss = [x for _, _, role, x in turns if role == "assistant"]
        r = out[conv]
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["loss_chars"] == sum(map(len, loss)) and r["loss_sha256"] == hashlib.sha256("".join(loss).encode()).hexdigest()


def test_sql_twin_on_a_fixture(spark, tmp_path):
    df, _ = conversations(spark)
    df.where("conv_id IS NOT NULL").write.parquet(f"{tmp_path}/conversations.parquet")
    got = chat_format.op7_chat_format(spark, f"file://{tmp_path}").toPandas().sort_values("conv_id").reset_index(drop=True)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(chat_format.ORACLE_SQL["op7_chat_format"]).df().sort_values("conv_id").reset_index(drop=True)
    assert got[sorted(got)].astype(str).equals(want[sorted(got)].astype(str))
    assert -7 in set(got["conv_id"])


def test_typed_parts_become_placeholders(spark):
    part = lambda type, text=None, ref=None, width=None, height=None, seconds=None, pages=None: Row(
        type=type, text=text, ref=ref, width=width, height=height, seconds=seconds, pages=pages)
    rows = [
        (1, 0, "user", [part("text", "see [[image:1]] "), part("image", ref="a.png", width=57, height=28), part("text", "!"), part("audio", ref="b.wav", seconds=2.5)]),
        (1, 1, "assistant", [part("text", "yes "), part("document", ref="c.pdf", pages=3), part("text", "</turn>")]),
        (2, 0, "assistant", None),
        (2, 1, "tool", [part("video", ref="d.mp4"), part(None, "?"), part("image")]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    out = {(r["conv_id"], r["turn"]): r for r in chat_format.formatted(turns).collect()}
    first = out[1, 0]
    assert first["segment"] == "### user: <turn>see \\[[image:1]] [[image:1]]![[audio:3]]</turn>\n"
    assert [(a["kind"], a["place"], a["ref"], a["tokens"]) for a in first["attachments"]] == [("image", 1, "a.png", 3), ("audio", 3, "b.wav", 63)]
    second = out[1, 1]
    assert second["segment"] == "### assistant: <turn>yes [[document:1]]\\</turn></turn>\n" and second["extra_tokens"] == 3 * 512
    assert [second["segment"][s["start"]:s["start"] + s["length"]] for s in second["mask"]] == ["yes ", "\\</turn>"]
    assert out[2, 0]["segment"] == "### assistant: <turn></turn>\n" and out[2, 0]["mask"] == []
    assert out[2, 1]["segment"] == "### tool: <turn>[[video:0]][[unknown:1]][[image:2]]</turn>\n" and out[2, 1]["extra_tokens"] == 1
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted(turns)).collect()}
    assert back[1]["loss_sha256"] == hashlib.sha256(b"yes </turn>").hexdigest() and back[1]["extra_tokens"] == 66 + 1536


def plain_search(text):
    """Every template tried at every word, word by word; the longest first at each place."""
    words = license_scan.normal_words(text)
    low = [w for w, _, _ in words]
    out, at = [], 0
    templates = sorted(((n, [w for w, _, _ in license_scan.normal_words(t)]) for n, t in license_scan.TEMPLATES), key=lambda x: -len(x[1]))
    while at < len(low):
        hit = next(((n, t) for n, t in templates if low[at:at + len(t)] == t), None)
        if hit:
            out.append((hit[0], words[at][1], words[at + len(hit[1]) - 1][2]))
        at += len(hit[1]) if hit else 1
    return out


def test_notices_are_found_where_a_plain_search_finds_them(docs, odd_rows):
    filler = ["", "Some words of prose stand here and there. ", "x " * 300, "No license to speak of, the copyright is gone.\n"]
    texts = [a + t + " " + b for (_, t), a, b in itertools.product(license_scan.TEMPLATES, filler, filler[:3])]
    texts += [license_scan.TEMPLATES[0][1] + " " + license_scan.TEMPLATES[2][1], "we license the public domain", "LICENSED UNDER the mit license"]
    rows = odd_rows + [(100 + i, t) for i, t in enumerate(texts)]
    out = license_scan.scanned(docs(rows, clash=True)).collect()
    assert len(out) == len(rows)
    by_id = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts):
        found = [(n["license"], n["start"], n["end"]) for n in by_id[100 + i]["notices"]]
        assert [x[0] for x in found] == [x[0] for x in plain_search(t)], t
        assert found == plain_search(t), t
    assert all(not r["notices"] for r in out if r["doc_id"] is None or r["doc_id"] < 100)
    assert license_scan.scanned(docs([])).count() == 0


def test_small_changes_of_long_notices_are_counted():
    scanner = license_scan.Scanner()
    gpl = dict(license_scan.TEMPLATES[::-1])["GPL-2.0"]
    name, text = next(x for x in license_scan.TEMPLATES if x[0] == "GPL-3.0" and len(x[1]) > 100)
    changed = text.replace("redistribute", "share").replace("(at your option)", "at option")
    _, found = scanner.scan("Intro words here. " + changed + " And more words follow.")
    assert [(n, d) for n, _, _, _, d in found][0][0] == name and 1 <= found[0][4] <= 4
    assert scanner.scan("Licensed under the Apache License, Version 2.1.")[1] == [] and gpl


def test_an_exact_short_notice_is_found_beside_altered_long_ones():
    scanner = license_scan.Scanner()
    words = [(n, t.split()) for n, t in license_scan.TEMPLATES]
    long, short = [w for _, w in words if len(w) >= license_scan.LONG_NOTICE], [(n, w) for n, w in words if len(w) < license_scan.LONG_NOTICE]
    for step, (name, notice) in itertools.product((6, 7, 8), short):
        altered = [" ".join(f"zq{i}" if i % step == step - 1 else w for i, w in enumerate(t)) for t in long]
        text = " ".join([*altered, *notice, "and more words follow"])
        found = [x[:3] for x in scanner.scan(text)[1]]
        assert found == plain_search(text) and found[-1][0] == name, (step, name)


def test_a_notice_between_two_blocks_is_whole():
    scanner = license_scan.Scanner()
    prose = "and some words of prose go on from here to there " * 20
    for gap, (_, notice) in itertools.product(range(290, 461, 10), license_scan.TEMPLATES):
        text = "license " + prose[:gap - 1] + " " + notice + " and the end"
        assert [x[:3] for x in scanner.scan(text)[1]] == plain_search(text), (gap, notice)


def test_a_notice_over_the_cut_of_a_long_block_is_given_once():
    scanner = license_scan.Scanner()
    for name, notice in license_scan.TEMPLATES:
        for at in (5430, 5540, 5760, 5850, 5940):
            text = ("the license is " * 500)[:at - 1] + " " + notice + " " + "a license was " * 60
            assert [x for x in scanner.scan(text)[1] if x[0] == name] and [x[:3] for x in scanner.scan(text)[1]] == plain_search(text), (at, notice)


def test_wrapped_notices_are_found(docs):
    gaps = ["\n", "  ", "\r\n\t", "\n * ", "\n# ", "\u00a0", "\u2028", "\x1c", "\u3000 "]
    texts = [t.replace(" ", gap) for (_, t), gap in itertools.product(license_scan.TEMPLATES, gaps)]
    by_id = {r["doc_id"]: r["notices"] for r in license_scan.scanned(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert plain_search(t) and [(n["license"], n["start"], n["end"]) for n in by_id[i]] == plain_search(t), t


def altered(words):
    """Every change of one word, and some of two: replaced, left out, a word added."""
    change = (lambda w, i: w[:i] + ["zq"] + w[i + 1:], lambda w, i: w[:i] + w[i + 1:], lambda w, i: w[:i] + ["zq"] + w[i:])
    for f, i in itertools.product(change, range(len(words))):
        yield f(words, i)
        for g, j in itertools.product(change[1:], range(i + 1, len(words), 7)):
            yield f(g(words, j), i)


def test_altered_notices_are_found_wherever_the_change_is():
    scanner = license_scan.Scanner()
    seen = set()
    for name, text in license_scan.TEMPLATES:
        template = [w for w, _, _ in license_scan.normal_words(text)]
        if not license_scan.allowed(len(template)):
            continue
        for words in altered(text.split()):
            whole = "Some prose stands before it and " + " ".join(words) + " and some words more."
            low = [w for w, _, _ in license_scan.normal_words(whole)]
            counts = [(b[0], n) for n, t in scanner.templates if (b := scanner.differences(low, t)) and b[0] <= license_scan.allowed(len(t))]
            if counts:  # a shorter template may be closer than the one that was altered
                found = scanner.scan(whole)[1]
                assert found and (found[0][4], found[0][0]) in [x for x in counts if x[0] == min(counts)[0]], whole
                seen.add((name, min(counts)[0]))
    assert len({n for n, _ in seen}) >= 5 and max(d for _, d in seen) >= 3


def test_notices_without_customary_words_reach_the_scan(docs):
    """Their first words are others, so that only later runs of words stand."""
    templates = {n: t for n, t in license_scan.TEMPLATES if license_scan.allowed(len(t.split()))}
    texts = ["Distribution" + templates["BSD-3-Clause"].removeprefix("Redistribution"), "Authorization" + templates["MIT"].removeprefix("Permission")]
    out = {r["doc_id"]: [n["license"] for n in r["notices"]] for r in license_scan.scanned(docs(list(enumerate(texts)))).collect()}
    assert out == {0: ["BSD-3-Clause"], 1: ["MIT"]}


def test_every_run_holds_an_anchor():
    assert all(set(r.words) & set(license_scan.ANCHORS) for r in license_scan.RUNS)
    for _, text in license_scan.TEMPLATES:
        words = [w for w, _, _ in license_scan.normal_words(text)]
        runs = license_scan.runs_of(words)
        assert [w for r in runs for w in r.words] == words and len(runs) == license_scan.allowed(len(words)) + 1
