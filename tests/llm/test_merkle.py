import hashlib
import random
import zlib

from shoptide.llm import merkle_manifest

from .conftest import SCHEMA


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    fields = (row[0], row[3], row[2], row[4], row[1])
    return digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])


def tree(nodes):
    """The top digest and, for each node, its (left, right) siblings level by level."""
    ways, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 16] for i in range(0, len(nodes), 16)]
        for way, p in zip(ways, place):
            run = runs[p // 16]
            way.append(("".join(run[:p % 16]), "".join(run[p % 16 + 1:])))
        place = [p // 16 for p in place]
        nodes = [digest(*run) for run in runs]
    return nodes[0], ways


def expected(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        held = sorted(sources[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[s] = held, *tree([leaf(r) for r in held])
    root, above = tree([built[s][1] for s in names])
    out = []
    for s, up in zip(names, above):
        held, subroot, ways = built[s]
        for row, way in zip(held, ways):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                changed = (row[0], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1]), *row[2:])
            folded = leaf(changed)
            for left, right in way + up:
                folded = digest(left, folded, right)
            out.append((row[0], leaf(row), subroot, root, digest(*[x + y for x, y in way + up]), folded, folded == root))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_runs_of_every_size_and_odd_rows(spark, odd_rows):
    rng = random.Random(11)
    rows, doc_id = [], 100
    for source, n in (("one", 1), ("two", 2), ("full", 16), ("more", 17), ("block", 256), ("over", 257), ("Ärger", 40), (None, 300)):
        for _ in range(n):
            doc_id += rng.randint(1, 3)
            text = rng.choice(["Abc", "abc", "", None, "ÄÖ zZ"]) if rng.random() < 0.9 else "Many Words " * rng.randint(1, 50)
            rows.append((doc_id, text, rng.choice(["en", None]), source, rng.choice([None, 5])))
    rows += [(i, t, "en", "odd", None if t is None else len(t)) for i, t in odd_rows]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "rank", "n", "at", "salt", "digest", "held", "path", "top", "block", "tree"):
        df = df.selectExpr("*", f"'x' AS {name}")
    got = [tuple(r) for r in merkle_manifest.manifest(df).collect()]
    want = expected(rows)
    same(got, want)
    assert {r[-1] for r in want} == {True, False}


def test_many_sources_and_several_tiers(spark):
    """300 sources need two tiers over the sources; 5,000 rows in one source need two below."""
    rows = [(i, f"Text {i}", "en", f"s{i % 299:03d}", 7) for i in range(600)]
    rows += [(10_000 + i, f"T{i % 50}", "de", "hot", 2) for i in range(5_000)]
    same([tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()], expected(rows))


def test_equal_rows_without_id_and_small_tables(spark):
    same([tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame([(3, "A", None, "s", 1)], SCHEMA)).collect()],
         expected([(3, "A", None, "s", 1)]))
    rows = [(None, None, None, None, None)] * 40 + [(8, "B", "en", "s", 1)] * 20
    same([tuple(r) for r in merkle_manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()], expected(rows))
    assert merkle_manifest.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
