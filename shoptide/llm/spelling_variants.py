"""Operator 12, spelling variant grouping: words one letter apart, by a bit-sliced position index.

Words are counted in the tasks that read the texts; the vocabulary is what is
long and frequent enough. Two words that differ by one inserted, deleted or
replaced code point, the shorter of length L, agree in the first L // 2 or in the
last L - L // 2 code points, so each word lies under four keys (its own length
and the one before as L, either half), and words that share none are never
compared. Keys are hashed into blocks of about ``BLOCK`` words.

In a block, every (position, letter) has a bitset over the block's words, kept as
one integer. A word is held against all words of its key at once: for each of its
letters, the set of words without an error so far and the three sets with one
error (replaced; a letter more; a letter less, the last two read at the shifted
positions) are moved on by a few bitwise operations. What is left, masked by
length, is the exact set of near words, and only its size and its largest word
leave the task. A pair found under both halves counts under the first. A key with
more words than a block holds is dealt over several blocks, and its words are
held against each of them.

The last form of a chain is found by pointer doubling; a form has at least twice
the count of its word, so chains are shorter than the logarithm of the largest
count and cannot be circles.

Defined results: null and empty texts have no words; a null doc_id counts as an
empty string in the hash that alters words; repeated rows count again; texts of
any length are read whole (in slices that end between words); ties in count go to
the smallest word in code-point order; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, table, written

LEAST_LETTERS = 5
LEAST_COUNT = 3
ALTERED = 97
BLOCK = 1024
SLICE_CHARS = 1_000_000
HELD_WORDS = 200_000
RUNS = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")  # a shorter run has too few letters, altered or not
NO_LETTER = re.compile("[^a-zÀ-ÿ]")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def slices(text: str, size: int = SLICE_CHARS) -> Iterator[str]:
    """The text cut between runs, each slice about ``size`` long."""
    at = 0
    while at < len(text):
        if at + size >= len(text):
            end = len(text)
        else:
            gap = NO_LETTER.search(text, at + size)
            end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def count_words(held: Counter, doc_id: int | None, text: str) -> None:
    """Adds the words of one text, altered where the hash of document and run says so."""
    before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for part in slices(text.encode().translate(LOWER).decode()):
        runs = RUNS.findall(part)
        held.update(runs)
        for run in set(runs):
            h = zlib.crc32(run.encode(), before)
            if not h % ALTERED:
                n, k = runs.count(run), h % len(run)
                held[run] -= n
                held[run[:k] + run[k + 1:]] += n


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def batch() -> pa.RecordBatch:
        words = [w for w, n in held.items() if n and len(w) >= LEAST_LETTERS]
        return pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([held[w] for w in words], pa.int64())})

    for part in parts:
        for doc_id, text in zip(part.column("doc_id"), part.column("text")):
            if text.is_valid:
                count_words(held, doc_id.as_py(), text.as_py())
                if len(held) > HELD_WORDS:
                    yield batch()
                    held.clear()
    yield batch()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words with enough letters and occurrences."""
    rows = picked(docs, doc_id="long", text="string").mapInArrow(_counts, "word string, n long")
    return written(rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "vocabulary")


class PositionIndex:
    """Bitsets over some words: by (position, letter) and by length."""

    def __init__(self, words: list[str]):
        self.at: dict[tuple[int, str], int] = {}
        self.of_length: dict[int, int] = {}
        for k, word in enumerate(words):
            bit = 1 << k
            self.of_length[len(word)] = self.of_length.get(len(word), 0) | bit
            for place in enumerate(word):
                self.at[place] = self.at.get(place, 0) | bit

    def near(self, word: str, among: int, half: int) -> tuple[int, int, int]:
        """Words of the set ``among`` at exactly one error, and those that share the first ``half`` letters.

        The near ones come as two sets: as long as ``word`` or one letter longer, and one letter shorter.
        """
        at, none = self.at, among
        replaced = more = less = 0
        shared = among
        for i, letter in enumerate(word):
            here = at.get((i, letter), 0)
            less = less & at.get((i - 1, letter), 0) | none
            more = (more | none) & at.get((i + 1, letter), 0)
            exact = none & here
            replaced = replaced & here | none ^ exact
            none = exact
            if i + 1 == half:
                shared = none
        n, of_length = len(word), self.of_length
        same = replaced & of_length.get(n, 0)
        return same | (more | none) & of_length.get(n + 1, 0), less & of_length.get(n - 1, 0), shared


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _block_results(rows: list[dict]) -> Iterator[tuple[str, int, int, str]]:
    targets = [r for r in rows if r["target"]]
    index = PositionIndex([r["word"] for r in targets])
    of_key: dict[str, int] = {}
    for k, r in enumerate(targets):
        of_key[r["key"]] = of_key.get(r["key"], 0) | 1 << k
    for r in rows:
        word, size = r["word"], r["size"]
        longer, shorter, shared = index.near(word, of_key.get(r["key"], 0), size // 2)
        near = longer if size == len(word) else shorter
        if r["last"]:
            near &= ~shared  # found under the first half as well
        if near:
            found = list(_bits(near))
            best = min(found, key=lambda k: (-targets[k]["n"], targets[k]["word"]))
            yield word, len(found), targets[best]["n"], targets[best]["word"]


NEAR_COLUMNS = "word string, n_near long, near_n long, near string"


def _near_in_blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: one block at a time."""
    names = [c.split()[0] for c in NEAR_COLUMNS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
    block, rows = None, []

    def done() -> Iterator[pa.RecordBatch]:
        out = list(_block_results(rows))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    for part in parts:
        for r in part.to_pylist():
            if r["block"] != block:
                yield from done()
                block, rows = r["block"], []
            rows.append(r)
    yield from done()


def near_words(words: DataFrame, block_words: int = BLOCK) -> DataFrame:
    """(word, n_near, near_n, near) of each word of (word, n) that has near words; ``near`` is the one of largest n."""
    letters = F.char_length("word")
    entries = words.select("word", "n", F.explode(F.array(letters, letters - 1)).alias("size")).where(F.col("size") >= LEAST_LETTERS)
    entries = entries.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("last"))
    half = F.floor(F.col("size") / 2).cast("int")
    part = F.when(F.col("last"), F.substring("word", half - F.col("size"), F.col("size") - half)).otherwise(F.substring("word", F.lit(1), half))
    entries = written(entries.withColumn("key", F.concat_ws(":", "size", "last", part)), "spelling-keys")
    large = entries.groupBy("key").agg(F.ceil(F.count("*") / block_words).cast("int").alias("parts")).where("parts > 1")
    n_blocks = max(1, -(-entries.count() // block_words))
    dealt = entries.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    common = F.concat(F.lit("#"), F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("string"))
    dealt = dealt.select(
        "word", "n", "size", "last", "key", (F.col("part") == F.pmod(F.xxhash64("word"), F.col("parts"))).alias("target"),
        F.when(F.col("parts") == 1, common).otherwise(F.concat_ws("/", "key", "part")).alias("block"))
    found = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_near_in_blocks, NEAR_COLUMNS)
    best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.least")).alias("near_n"), "best.near")


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of each row of (word, form): the end of the chain of forms."""
    steps = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """One row per word of the vocabulary: word, form, root, n, n_near, form_n."""
    words = vocabulary(docs)
    near = words.join(near_words(words), "word", "left")
    strong = F.col("near_n") >= 2 * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n"))
    near = written(near, "near-words")
    out = near.join(last_forms(near.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts of ``documents`` with their near words, forms and roots."""
    return variants(table(spark, sf_dir, "documents"))


_WIDE = "".join(map(chr, range(0xC0, 0x100)))
_FREE = "".join(c for c in map(chr, range(33, 127)) if c not in "'\\" and not c.islower())[:len(_WIDE)]  # for edit distances in single bytes
ORACLE_SQL = {
    "op12_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
        counted AS (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
        bytes AS (SELECT *, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128
            THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM counted WHERE length(run) >= {LEAST_LETTERS}),
        hashed AS (SELECT *, xor(list_reduce(b, lambda a, c: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, c)),
            4294967295), 4294967295) AS h FROM bytes),
        altered AS (SELECT n, CASE WHEN h % {ALTERED} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_WIDE}', '{_FREE}') AS single FROM altered
            WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
        near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM words a JOIN words b
            ON b.word <> a.word AND abs(length(a.word) - length(b.word)) <= 1 AND levenshtein(a.single, b.single) = 1),
        best AS (SELECT word, n, count(*) OVER (PARTITION BY word) AS n_near, other, other_n FROM near
            QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
        forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form,
            CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best ON best.word = w.word),
        chain AS (SELECT word, word AS last, 0 AS step FROM forms
            UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word) r ON r.word = f.word
    """
}
