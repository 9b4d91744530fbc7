"""Operator 1, packing: optimal length buckets.

Sequences are measured in token ids, an end id included, as operator 8 writes
them (only counted here). They are put in length buckets and padded to the bucket's end; inside a
bucket they form batches of a fixed token budget. The bucket ends come from a
dynamic programme over the global histogram of lengths, which finds the ends
with the least padding in total (exactly: the cost fulfils the quadrangle
inequality, so each layer takes O(D log D) for D distinct lengths). The driver
sees the histogram only, one row per distinct length.

Places are dealt without a global sort: a bucket's rows are cut in ``CELLS``
cells by hash and numbered inside a cell; the cells' counts (buckets times
CELLS rows, a fixed bound, broadcast) give each cell its first place. Equal rows
are counted before they are shuffled and drawn apart again at the end.

Defined results: a null or empty text is a sequence of its end id only; the
largest bucket end is the longest sequence, and a sequence above the budget
is a batch of its own, never cut; repeated rows get places of their own; rows of
equal hash are ordered by doc_id and length; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, table, written
from .textbatch import TextBatch, as_large, chunks
from .token_records import ENCODED_BYTES, default_tokenizer, encoder_of

BUCKETS = 8
BUDGET = 32_768
CELLS = 1024
COPIES = 4096
SEED = 5


def bucket_ends(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """The ends of at most ``buckets`` buckets with the least padding, and that padding.

    ``lengths`` are distinct and ascending. Of equal solutions, each last bucket begins as early as it can.
    """
    d = len(lengths)
    if not d:
        return [], 0
    n = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    s = np.concatenate(([0], np.cumsum(counts * lengths, dtype=np.int64)))
    top = np.concatenate(([0], lengths)).astype(np.int64)
    best = top * n - s  # one bucket for the first j lengths
    chosen = [np.zeros(d + 1, np.int64)]
    for _ in range(1, min(buckets, d)):
        new, cut = best.copy(), chosen[-1] * 0
        todo = [(1, d, 0, d - 1)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            cost = best[i] + top[j] * (n[j] - n[i]) - (s[j] - s[i])
            k = int(np.argmin(cost))
            new[j], cut[j] = cost[k], i[k]
            todo += [(a, j - 1, low, int(i[k])), (j + 1, b, int(i[k]), high)]
        best = new
        chosen.append(cut)
    ends, j = [], d
    for cut in reversed(chosen):
        if j <= 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return ends[::-1], int(best[d])


def _counts(tokenizer: str | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = as_large(part.column("text"))
            for lo, hi in chunks(texts, ENCODED_BYTES):
                batch = TextBatch(texts, lo, hi)
                n = (encoder_of(tokenizer).counts(batch) if tokenizer else batch.n_words) + 1
                yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(lo, hi - lo), part.column("text_key").slice(lo, hi - lo), pa.array(n)], ["doc_id", "text_key", "n_tokens"])

    return run


def sequence_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, text_key, n_tokens): the token ids of each text (without a tokenizer, its words) and an end id."""
    rows = picked(docs, doc_id="long", text="string").withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(_counts(tokenizer), "doc_id long, text_key long, n_tokens long")


def packed(lengths: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, seed: int = SEED) -> DataFrame:
    """One row per sequence: doc_id, n_tokens, bucket, bucket_tokens (padded length), batch (in its bucket), slot."""
    lengths = written(lengths, "lengths")
    histogram = lengths.groupBy("n_tokens").count().toArrow().sort_by("n_tokens")
    ends, _ = bucket_ends(histogram.column("n_tokens").to_numpy(), histogram.column("count").to_numpy(), buckets)
    bounds = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array().cast("array<long>")

    order = F.xxhash64("doc_id", "text_key", F.lit(seed))
    rows = lengths.withColumn("order", order).groupBy("order", "doc_id", "n_tokens").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("n_tokens")))).withColumn("cell", F.pmod("order", F.lit(CELLS)).cast("int"))
    cell = Window.partitionBy("bucket", "cell").orderBy("order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = written(rows.withColumn("before", F.coalesce(F.sum("copies").over(cell), F.lit(0))), "places")

    cells = rows.groupBy("bucket", "cell").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    rows = rows.join(F.broadcast(cells), ["bucket", "cell"])
    # Equal rows are dealt in blocks, so that no array grows with their number.
    rows = rows.withColumn("first_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    last_copy = F.least(F.col("first_copy") + COPIES, F.col("copies")) - 1
    rows = rows.withColumn("copy", F.explode(F.sequence(F.col("first_copy"), last_copy)))
    rows = rows.withColumn("place", F.col("first") + F.col("before") + F.col("copy")).withColumn("bucket_tokens", F.element_at(bounds, F.col("bucket") + 1))
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens",
        F.floor(F.col("place") / capacity).cast("long").alias("batch"), (F.col("place") % capacity).cast("long").alias("slot"))


def op1_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each of ``documents``, measured in token ids and an end id."""
    return packed(sequence_lengths(table(spark, sf_dir, "documents"), default_tokenizer()))


#: A dynamic programme is beyond SQL; the tests hold the ends against all possible ends, and the batches against a plain rebuild.
ORACLE_SQL: dict[str, str] = {}
