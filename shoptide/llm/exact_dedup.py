"""Operator 10, exact dedup: a persistent digest index, bucketed and sorted by hash.

The index is a table of one row per text ever kept: its SHA-256 digest and the
row that stays. It is bucketed and sorted by digest, so a batch of new data is
deduplicated by a sort-merge anti-join that shuffles only the batch's own
distinct digests (pre-aggregated in the map tasks; a text that a third of all
rows repeat is one row per task there), and the survivors are appended with
the same bucketing. Texts never travel: only digests and ids are shuffled.

Defined results: a null text counts as empty; the row with the largest doc_id
of a batch stays (a null doc_id is smaller than any other); among repeated rows
with the same doc_id and text exactly one stays; a text that the index already
holds stays with the index's row; an empty table gives an empty result and adds
nothing to the index. Extra columns are ignored by
:func:`deduplicate` and kept by :func:`kept_rows`.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, picked, table, written

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING"


class DigestIndex:
    """One row per distinct text: ``digest`` (32 bytes), ``keep_id``, ``keep_row`` and the batch that brought it.

    Beside the data, in ``<path>-layout``, lie the number of buckets and the name
    of the live folder, so an index is always opened as it was made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, name: str | None = None):
        """Opens the index at ``path``, or makes an empty one with ``buckets`` (else: shuffle partitions).

        An index that exists keeps its number of buckets; to ask for another one is an error.
        """
        self.spark, self.path = spark, path or new_folder(spark, "digest-index")
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        held = None if path is None else self._layout()
        if held is None:
            self.buckets, self.version = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), 0
            self._set_layout()
        else:
            self.buckets, self.version = held
            if buckets not in (None, self.buckets):
                raise ValueError(f"the index at {self.path} has {self.buckets} buckets, not {buckets}")
        self._open()

    def _layout(self) -> tuple[int, int] | None:
        try:
            found = self.spark.read.schema("buckets int, version int").json(f"{self.path}-layout").first()
        except AnalysisException:  # a new index
            return None
        return None if found is None else (found["buckets"], found["version"])

    def _set_layout(self) -> None:
        row = self.spark.createDataFrame([(self.buckets, self.version)], "buckets int, version int")
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}-layout")

    def _open(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/version={self.version}'"
        )

    def close(self) -> None:
        """Takes the table's name out of the catalog; the index's files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, rows: DataFrame, name: str, version: int) -> None:
        (
            rows.select("digest", "keep_id", "keep_row", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", f"{self.path}/version={version}").saveAsTable(name)
        )

    def ingest(self, digests: DataFrame, batch: str) -> None:
        """Appends the texts of ``digests`` (digest, doc_id, row) that the index lacks.

        A batch that already reached the index adds nothing when it is given again.
        """
        # Written, as Spark would else put the anti-join below the aggregation and shuffle every copy of a text.
        new = written(digests.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("keep")), "batch")
        fresh = new.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        self._append(fresh.select("digest", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"), F.lit(batch).alias("batch")), self.name, self.version)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> None:
        """Writes the index anew with one sorted file per bucket, and then makes that the live folder.

        Each ingest adds a file per bucket. Of a compacted index Spark can use the
        files' order and sort only the new data's side
        (``spark.sql.legacy.bucketedTableScan.outputOrdering``).
        """
        other = f"{self.name}_{self.version + 1}"
        self._append(written(self.rows(), "index-rows"), other, self.version + 1)  # read as plain files, which are dealt anew
        self.spark.sql(f"DROP TABLE {other}")
        self.close()
        self.version += 1
        self._set_layout()
        self._open()
        self.spark.catalog.refreshTable(self.name)


def digests_of(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, row): written once, so the row numbers stay what they are."""
    rows = picked(docs, doc_id="long", text="string").select(
        F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), "doc_id")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def batches(digests: DataFrame) -> list[DataFrame]:
    """Two increments, the upper half of the id range first, so that the largest doc_id of a text comes first."""
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [digests]
    upper = F.coalesce(F.col("doc_id") > low + (high - low) // 2, F.lit(False))
    return [digests.where(upper), digests.where(~upper)]


def deduplicate(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``group_size`` counts the rows of this call with the same text.
    """
    digests = digests_of(docs)
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    call = uuid.uuid4().hex[:12]
    for k, batch in enumerate(batches(digests)):
        index.ingest(batch, f"{call}-{k}")
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    # Written so that the join below reads plain files on this side: Spark may then split a hot digest's rows among tasks.
    held = index.rows().withColumn("mine", F.col("batch").startswith(call)).drop("batch")
    groups = written(sizes.join(held.hint("merge"), "digest"), "groups")
    if own:
        index.close()
    return digests.join(groups.hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size",
        (F.col("mine") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    stays = deduplicate(docs, index).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_digest"))
    row = F.col("row")  # the original row as one struct, whatever its columns are named
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", row["doc_id"].cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(row["text"].cast("string"), F.lit("")).cast("binary"), 256)).alias("digest"))
    found = rows.join(stays, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    # Repeated rows with one doc_id and text pass the semi-join together; one of them stays.
    return found.dropDuplicates(["id", "digest"]).select("row.*")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of ``documents`` through a fresh digest index fed in two batches; one row per document."""
    return deduplicate(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op10_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
    """
}
