"""Tables that micro-batches change together: parquet partitions and one commit record per batch.

Each batch writes the partitions it changes to folders of its own
(``data/<table>/batch=<id>/...``) and then one commit record: for every table,
the live folder of each partition. Readers follow the newest record, so the
outputs of a batch appear together or not at all. A batch that failed half way
left folders that no record names; its replay overwrites them. A batch whose
record exists is skipped when it is replayed.

``append`` adds rows. ``merge`` replaces whole partitions: those that the new
rows fall into, and those that hold live rows with one of their keys.

The driver holds one path per live folder, like any table's list of partitions;
rows stay on the executors. One writer per folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptide.session import materialize

RECORD = "name string, part string, folder string"
NOTHING = -1


@dataclass(frozen=True)
class Table:
    schema: str
    parts: list[str] = field(default_factory=list)

    def struct(self) -> T.StructType:
        return T._parse_datatype_string(self.schema)  # type: ignore[return-value]


def _part_of(parts: list[str]) -> Column:
    """The partition's folder name below a batch, as Spark's writer names it (dates and integers need no escapes)."""
    none = F.lit("__HIVE_DEFAULT_PARTITION__")
    return F.concat_ws("/", *[F.concat(F.lit(f"{p}="), F.coalesce(F.col(p).cast("string"), none)) for p in parts])


class BatchTables:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables

    def _records(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(RECORD).json(f"{self.path}/commits")
        except AnalysisException:  # no batch yet
            return None

    def newest(self) -> int:
        """Id of the last committed batch (-1: none)."""
        records = self._records()
        found = records.agg(F.max("batch")).first()[0] if records is not None else None
        return NOTHING if found is None else int(found)

    def live(self) -> tuple[dict[tuple[str, str], str], dict]:
        """((table, partition) -> folder, notes) of the newest commit."""
        batch = self.newest()
        if batch == NOTHING:
            return {}, {}
        rows = self._records().where(F.col("batch") == batch).collect()
        notes = next((json.loads(r["folder"]) for r in rows if r["name"] == ""), {})
        return {(r["name"], r["part"]): r["folder"] for r in rows if r["name"]}, notes

    def read(self, name: str) -> DataFrame:
        return self._rows(name, self.live()[0])

    def _rows(self, name: str, live: dict[tuple[str, str], str], only: set[str] | None = None) -> DataFrame:
        schema = self.tables[name].struct()
        folders = sorted({folder for (table, part), folder in live.items() if table == name and (only is None or part in only)})
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data/{name}").parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.select(*schema.names)

    def begin(self, batch_id: int) -> "Batch | None":
        """The next batch, or None if this one is committed already."""
        return None if batch_id <= self.newest() else Batch(self, batch_id)


class Batch:
    def __init__(self, tables: BatchTables, batch_id: int):
        self.tables, self.id = tables, batch_id
        self.live, self.notes = tables.live()

    def read(self, name: str, only: set[str] | None = None) -> DataFrame:
        """The table as this batch has left it so far."""
        return self.tables._rows(name, self.live, only)

    def _write(self, name: str, rows: DataFrame) -> tuple[str, set[str]]:
        table = self.tables.tables[name]
        folder = f"data/{name}/batch={self.id}"
        rows = rows.select(*table.struct().names)
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*table.parts) if table.parts else writer).parquet(f"{self.tables.path}/{folder}")
        if not table.parts:
            return folder, {""}
        written = self.tables.spark.read.schema(table.struct()).parquet(f"{self.tables.path}/{folder}")
        return folder, {r[0] for r in written.select(_part_of(table.parts)).distinct().collect()}

    def append(self, name: str, rows: DataFrame) -> None:
        folder, parts = self._write(name, rows)
        for part in parts:
            self.live[name, f"{part}@{self.id}"] = f"{folder}/{part}".rstrip("/")

    def merge(self, name: str, rows: DataFrame, key: str, resolve: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
              since: Column | None = None, keys: DataFrame | None = None, written: bool = False) -> None:
        """Replaces the touched partitions with their live rows without the keys of ``rows``, and ``rows``.

        ``keys`` (a column ``key``) names more keys whose live rows go, ``since``
        bounds, by partition columns, where live rows with such keys may lie.
        ``resolve(live rows, rows)`` gives the rows that are put in, where they
        depend on what was there. ``written``: ``rows`` read a table that the
        caller has written, so they need no copy.
        """
        table = self.tables.tables[name]
        names = table.struct().names
        rows = rows.select(*names) if written else materialize(rows.select(*names), f"{name}-rows")
        keys = (rows.select(key) if keys is None else keys.select(key).union(rows.select(key))).distinct()
        held = self.read(name) if since is None else self.read(name).where(since)
        held = held.join(keys, key, "left_semi").select(*table.parts)
        touched = {r[0] for r in rows.select(*table.parts).union(held).distinct().select(_part_of(table.parts)).collect()}
        if not touched:
            return
        live = self.read(name, touched)
        new = rows if resolve is None else resolve(live, rows)
        folder, parts = self._write(name, live.join(keys, key, "left_anti").select(*names).unionByName(new.select(*names)))
        for part in touched:
            self.live.pop((name, part), None)
        for part in parts:
            self.live[name, part] = f"{folder}/{part}"

    def commit(self) -> None:
        rows = [(name, part, folder) for (name, part), folder in sorted(self.live.items())]
        rows.append(("", "", json.dumps(self.notes)))
        record = self.tables.spark.createDataFrame(rows, RECORD).coalesce(1)
        record.write.mode("overwrite").json(f"{self.tables.path}/commits/batch={self.id}")
