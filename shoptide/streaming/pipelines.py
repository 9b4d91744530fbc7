"""Structured Streaming jobs: ingest with quarantine, the per-event decision
loop, and event-time sessionization.

Sinks are ``foreachBatch`` writes to ``<dir>/batch=<id>`` with overwrite, so a
replayed micro-batch (after a failure, the checkpoint replays the last
uncommitted batch) rewrites the same folder: the sinks are idempotent.
Checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoptide.session import materialize
from shoptide.sources.events import parse_json_values, quarantine, valid_events, with_event_defaults
from shoptide.streaming.tables import BatchTables, Table


def ingest_stream(spark: SparkSession, feed_dir: str, store_dir: str, quarantine_dir: str,
                  checkpoint: str, max_files: int | None = None, available_now: bool = True,
                  registry_dir: str | None = None) -> StreamingQuery:
    """Raw JSON lines -> typed events; valid rows to the event store (partitioned
    by ingest batch and event date), the rest (malformed, mistyped, missing
    fields) to quarantine. The stream never stops on bad input. With
    ``registry_dir`` it also writes each session's first event time seen in the
    batch (a small table: one row per session and batch)."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    parsed = parse_json_values(reader.load(feed_dir), "value")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            valid = valid_events(batch).drop("raw").withColumn(
                "event_date", F.to_date(F.col("timestamp").cast("timestamp")))
            valid.write.mode("overwrite").partitionBy("event_date").parquet(f"{store_dir}/batch={batch_id}")
            quarantine(batch).write.mode("overwrite").parquet(f"{quarantine_dir}/batch={batch_id}")
            if registry_dir:
                valid.groupBy("session_id").agg(F.min("timestamp").alias("first_ts")).write.mode(
                    "overwrite").parquet(f"{registry_dir}/batch={batch_id}")
        finally:
            batch.unpersist()

    w = parsed.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def decision_stream(spark: SparkSession, store_dir: str, decisions_dir: str, checkpoint: str,
                    cooldown_minutes: int = 15, available_now: bool = True,
                    registry_dir: str | None = None) -> StreamingQuery:
    """Per-event decisions as events reach the event store.

    For each micro-batch, the sessions it touches are re-read from the store:
    partitions up to the newest store batch seen, and (with ``registry_dir``)
    only event dates from the earliest start among the touched sessions, so the
    read covers the live sessions' time range, not the whole store. The batch
    decision operators run over that history and only the new events'
    decisions are written. The result equals the batch job on the same events
    in arrival order, and the state is the store itself, so a restart needs no
    operator state beyond the source checkpoint.
    """
    from shoptide.plans.pipeline import event_decisions

    schema = spark.read.parquet(store_dir).schema
    src = spark.readStream.schema(schema).parquet(store_dir)

    def step(batch: DataFrame, batch_id: int) -> None:
        top = batch.agg(F.max("batch")).first()[0]
        if top is None:
            return
        touched = batch.select("session_id").distinct()
        store = spark.read.parquet(store_dir).where(F.col("batch") <= F.lit(top))
        if registry_dir:
            start = (spark.read.parquet(registry_dir).join(touched, "session_id", "left_semi")
                     .agg(F.min("first_ts")).first()[0])
            if start is not None:
                store = store.where(F.col("event_date") >= F.to_date(F.lit(start).cast("timestamp")))
        history = store.join(touched, "session_id", "left_semi").drop("batch", "event_date")
        dec = event_decisions(history, cooldown_minutes=cooldown_minutes)
        out = dec.join(batch.select("session_id", "event_id"), ["session_id", "event_id"], "left_semi")
        out = out.drop("event_date")
        out.write.mode("overwrite").parquet(f"{decisions_dir}/batch={batch_id}")

    w = src.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def session_window_stream(events: DataFrame, gap_minutes: int = 360, watermark: str = "24 hours",
                          key: str = "customer_id") -> DataFrame:
    """Event-time sessions per key with Spark's ``session_window`` (a gap equal
    to the limit stays in the session). Late events are accepted until the
    watermark (default 24 h, the event retention) passes."""
    ev = events.withColumn("__ts", F.col("timestamp").cast("timestamp")).withWatermark("__ts", watermark)
    g = ev.groupBy(F.session_window("__ts", f"{gap_minutes} minutes").alias("w"), key).agg(
        F.count(F.lit(1)).alias("n_events"))
    return g.select(key, F.col("w.start").alias("session_start"),
                    (F.col("w.end") - F.expr(f"INTERVAL {gap_minutes} MINUTES")).alias("session_end"), "n_events")


def sliding_activity_stream(events: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """Per-action counts over 5-minute windows sliding by 1 minute."""
    ev = events.withColumn("__ts", F.col("timestamp").cast("timestamp")).withWatermark("__ts", watermark)
    return ev.groupBy(F.window("__ts", "5 minutes", "1 minute").alias("w"), "action").agg(F.count(F.lit(1)).alias("n"))


def sessionize_stream(spark: SparkSession, store_dir: str, out_dir: str, checkpoint: str,
                      gap_minutes: int = 360) -> StreamingQuery:
    """Run :func:`session_window_stream` over the event store in append mode:
    a session is written once, when the watermark passes its end (last event +
    gap); sessions still open stay in the state store."""
    schema = spark.read.parquet(store_dir).schema
    src = spark.readStream.schema(schema).parquet(store_dir)
    sessions = session_window_stream(src, gap_minutes)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return (sessions.writeStream.outputMode("append").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_sessions(spark: SparkSession, out_dir: str, key: str = "customer_id") -> DataFrame:
    """Newest version of every (key, session_start) written by :func:`sessionize_stream`."""
    df = spark.read.parquet(out_dir)
    g = df.groupBy(key, "session_start").agg(F.max_by(F.struct("session_end", "n_events"), F.col("version")).alias("r"))
    return g.select(key, F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                    F.col("r.session_end").cast("timestamp_ntz").alias("session_end"), F.col("r.n_events").alias("n_events"))


STATEFUL_TABLES = {
    "decisions": Table("session_id string, event_id string, timestamp timestamp_ntz, intent string, confidence double, proposed_action string, allowed boolean, "
                       "dispatched boolean, action string, reason string, action_id string, event_date date", ["event_date"]),
    "corrections": Table("session_id string, event_id string, action string, reason string, batch_id long"),
    "ends": Table("kind string, session_id string, event_id string, timestamp timestamp_ntz, n_events long, batch_id long"),
}


def stateful_tables(spark: SparkSession, path: str) -> BatchTables:
    return BatchTables(spark, path, STATEFUL_TABLES)


def feed_events(feed: DataFrame) -> DataFrame:
    """Valid events with their defaults from a stream of raw records (see :func:`shoptide.sources.events.open_feed`)."""
    parsed = parse_json_values(feed, keep=["offset"])
    return with_event_defaults(valid_events(parsed)).withColumnRenamed("offset", "arrived")


def stateful_decision_stream(spark: SparkSession, source: str | DataFrame, decisions_dir: str, checkpoint: str,
                             cooldown_minutes: int = 15, available_now: bool = True, controls: DataFrame | None = None) -> StreamingQuery:
    """The per-event decision loop with operator state (see :mod:`shoptide.streaming.stateful`).

    ``source`` is a folder of an event store or a stream of events. Each batch's
    decisions and corrections replace the earlier ones of their events, with one
    commit record, so a replayed batch changes nothing."""
    from shoptide.streaming.stateful import stateful_decisions

    if isinstance(source, str):
        source = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    dec = stateful_decisions(source, cooldown_minutes=cooldown_minutes, controls=controls)
    tables = stateful_tables(spark, decisions_dir)
    key = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, None):  # state off the JVM heap
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    changes = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"
    if spark.conf.get(changes, "false") != "true":  # a commit writes what the batch changed, not the store's files
        spark.conf.set(changes, "true")

    def sink(rows: DataFrame, batch_id: int) -> None:
        batch = tables.begin(batch_id)
        if batch is None:
            return
        rows = materialize(rows.withColumn("batch_id", F.lit(batch_id).cast("long")).withColumn("event_date", F.to_date("timestamp")), "decided")
        if rows.isEmpty():  # a batch that only moved the watermark
            return
        decided = rows.where(F.col("kind").isin("decision", "correction"))
        batch.merge("decisions", decided, "event_id")
        batch.append("corrections", rows.where("kind = 'correction'"))
        batch.append("ends", rows.where(~F.col("kind").isin("decision", "correction")))
        batch.commit()

    w = dec.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, over the progress that the query still holds."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
