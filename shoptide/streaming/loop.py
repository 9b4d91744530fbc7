"""The decision loop over a feed, with everything a micro-batch changes in one commit.

A batch of raw records is parsed and split: what fails validation goes to
``quarantine`` with the topic, partition and offset it came from; rows older than
the watermark (the newest event time of earlier batches less the retention) go
to ``late``; the rest get their default ids and replace the events with the same
id in the date-partitioned ``events`` (a redelivery wins over what it repeats).
The sessions that the batch touches are then decided again over their whole
history with the batch operators, so a late event or a redelivery repairs the
tail of its session: new rows and changed rows replace the old ones in
``decisions``, changed ones are listed in ``corrections``, and the ``ledger``
follows. ``counts`` says what became of every record that was read.

All of it becomes visible with the batch's commit record (see
:mod:`shoptide.streaming.tables`): a failure in mid-batch leaves nothing behind,
a replayed batch changes nothing.

Reads are bounded by dates: ``sessions`` keeps the first event time of every
session seen within the retention, and events, decisions and ledger rows are read
from the earliest of those dates on. A redelivery replaces an event of any age
within the retention.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shoptide.operators.ledger import ledger_rows, upsert
from shoptide.operators.stores import event_dedup
from shoptide.plans.pipeline import event_decisions
from shoptide.schema import COOLDOWN_MINUTES, SESSION_TTL_HOURS
from shoptide.session import materialize
from shoptide.sources.events import ORIGIN, parse_json_values, quarantine, valid_events, with_event_defaults
from shoptide.streaming.tables import BatchTables, Table

_EVENT = ("event_id string, session_id string, customer_id string, timestamp timestamp_ntz, action string, product_id string, "
          "category string, value double, metadata string")
_ORIGIN = "topic string, partition int, offset long"
TABLES = {
    "events": Table(f"{_EVENT}, arrived_batch long, arrived_seq long, event_date date", ["event_date"]),
    "quarantine": Table(f"raw string, quarantine_reason string, {_ORIGIN}, batch_id long"),
    "late": Table(f"{_EVENT}, {_ORIGIN}, batch_id long, watermark timestamp_ntz"),
    "sessions": Table("session_id string, first_ts timestamp_ntz, last_ts timestamp_ntz, seen_date date", ["seen_date"]),
    "decisions": Table("session_id string, event_id string, timestamp timestamp_ntz, intent string, confidence double, proposed_action string, "
                       "allowed boolean, action string, reason string, dispatched boolean, action_id string, event_date date", ["event_date"]),
    "corrections": Table("session_id string, event_id string, old_action string, old_reason string, action string, reason string, batch_id long"),
    "ledger": Table("action_id string, session_id string, action_type string, intent string, confidence double, reason string, outcome string, "
                    "acknowledged boolean, status string, created_at timestamp_ntz, seq struct<timestamp: timestamp_ntz, event_id: string>, "
                    "ledger_date date", ["ledger_date"]),
    "counts": Table("kind string, n long, batch_id long"),
}
CHANGING = ["intent", "confidence", "proposed_action", "allowed", "action", "reason", "dispatched", "timestamp", "session_id"]


def loop_tables(spark: SparkSession, path: str) -> BatchTables:
    return BatchTables(spark, path, TABLES)


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _still_acknowledged(live: DataFrame, rows: DataFrame) -> DataFrame:
    """The new rows; what was acknowledged stays so."""
    known = live.where("acknowledged").select("action_id", F.col("outcome").alias("__outcome"), F.col("reason").alias("__reason"))
    new = rows.join(known, "action_id", "left")
    seen = F.col("__outcome").isNotNull()
    return (new.withColumn("outcome", F.coalesce("__outcome", "outcome")).withColumn("acknowledged", seen | F.col("acknowledged"))
            .withColumn("reason", F.when(seen, F.col("__reason")).otherwise(F.col("reason")))
            .withColumn("status", F.when(F.col("acknowledged"), F.lit("acknowledged")).otherwise(F.lit("dispatched"))))


def run_batch(tables: BatchTables, records: DataFrame, batch_id: int, retention_hours: int = SESSION_TTL_HOURS,
              cooldown_minutes: int = COOLDOWN_MINUTES, ingest_ts: Column | None = None, after: Callable[[str], None] = lambda step: None) -> bool:
    """One micro-batch of raw records (value, topic, partition, offset); False if it was committed before.

    ``after`` is called with the name of each finished step (tests raise there).
    """
    batch = tables.begin(batch_id)
    if batch is None:
        return False
    parsed = parse_json_values(records, keep=ORIGIN).withColumn("arrived_seq", F.coalesce("offset", F.monotonically_increasing_id()))
    parsed = materialize(parsed, "parsed")
    bad = quarantine(parsed).withColumn("batch_id", F.lit(batch_id).cast("long"))
    batch.append("quarantine", bad)
    after("quarantine")

    valid = with_event_defaults(valid_events(parsed), ingest_ts).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    valid = valid.withColumn("arrived_batch", F.lit(batch_id).cast("long")).withColumn("event_date", F.to_date("timestamp"))
    valid = materialize(valid, "valid")
    newest_us = batch.notes.get("newest_us")
    mark = None if newest_us is None else newest_us - retention_hours * 3600 * 1_000_000
    is_late = F.lit(False) if mark is None else _us("timestamp") < mark
    late = valid.where(is_late).withColumn("batch_id", F.lit(batch_id).cast("long"))
    batch.append("late", late.withColumn("watermark", F.timestamp_micros(F.lit(mark or 0)).cast("timestamp_ntz")))
    after("late")

    arrivals = valid.where(~is_late).select(*TABLES["events"].struct().names, F.struct("topic", "partition", "arrived_seq", "raw").alias("__order"))
    fresh = materialize(event_dedup(arrivals, seq="__order").drop("__order"), "fresh")
    state = fresh.agg(F.count("*").alias("n"), F.max(_us("timestamp")).alias("newest"), F.min("event_date").alias("first")).first()
    kinds = {"read": parsed, "quarantined": bad, "late": late, "accepted": arrivals, "distinct": fresh}
    counts = None
    for kind, rows in kinds.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n", F.lit(batch_id).cast("long").alias("batch_id"))
        counts = one if counts is None else counts.unionByName(one)
    batch.append("counts", counts)
    if state["n"]:
        _decide(batch, fresh, state["first"], retention_hours, cooldown_minutes, after)
        batch.notes["newest_us"] = max(state["newest"], newest_us or state["newest"])
    batch.commit()
    return True


def _decide(batch, fresh: DataFrame, first_date, retention_hours: int, cooldown_minutes: int, after) -> None:
    back = F.date_sub(F.lit(first_date), 1 + retention_hours // 24)
    replaced = batch.read("events").where(F.col("event_date") >= back).join(fresh.select("event_id"), "event_id", "left_semi")
    touched = materialize(fresh.select("session_id").union(replaced.select("session_id")).distinct(), "touched")
    batch.merge("events", fresh, "event_id", since=F.col("event_date") >= back, written=True)
    after("events")

    seen = batch.read("sessions").where(F.col("seen_date") >= back).join(touched, "session_id", "left_semi")
    spans = fresh.select("session_id", F.col("timestamp").alias("first_ts"), F.col("timestamp").alias("last_ts"))
    spans = spans.unionByName(seen.select("session_id", "first_ts", "last_ts"))
    spans = spans.groupBy("session_id").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    spans = materialize(spans.withColumn("seen_date", F.to_date("last_ts")), "spans")
    batch.append("sessions", spans)
    after("sessions")

    start = F.lit(spans.agg(F.to_date(F.min("first_ts"))).first()[0])
    history = batch.read("events").where(F.col("event_date") >= start).join(touched, "session_id", "left_semi")
    history = materialize(history.drop("event_date", "arrived_batch", "arrived_seq"), "history")  # a scan reads it more than once
    decided = event_decisions(history, cooldown_minutes=cooldown_minutes)
    names = TABLES["decisions"].struct().names
    decided = materialize(decided.withColumn("event_date", F.to_date("timestamp")).select(*names), "decided")
    held = batch.read("decisions").where(F.col("event_date") >= start)
    before = held.select("event_id", F.struct(*CHANGING).alias("__old"))
    changed = decided.join(before, "event_id").where(~F.struct(*CHANGING).eqNullSafe(F.col("__old")))
    batch.append("corrections", changed.select(
        "session_id", "event_id", F.col("__old.action").alias("old_action"), F.col("__old.reason").alias("old_reason"), "action", "reason",
        F.lit(batch.id).cast("long").alias("batch_id")))
    after("corrections")

    # The keys are the touched sessions: one whose events have all moved elsewhere loses its rows.
    batch.merge("decisions", decided, "session_id", since=F.col("event_date") >= start, keys=touched, written=True)
    after("decisions")
    rows = upsert(ledger_rows(decided)).withColumn("ledger_date", F.to_date("created_at"))
    batch.merge("ledger", rows, "session_id", _still_acknowledged, since=F.col("ledger_date") >= start, keys=touched)
    after("ledger")


def start_loop(tables: BatchTables, feed: DataFrame, checkpoint: str, available_now: bool = True, **options) -> StreamingQuery:
    """Runs :func:`run_batch` on every micro-batch of a feed (see :func:`shoptide.sources.events.open_feed`)."""

    def step(records: DataFrame, batch_id: int) -> None:
        run_batch(tables, records, batch_id, **options)

    w = feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")).start()
