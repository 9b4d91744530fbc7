"""Idempotent action ledger: rows from decisions, upsert on action_id, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEDGER_COLS = ["action_id", "session_id", "action_type", "intent", "confidence", "reason", "outcome",
               "acknowledged", "status", "created_at"]


def ledger_rows(decisions: DataFrame) -> DataFrame:
    """One ledger row per decision (NO_ACTION included, as the hot path records
    every dispatch). ``seq`` is the arrival order used by the upsert."""
    return decisions.select(
        "action_id", "session_id",
        F.col("action").alias("action_type"),
        "intent", "confidence", "reason",
        F.lit(None).cast("string").alias("outcome"),
        F.lit(False).alias("acknowledged"),
        F.col("timestamp").alias("created_at"),
        F.struct(F.col("timestamp"), F.col("event_id")).alias("seq"),
    )


def upsert(rows: DataFrame, mode: str = "pg") -> DataFrame:
    """Collapse rows with the same action_id in arrival order (``seq``).

    pg:     the first row's created_at, session, action, intent and confidence
            stay; status and payload (reason, outcome) take the last row's.
    sqlite: the last row replaces the whole record.
    Groups are one (session, action, minute) each, so they are small.
    """
    seq = F.col("seq")
    last = lambda c: F.max_by(c, seq).alias(c)
    first = lambda c: F.min_by(c, seq).alias(c)
    kept = ["session_id", "action_type", "intent", "confidence", "created_at"]
    updated = ["reason", "outcome", "acknowledged"]
    if mode == "pg":
        aggs = [first(c) for c in kept] + [last(c) for c in updated]
    elif mode == "sqlite":
        aggs = [last(c) for c in kept + updated]
    else:
        raise ValueError("mode must be 'pg' or 'sqlite'")
    g = rows.groupBy("action_id").agg(*aggs, F.max(seq).alias("seq"))
    return g.select(
        "action_id", "session_id", "action_type", "intent", "confidence", "reason", "outcome", "acknowledged",
        F.when(F.col("acknowledged"), F.lit("acknowledged")).otherwise(F.lit("dispatched")).alias("status"),
        "created_at", "seq",
    )


def payload_json(ledger: DataFrame) -> DataFrame:
    """Sink shape: payload as JSON text of {reason, outcome}."""
    return ledger.select(*[c for c in ledger.columns if c not in ("reason", "outcome", "seq")],
                         F.to_json(F.struct("reason", "outcome")).alias("payload"))


def action_history(ledger: DataFrame, session_id: str | None = None) -> DataFrame:
    """Ledger rows, newest first (optionally for one session)."""
    df = ledger if session_id is None else ledger.filter(F.col("session_id") == session_id)
    return df.orderBy(F.col("created_at").desc(), F.col("action_id").desc())


def recency_rank(ledger: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Every session's ledger rows with ``recency_rank`` (1 = newest).

    A running count in descending time order, computed by the chunked scan so a
    session with a huge history is not ranked in one task."""
    from shoptide.functions.running import running_scan, time_chunk

    df = ledger.withColumn("__chunk", -time_chunk("created_at", chunk_seconds))
    r = running_scan(df, by=["session_id"], chunk="__chunk",
                     order=[F.col("created_at").desc(), F.col("action_id").desc()],
                     aggs={"recency_rank": ("sum", F.lit(1))})
    return r.withColumn("recency_rank", F.col("recency_rank").cast("int")).drop("__chunk")


def acknowledgements(outcomes: DataFrame) -> DataFrame:
    """Rows that acknowledge decided actions with their outcome (converted / not_converted)."""
    return outcomes.where(F.col("converted").isNotNull()).select(
        "action_id", "session_id", "action_type", "intent", "confidence", "reason",
        F.when(F.col("converted"), F.lit("converted")).otherwise(F.lit("not_converted")).alias("outcome"),
        F.lit(True).alias("acknowledged"), "created_at",
        F.struct(F.col("as_of").alias("timestamp"), F.col("action_id").alias("event_id")).alias("seq"),
    )
