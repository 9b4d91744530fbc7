"""Closing the loop: conversion attribution, batch metrics, drift, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.functions.running import running_scan, time_chunk
from shoptide.schema import (
    COLD_START_MIN_ACTIONS, COLD_START_RATE, CONVERSION_ACTIONS, CONVERSION_WINDOW_MINUTES,
    DRIFT_HISTORY, DRIFT_THRESHOLD, EVALUATION_BATCH, OBSERVATION_GRACE_MINUTES,
)

US_PER_MIN = 60 * 1_000_000


def _us(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp"))


def conversion(
    actions: DataFrame,
    clicks: DataFrame,
    as_of: Column | None = None,
    window_minutes: int = CONVERSION_WINDOW_MINUTES,
    grace_minutes: int = OBSERVATION_GRACE_MINUTES,
    chunk_seconds: int = 3600,
) -> DataFrame:
    """``converted``: some checkout_start/purchase_complete of the same session at
    a time in [created_at, created_at + window] (both ends inclusive); null when
    the observation window has not elapsed (as_of - created_at <= window + grace).

    An as-of lookup, not a range join: actions and conversion events of a session
    are merged in descending time and a running minimum gives each action the
    first conversion at or after it. Linear in rows, and the chunked scan spreads
    a hot session over many tasks. ``as_of`` defaults to a per-row column
    ``as_of`` if present, else the latest event time in ``clicks``.
    """
    conv = clicks.where(F.col("action").isin(*CONVERSION_ACTIONS)).select(
        "session_id", F.col("timestamp").alias("__t"), F.lit(0).alias("__kind"),
        F.lit(None).cast("string").alias("action_id"))
    acts = actions.select("session_id", F.col("created_at").alias("__t"), F.lit(1).alias("__kind"), "action_id")
    u = conv.unionByName(acts).withColumn("__chunk", -time_chunk("__t", chunk_seconds))
    nxt = F.when(F.col("__kind") == 0, _us("__t"))
    scanned = running_scan(u, by=["session_id"], chunk="__chunk",
                           order=[F.col("__t").desc(), F.col("__kind")],
                           aggs={"__next_conv": ("min", nxt)})
    found = scanned.where(F.col("__kind") == 1).select("action_id", "__next_conv")
    out = actions.join(found, on="action_id", how="left")
    if as_of is None:
        if "as_of" in actions.columns:
            as_of = F.col("as_of")
        else:
            as_of = clicks.agg(F.max("timestamp")).scalar()  # scalar subquery: the latest event time
    t = _us("created_at")
    undecided = (_us(as_of) - t) <= F.lit((window_minutes + grace_minutes) * US_PER_MIN)
    hit = F.coalesce(F.col("__next_conv") <= t + F.lit(window_minutes * US_PER_MIN), F.lit(False))
    return out.select(*[c for c in out.columns if not c.startswith("__")],
                      F.when(undecided, F.lit(None).cast("boolean")).otherwise(hit).alias("converted"))


def recent_actions(ledger: DataFrame, n: int = EVALUATION_BATCH) -> DataFrame:
    """The newest ``n`` ledger rows (the evaluator's batch; a top-k report)."""
    return ledger.orderBy(F.col("created_at").desc(), F.col("action_id").desc()).limit(n)


def batch_assign(ledger: DataFrame, batch_size: int = EVALUATION_BATCH, chunk_seconds: int = 3600) -> DataFrame:
    """Replay of the periodic evaluator: ledger rows in time order cut into
    consecutive batches of ``batch_size``. The global rank is a chunked scan, so
    no single task sorts the whole ledger. Adds ``batch_no`` and ``as_of`` (the
    newest created_at of the batch: when that batch is evaluated)."""
    df = ledger.withColumn("__chunk", time_chunk("created_at", chunk_seconds))
    ranked = running_scan(df, by=[], chunk="__chunk", order=["created_at", "action_id"],
                          aggs={"__rank": ("sum", F.lit(1))})
    ranked = ranked.withColumn("batch_no", F.floor((F.col("__rank") - 1) / batch_size).cast("long")).drop("__chunk", "__rank")
    asof = ranked.groupBy("batch_no").agg(F.max("created_at").alias("as_of"))
    return ranked.join(asof, on="batch_no", how="inner")


def evaluation_batches(outcomes: DataFrame) -> DataFrame:
    """Per batch: actions_evaluated (all rows, NO_ACTION included), converted,
    undecided, conversion_rate = converted / all (undecided stay in the
    denominator), critic_rewrite_success_rate = the same number (placeholder),
    created_at = the batch's as_of. One grouped aggregate."""
    g = outcomes.groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("actions_evaluated"),
        F.sum(F.when(F.col("converted"), 1).otherwise(0)).alias("converted"),
        F.sum(F.when(F.col("converted").isNull(), 1).otherwise(0)).alias("undecided"),
        F.max("as_of").alias("created_at"),
    )
    rate = F.col("converted").cast("double") / F.col("actions_evaluated").cast("double")
    return g.select("*", rate.alias("conversion_rate"), rate.alias("critic_rewrite_success_rate"))


def drift(metrics: DataFrame, history: int = DRIFT_HISTORY, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """``drift_flagged`` per batch against the previous ``history`` batches.

    history < 2 -> false; average 0 -> rate < 1.0; else (avg - rate) / avg >
    threshold (strict). Cold start: no history, rate < 0.10 and at least 10
    actions -> true. The look-back is an equi-join on batch_no - k for
    k = 1..history (a fixed 20-fold fan-out of the small metrics table).
    """
    prev = metrics.select(F.col("batch_no").alias("__b"), F.col("conversion_rate").alias("__r"))
    back = F.transform(F.sequence(F.lit(1), F.lit(history)), lambda k: F.col("batch_no") - k)
    pairs = metrics.select("batch_no", F.explode(back).alias("__b"))
    hist = pairs.join(prev, on="__b", how="inner").groupBy("batch_no").agg(
        F.count(F.lit(1)).alias("history_len"), F.avg("__r").alias("history_avg"))
    m = metrics.join(hist, on="batch_no", how="left").withColumn(
        "history_len", F.coalesce(F.col("history_len"), F.lit(0)))
    rate, avg, n = F.col("conversion_rate"), F.col("history_avg"), F.col("history_len")
    flagged = (F.when(n < 2, F.lit(False))
               .when(avg == 0, rate < 1.0)
               .otherwise((avg - rate) / avg > threshold))
    cold = (n == 0) & (rate < COLD_START_RATE) & (F.col("actions_evaluated") >= COLD_START_MIN_ACTIONS)
    return m.withColumn("drift_flagged", flagged | cold)


def failed_actions(outcomes: DataFrame) -> DataFrame:
    """Decided and not converted; cart value and duration are not in the ledger (0.0)."""
    return outcomes.where(F.col("converted") == F.lit(False)).select(
        "batch_no", "action_id", "action_type", "intent", "confidence",
        F.coalesce(F.col("reason"), F.lit("")).alias("reason"),
        F.lit(0.0).alias("cart_value"), F.lit(0.0).alias("duration_sec"))


def failure_categories(failed: DataFrame) -> DataFrame:
    """Deterministic failure diagnosis: counts per (action_type, intent, reason)."""
    return failed.groupBy("action_type", "intent", "reason").agg(F.count(F.lit(1)).alias("n_failed"))


def conversion_by_action(outcomes: DataFrame) -> DataFrame:
    """Conversion per (action type, intent) over decided actions."""
    return outcomes.groupBy("action_type", "intent").agg(
        F.count(F.lit(1)).alias("actions"),
        F.sum(F.when(F.col("converted").isNotNull(), 1).otherwise(0)).alias("decided"),
        F.sum(F.when(F.col("converted"), 1).otherwise(0)).alias("converted"),
    ).withColumn("conversion_rate", F.when(F.col("decided") > 0, F.col("converted") / F.col("decided")))


def ops_counters(spark: SparkSession, clicks: DataFrame, decisions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Operational counters as rows (metric, label, value): events ingested,
    predictions by intent, dispatches by action, suppressed decisions, and
    sessions active at the end of the data (last event within 24 h)."""
    ev = clicks.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("events_ingested").alias("metric"), F.lit("").alias("label"), "value")
    pred = decisions.groupBy("intent").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("intent_predictions").alias("metric"), F.col("intent").alias("label"), "value")
    disp = decisions.groupBy("action").agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("actions_dispatched").alias("metric"), F.col("action").alias("label"), "value")
    sup = decisions.agg(F.sum(F.when(F.col("reason") == "SUPPRESSED_WITHIN_15MIN", 1).otherwise(0)).cast("long")
                        .alias("value")).select(F.lit("actions_suppressed").alias("metric"), F.lit("").alias("label"), "value")
    last = clicks.groupBy("session_id").agg(F.max("timestamp").alias("__last"))
    end = clicks.agg(F.max("timestamp")).scalar()
    act = last.where(
        _us("__last") >= _us(end) - F.lit(24 * 60 * US_PER_MIN)).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("active_sessions").alias("metric"), F.lit("").alias("label"), "value")
    return ev.unionByName(pred).unionByName(disp).unionByName(sup).unionByName(act)
