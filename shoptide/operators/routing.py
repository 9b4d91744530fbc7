"""Routing between the fast path and escalation, escalation context, critic."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptide.schema import (
    ALWAYS_ALLOWED, ESCALATE_INTENTS, ESCALATION_CONTEXT, NO_ACTION,
    ROUTE_CONFIDENCE_THRESHOLD, ROUTE_EXPLORATION_THRESHOLD,
)


def route(df: DataFrame, threshold: float = ROUTE_CONFIDENCE_THRESHOLD,
          exploration_threshold: float = ROUTE_EXPLORATION_THRESHOLD) -> DataFrame:
    """Add ``system``: system_2 when confidence is known and below ``threshold``
    (strict), or the intent is CHURN_RISK / LOYAL_RETURNER, or
    exploration_ratio > 0.6 (absent counts as 0.0); else system_1."""
    low = F.coalesce(F.col("confidence") < threshold, F.lit(False))
    complex_intent = F.coalesce(F.col("intent").isin(*ESCALATE_INTENTS), F.lit(False))
    explore = F.coalesce(F.col("exploration_ratio"), F.lit(0.0)) > exploration_threshold
    return df.withColumn(
        "system", F.when(low | complex_intent | explore, F.lit("system_2")).otherwise(F.lit("system_1"))
    ).withColumn(
        "route_reason",
        F.when(low, F.lit("low_confidence")).when(complex_intent, F.lit("complex_intent"))
        .when(explore, F.lit("high_exploration")).otherwise(F.lit("fast_path")),
    )


def escalation_batch(routed: DataFrame, clicks: DataFrame, keep: int = ESCALATION_CONTEXT) -> DataFrame:
    """Events kept as context for escalated sessions: the newest ``keep`` per session.

    A semi-join restricts events to escalated sessions before the shuffle; the
    top-N per session is a ``row_number`` window (each task keeps its rows
    sorted, spilling if needed; nothing is gathered into one list).
    """
    esc = routed.filter(F.col("system") == "system_2").select("session_id")
    ev = clicks.join(esc, on="session_id", how="left_semi")
    w = Window.partitionBy("session_id").orderBy(F.col("timestamp").desc(), F.col("event_id").desc())
    return ev.withColumn("recency_rank", F.row_number().over(w)).filter(F.col("recency_rank") <= keep)


def critic_resolution(proposals: DataFrame, rewrites: DataFrame | None = None,
                      enforce_whitelist: bool = False) -> DataFrame:
    """Critic over escalated proposals.

    ``proposals``: session_id, action, reasoning, allowed (policy verdict; null =
    policy unreachable = denied). ``rewrites``: session_id, rewrite_action,
    rewrite_reasoning (a parsed rewrite suggestion, absent when none).

    allowed -> keep (system_2_critic_approved); denied with a rewrite -> the
    rewrite (system_2_critic_rewrite), by default without re-checking it, as the
    reference does; otherwise NO_ACTION (system_2_critic_rejected).
    """
    df = proposals
    if rewrites is not None:
        df = df.join(rewrites, on="session_id", how="left")
    else:
        df = df.withColumn("rewrite_action", F.lit(None).cast("string")).withColumn(
            "rewrite_reasoning", F.lit(None).cast("string"))
    ok = F.coalesce(F.col("allowed"), F.lit(False))
    has_rw = F.col("rewrite_action").isNotNull()
    if enforce_whitelist:
        has_rw = has_rw & F.col("rewrite_action").isin(*ALWAYS_ALLOWED)
    return df.withColumn(
        "final_action",
        F.when(ok, F.col("action")).when(has_rw, F.col("rewrite_action")).otherwise(F.lit(NO_ACTION)),
    ).withColumn(
        "final_reasoning",
        F.when(ok, F.col("reasoning"))
        .when(has_rw, F.concat(F.lit("Critic rewrite: "), F.coalesce(F.col("rewrite_reasoning"), F.lit(""))))
        .otherwise(F.concat(F.lit("OPA denied '"), F.col("action"), F.lit("': policy violation"))),
    ).withColumn(
        "source",
        F.when(ok, F.lit("system_2_critic_approved")).when(has_rw, F.lit("system_2_critic_rewrite"))
        .otherwise(F.lit("system_2_critic_rejected")),
    )
