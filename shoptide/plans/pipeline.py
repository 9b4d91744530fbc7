"""Composed jobs: the session-level decision and the per-event decision loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.operators.dispatch import action_decisions, session_decision, with_proposed_action
from shoptide.operators.intent import final_intent
from shoptide.operators.policy import policy_allow, policy_reason
from shoptide.operators.sessions import running_features, session_features, sessionize
from shoptide.session import materialize
from shoptide.sources.events import load_clicks

SESSION_GAP_MINUTES = 360  # test-data adapter: sessions by a 6 h inactivity gap


def session_clicks(spark: SparkSession, sf_dir: str, gap_minutes: int = SESSION_GAP_MINUTES) -> DataFrame:
    """Sessionized click events, written once as a table (the event store every
    downstream job reads)."""
    return materialize(sessionize(load_clicks(spark, sf_dir), gap_minutes=gap_minutes), "sessionized")


def session_predictions(clicks: DataFrame, model=None) -> DataFrame:
    """Features -> rule/calibrated/final intent -> proposed action -> policy (both rule sets)."""
    feats = session_features(clicks)
    pred = with_proposed_action(final_intent(feats, model=model))
    return policy_reason(policy_allow(pred))


def session_actions(clicks: DataFrame, model=None) -> DataFrame:
    """What should be done for each session: intent, proposal, policy, guards."""
    return session_decision(session_predictions(clicks, model=model))


def scored_events(clicks: DataFrame, max_events: int | None = None) -> DataFrame:
    """Per event: running features -> intent -> proposed action -> policy."""
    rf = running_features(clicks, max_events=max_events)
    return policy_allow(with_proposed_action(final_intent(rf)))


DECISION_INPUTS = ["session_id", "event_id", "timestamp", "customer_id", "action", "intent", "confidence", "method",
                   "rule_intent", "calibrated_confidence", "proposed_action", "allowed", "total_cart_value",
                   "checkouts", "cart_adds", "session_duration_sec", "exploration_ratio"]


def event_decisions(clicks: DataFrame, cooldown_minutes: int = 15, max_events: int | None = None) -> DataFrame:
    """The per-event decision loop in batch: one decision per arriving event.

    The scored events are written once (only the columns the decision and its
    consumers read) and the cooldown chain runs over that table."""
    scored = materialize(scored_events(clicks, max_events=max_events).select(*DECISION_INPUTS), "scored_events")
    return action_decisions(scored, cooldown_minutes=cooldown_minutes)


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Round double columns (for engine-independent comparison of float results)."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float"):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ledger_table(clicks: DataFrame, cooldown_minutes: int = 15) -> DataFrame:
    """Decisions written to the ledger (upsert on action_id, audit semantics),
    persisted as a table."""
    from shoptide.operators.ledger import ledger_rows, upsert

    return materialize(upsert(ledger_rows(event_decisions(clicks, cooldown_minutes)), mode="pg"), "ledger")


def evaluation_outcomes(clicks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ledger rows in evaluation batches with their conversion outcome."""
    from shoptide.operators.evaluate import batch_assign, conversion

    return conversion(materialize(batch_assign(ledger), "evaluation_batches"), clicks)


def enriched_features(clicks: DataFrame) -> DataFrame:
    """Session features with repeat_customer / days_since_last_purchase filled
    from the customer's earlier history (so the LOYAL_RETURNER and CHURN_RISK
    history rules can fire)."""
    from shoptide.operators.stores import history_enrich

    f = session_features(clicks).drop("repeat_customer", "days_since_last_purchase")
    h = history_enrich(clicks).select(F.col("session_id").alias("__sid"), "repeat_customer", "days_since_last_purchase")
    out = f.join(h, f["session_id"].eqNullSafe(h["__sid"]), "left").drop("__sid")
    return out.withColumn("repeat_customer", F.coalesce("repeat_customer", F.lit(False)))
