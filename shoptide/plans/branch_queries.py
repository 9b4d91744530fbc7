"""Queries whose inputs reach every branch of operators that the given tables leave idle.

The tables hold no rewrites, discounts, search text or sessions beyond the
history bounds. Each query here derives such input from a whole table and lets
the operator decide; the SQL states the expected values on its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from shoptide.plans import oracle as O
from shoptide.plans.pipeline import rounded, session_clicks, session_predictions
from shoptide.plans.registry import _GC, _REG, _ROUTED, register, with_
from shoptide.session import materialize
from shoptide.sources.events import table

SHORT_HISTORY = 3  # events kept: shorter than many sessions


def _newest_sql(rows: str) -> str:
    return f"""SELECT session_id, event_id, recency_rank FROM (SELECT s.*, CAST(ROW_NUMBER() OVER (
  PARTITION BY session_id ORDER BY timestamp DESC, event_id DESC) AS INTEGER) AS recency_rank FROM {rows} s) x
WHERE recency_rank <= {SHORT_HISTORY}"""


@register("bounded_history_cut", f"{with_(O.CLICKS, O.SESS)}\n{_newest_sql('sess')}")
def q_bounded_history_cut(spark, sf):
    """The newest events of every session under a bound that cuts."""
    from shoptide.operators.stores import bounded_history
    return bounded_history(session_clicks(spark, sf), SHORT_HISTORY).select("session_id", "event_id", "recency_rank")


@register("escalation_context_cut", f"""{with_(O.session_pipeline(), _ROUTED)},
esc AS (SELECT * FROM sess WHERE session_id IN (SELECT session_id FROM routed WHERE system = 'system_2'))
{_newest_sql('esc')}""")
def q_escalation_context_cut(spark, sf):
    """Context of escalated sessions under a bound that cuts."""
    from shoptide.operators.routing import escalation_batch, route
    clicks = session_clicks(spark, sf)
    return escalation_batch(route(session_predictions(clicks)), clicks, keep=SHORT_HISTORY).select(
        "session_id", "event_id", "recency_rank")


@register("critic_rewrites", f"""{with_(O.session_pipeline(), _ROUTED)},
rw AS (SELECT *, CASE total_actions % 3 WHEN 0 THEN 'OFFER_BUNDLE' WHEN 1 THEN 'APPLY_DISCOUNT' END AS rw,
  'seen ' || total_actions || ' events' AS why, COALESCE(allowed, FALSE) AS ok FROM routed WHERE system = 'system_2')
SELECT session_id, CASE WHEN ok THEN proposed_action ELSE COALESCE(rw, 'NO_ACTION') END AS final_action,
  CASE WHEN ok THEN 'rule proposal' WHEN rw IS NOT NULL THEN 'Critic rewrite: ' || why
    ELSE 'OPA denied ''' || proposed_action || ''': policy violation' END AS final_reasoning,
  CASE WHEN ok THEN 'system_2_critic_approved' WHEN rw IS NOT NULL THEN 'system_2_critic_rewrite'
    ELSE 'system_2_critic_rejected' END AS source,
  CASE WHEN ok THEN proposed_action WHEN rw = 'OFFER_BUNDLE' THEN rw ELSE 'NO_ACTION' END AS checked_action,
  CASE WHEN ok THEN 'system_2_critic_approved' WHEN rw = 'OFFER_BUNDLE' THEN 'system_2_critic_rewrite'
    ELSE 'system_2_critic_rejected' END AS checked_source
FROM rw""")
def q_critic_rewrites(spark, sf):
    """Escalated proposals with rewrite suggestions for two thirds of the sessions:
    one an always-allowed action, one not. ``checked_*`` holds only rewrites on the list."""
    from shoptide.operators.routing import critic_resolution, route
    esc = materialize(route(session_predictions(session_clicks(spark, sf))).where(F.col("system") == "system_2").select(
        "session_id", "proposed_action", "allowed", "total_actions"), "escalated")
    props = esc.select("session_id", F.col("proposed_action").alias("action"), F.lit("rule proposal").alias("reasoning"), "allowed")
    third = F.col("total_actions") % 3
    rewrites = esc.where(third < 2).select(
        "session_id", F.when(third == 0, "OFFER_BUNDLE").otherwise("APPLY_DISCOUNT").alias("rewrite_action"),
        F.format_string("seen %d events", F.col("total_actions")).alias("rewrite_reasoning"))
    free = critic_resolution(props, rewrites).select("session_id", "final_action", "final_reasoning", "source")
    checked = critic_resolution(props, rewrites, enforce_whitelist=True).select(
        "session_id", F.col("final_action").alias("checked_action"), F.col("source").alias("checked_source"))
    return free.join(checked, "session_id")


@register("search_text", """SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS VARCHAR) AS event_id, text AS query
FROM conversations WHERE role = 'user'""")
def q_search_text(spark, sf):
    """Search text of events whose metadata carries one: every user turn, whole, as JSON."""
    from shoptide.operators.text import search_queries
    c = table(spark, sf, "conversations")
    events = c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("string").alias("event_id"),
        F.timestamp_seconds(F.col("turn").cast("long")).cast("timestamp_ntz").alias("timestamp"),
        F.when(F.col("role") == "user", "search_query").otherwise("page_view").alias("action"),
        F.to_json(F.struct(F.col("text").alias("query"))).alias("metadata"))
    return search_queries(events).select("session_id", "event_id", "query")


@register("governance_discounts", f"""{with_(O.CLICKS, O.SESS)},
ledger AS (SELECT session_id, CASE WHEN category = 'cat_2' THEN 'OFFER_BUNDLE' ELSE 'APPLY_DISCOUNT' END AS action_type,
  CASE WHEN category = 'cat_1' THEN timestamp - INTERVAL 40 DAYS ELSE timestamp END AS created_at
  FROM sess WHERE action = 'add_to_cart'), {_GC}
SELECT session_id, customer_id, total_purchases, discounts_this_month,
  round(last_discount_within_hours, 9) AS last_discount_within_hours FROM gc2""")
def q_governance_discounts(spark, sf):
    """Customer context from a ledger that has discounts, of this month and of the one before."""
    from shoptide.operators.stores import governance_context
    clicks = session_clicks(spark, sf)
    ledger = clicks.where(F.col("action") == "add_to_cart").select(
        "session_id", F.when(F.col("category") == "cat_2", "OFFER_BUNDLE").otherwise("APPLY_DISCOUNT").alias("action_type"),
        F.when(F.col("category") == "cat_1", F.col("timestamp") - F.expr("INTERVAL 40 DAYS"))
        .otherwise(F.col("timestamp")).alias("created_at"))
    return rounded(governance_context(clicks, ledger))


@register("session_registry_replace", f"""{with_(O.CLICKS, O.SESS)}
SELECT session_id, last(customer_id || ':' || action ORDER BY timestamp, event_id) AS customer_id,
  MIN(timestamp) AS created_at, MAX(timestamp) AS last_activity, MAX(timestamp) + INTERVAL 24 HOURS AS expires_at
FROM sess GROUP BY session_id""")
def q_session_registry_replace(spark, sf):
    """Session records where each event replaces the record, from a feed whose customer changes."""
    from shoptide.operators.stores import session_registry
    clicks = session_clicks(spark, sf).withColumn("customer_id", F.concat("customer_id", F.lit(":"), "action"))
    return session_registry(clicks, mode="replace").select(*_REG)


_LINE_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"


def _mode_sql(mode: str, kept: str) -> str:
    return f"""SELECT '{mode}' AS mode, CAST(l_orderkey AS VARCHAR) AS action_id,
  CAST({kept}(l_suppkey {_LINE_ORDER}) AS VARCHAR) AS session_id, {kept}(l_returnflag {_LINE_ORDER}) AS action_type,
  {kept}(l_linestatus {_LINE_ORDER}) AS intent, round({kept}(l_discount {_LINE_ORDER}), 9) AS confidence,
  CAST(last(l_partkey {_LINE_ORDER}) AS VARCHAR) AS reason, last(l_linestatus {_LINE_ORDER}) AS outcome,
  CASE WHEN last(l_quantity {_LINE_ORDER}) > 25 THEN 'acknowledged' ELSE 'dispatched' END AS status,
  {kept}(l_shipdate {_LINE_ORDER}) AS created_at FROM lineitem GROUP BY l_orderkey"""


@register("ledger_modes", f"{_mode_sql('pg', 'first')}\nUNION ALL {_mode_sql('sqlite', 'last')}")
def q_ledger_modes(spark, sf):
    """Both upsert semantics over rows that arrive several times per action: the lines of each order."""
    from shoptide.operators.ledger import upsert
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("action_id"), F.col("l_suppkey").cast("string").alias("session_id"),
        F.col("l_returnflag").alias("action_type"), F.col("l_linestatus").alias("intent"),
        F.col("l_discount").alias("confidence"), F.col("l_partkey").cast("string").alias("reason"),
        F.col("l_linestatus").alias("outcome"), (F.col("l_quantity") > 25).alias("acknowledged"),
        F.col("l_shipdate").alias("created_at"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("seq"))
    both = None
    for mode in ("pg", "sqlite"):
        one = upsert(rows, mode).select(F.lit(mode).alias("mode"), "action_id", "session_id", "action_type", "intent",
                                        "confidence", "reason", "outcome", "status", "created_at")
        both = one if both is None else both.unionByName(one)
    return rounded(both)
