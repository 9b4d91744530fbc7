"""Named queries: each has a Spark job and (where SQL can state it) a DuckDB twin.

Every query reads the given tables (or data Spark derives from them) in full.
Double columns are rounded to 9 digits on both sides for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.operators import intent as intent_ops
from shoptide.operators.markov import session_markov
from shoptide.operators.routing import route
from shoptide.operators.sessions import running_features, session_features
from shoptide.operators.text import query_signals
from shoptide.plans import oracle as O
from shoptide.plans.pipeline import evaluation_outcomes, ledger_table, event_decisions, rounded, scored_events, session_actions, session_clicks, session_predictions
from shoptide.schema import INTENTS
from shoptide.sources.events import table

SparkQuery = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, SparkQuery] = {}
SQL: dict[str, str] = {}

FEATURE_COLS = [
    "session_id", "customer_id", "session_duration_sec", "total_actions", "page_views", "cart_adds",
    "cart_removes", "checkouts", "searches", "total_cart_value", "max_item_value", "avg_item_value",
    "categories_viewed", "category_switches", "cart_conversion_rate", "checkout_conversion_rate",
    "cart_abandon_rate", "exploration_ratio", "cart_value_per_minute", "avg_inter_event_time",
]
DOUBLE_FEATURES = {
    "session_duration_sec", "total_cart_value", "max_item_value", "avg_item_value", "cart_conversion_rate",
    "checkout_conversion_rate", "cart_abandon_rate", "exploration_ratio", "cart_value_per_minute",
    "avg_inter_event_time", "rule_confidence", "calibrated_confidence", "confidence", "value",
}


def register(name: str, sql: str | None = None):
    """Register a query. Event times are TIMESTAMP_NTZ in UTC; epoch arithmetic
    goes through the session time zone, so every query pins it to UTC."""
    def deco(fn: SparkQuery) -> SparkQuery:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def sel(cols: list[str], rounded_cols: set[str] = DOUBLE_FEATURES) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" if c in rounded_cols else c for c in cols)


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes)


# --- 2.3 sessions and features ------------------------------------------------------
SESSIONIZE_COLS = ["event_id", "session_id", "customer_id", "timestamp", "action", "category", "value"]


@register("sessionize", f"{with_(O.CLICKS, O.SESS)}\nSELECT {sel(SESSIONIZE_COLS)} FROM sess")
def q_sessionize(spark, sf):
    return rounded(session_clicks(spark, sf).select(*SESSIONIZE_COLS))


@register("session_features", f"{with_(O.CLICKS, O.SESS, O.EV, O.FEAT)}\nSELECT {sel(FEATURE_COLS)} FROM feat")
def q_session_features(spark, sf):
    return rounded(session_features(session_clicks(spark, sf)).select(*FEATURE_COLS))


RUNNING_COLS = ["event_id", *FEATURE_COLS]


@register("running_features", f"{with_(O.CLICKS, O.SESS, O.EV, O.RUNFEAT)}\nSELECT {sel(RUNNING_COLS)} FROM rfeat")
def q_running_features(spark, sf):
    return rounded(running_features(session_clicks(spark, sf)).select(*RUNNING_COLS))


@register("feature_vector", f"""{with_(O.CLICKS, O.SESS, O.EV, O.FEAT)}
SELECT session_id, list_transform([{', '.join('CAST(' + c + ' AS DOUBLE)' for c in FEATURE_COLS[2:])}], lambda x: round(x, 9)) AS features FROM feat""")
def q_feature_vector(spark, sf):
    from shoptide.schema import FEATURE_ORDER
    f = session_features(session_clicks(spark, sf))
    vec = F.array(*[F.round(F.col(c).cast("double"), 9) for c in FEATURE_ORDER])
    return f.select("session_id", vec.alias("features"))


# --- 2.4 intent -----------------------------------------------------------------------
SCORE_COLS = ["session_id", *[O.sc(i) for i in INTENTS]]


@register("rule_scores", f"{with_(O.session_pipeline())}\nSELECT {', '.join(SCORE_COLS)} FROM sp_pol")
def q_rule_scores(spark, sf):
    return intent_ops.rule_scores(session_features(session_clicks(spark, sf))).select(*SCORE_COLS)


@register("rule_intent", f"{with_(O.session_pipeline())}\nSELECT {sel(['session_id', 'rule_intent', 'rule_confidence'])} FROM sp_pol")
def q_rule_intent(spark, sf):
    df = intent_ops.rule_intent(session_features(session_clicks(spark, sf)))
    return rounded(df.select("session_id", "rule_intent", "rule_confidence"))


_CAL = ["session_id", "rule_intent", "rule_confidence", "calibrated_confidence"]


@register("calibrated_intent", f"{with_(O.session_pipeline())}\nSELECT {sel(_CAL)} FROM sp_pol")
def q_calibrated_intent(spark, sf):
    return rounded(intent_ops.calibrated_intent(session_features(session_clicks(spark, sf))).select(*_CAL))


_FINAL = ["session_id", "intent", "confidence", "method"]


@register("final_intent", f"{with_(O.session_pipeline())}\nSELECT {sel(_FINAL)} FROM sp_pol")
def q_final_intent(spark, sf):
    return rounded(intent_ops.final_intent(session_features(session_clicks(spark, sf))).select(*_FINAL))


@register("intent_distribution", f"""{with_(O.session_pipeline())},
classes AS (SELECT * FROM (VALUES {', '.join(f"('{i}')" for i in INTENTS)}) t(intent)),
cnt AS (SELECT intent, COUNT(*) AS n FROM sp_pol GROUP BY intent)
SELECT c.intent, COALESCE(cnt.n, 0) AS n FROM classes c LEFT JOIN cnt ON c.intent = cnt.intent
UNION ALL SELECT 'TOTAL' AS intent, COUNT(*) AS n FROM sp_pol""")
def q_intent_distribution(spark, sf):
    pred = intent_ops.final_intent(session_features(session_clicks(spark, sf)))
    return intent_ops.intent_distribution(spark, pred)


# --- 2.5 Markov -----------------------------------------------------------------------
_MK = f"""mk_rn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS rn FROM sess),
mk AS (
  SELECT session_id, last(action ORDER BY timestamp, event_id) AS last_action,
    SUM(CASE WHEN action = 'add_to_cart' THEN 1 ELSE 0 END) AS n_add,
    SUM(CASE WHEN action = 'checkout_start' THEN 1 ELSE 0 END) AS n_chk,
    SUM(CASE WHEN action = 'search_query' THEN 1 ELSE 0 END) AS n_srch,
    MIN(CASE WHEN action = 'add_to_cart' THEN rn END) AS f_add,
    MIN(CASE WHEN action = 'checkout_start' THEN rn END) AS f_chk,
    MIN(CASE WHEN action = 'search_query' THEN rn END) AS f_srch
  FROM mk_rn GROUP BY session_id),
mk_state AS (SELECT *, {O.markov_state_sql('last_action')} AS current_state FROM mk)"""

_MK_NEXT = O.markov_next_sql(
    "current_state",
    {"add_to_cart": "n_add", "checkout_start": "n_chk", "search_query": "n_srch"},
    {"add_to_cart": "f_add", "checkout_start": "f_chk", "search_query": "f_srch"},
)


@register("markov_state", f"{with_(O.CLICKS, O.SESS, _MK)}\nSELECT session_id, last_action, current_state FROM mk_state")
def q_markov_state(spark, sf):
    return session_markov(session_clicks(spark, sf)).select("session_id", "last_action", "current_state")


@register("markov_next", f"{with_(O.CLICKS, O.SESS, _MK)}\nSELECT session_id, current_state, {_MK_NEXT} AS predicted_next_state FROM mk_state")
def q_markov_next(spark, sf):
    return session_markov(session_clicks(spark, sf)).select("session_id", "current_state", "predicted_next_state")


# --- 2.8 policy and decisions -----------------------------------------------------------
@register("proposed_action", f"{with_(O.session_pipeline())}\nSELECT session_id, intent, proposed_action FROM sp_pol")
def q_proposed_action(spark, sf):
    return session_predictions(session_clicks(spark, sf)).select("session_id", "intent", "proposed_action")


@register("policy_allow", f"{with_(O.session_pipeline())}\nSELECT session_id, proposed_action, allowed FROM sp_pol")
def q_policy_allow(spark, sf):
    return session_predictions(session_clicks(spark, sf)).select("session_id", "proposed_action", "allowed")


@register("policy_reason", f"{with_(O.session_pipeline())}\nSELECT session_id, proposed_action, policy_reason FROM sp_pol")
def q_policy_reason(spark, sf):
    return session_predictions(session_clicks(spark, sf)).select("session_id", "proposed_action", "policy_reason")


_SA = ["session_id", "intent", "confidence", "proposed_action", "allowed", "action", "reason"]


@register("session_actions", f"""{with_(O.session_pipeline())}
SELECT {sel(['session_id', 'intent', 'confidence', 'proposed_action', 'allowed'])},
  CASE WHEN allowed THEN guarded_action ELSE 'NO_ACTION' END AS action,
  CASE WHEN NOT allowed THEN '' WHEN guarded_action = 'NO_ACTION' THEN guard_reason END AS reason
FROM sp_pol""")
def q_session_actions(spark, sf):
    return rounded(session_actions(session_clicks(spark, sf)).select(*_SA))


@register("dispatch_guards", f"""{with_(O.session_pipeline())}
SELECT session_id, proposed_action, guarded_action, guard_reason FROM sp_pol""")
def q_dispatch_guards(spark, sf):
    from shoptide.operators.dispatch import dispatch_guards
    df = dispatch_guards(session_predictions(session_clicks(spark, sf)))
    return df.select("session_id", "proposed_action", "guarded_action", "guard_reason")


_DEC = ["event_id", "session_id", "timestamp", "intent", "confidence", "proposed_action", "allowed",
        "dispatched", "action", "reason"]


@register("action_decisions", f"""{with_(O.event_pipeline(), O.decisions_ctes(15))}
SELECT {sel(_DEC)}, {O.ACTION_ID_SQL} AS action_id FROM decisions""")
def q_action_decisions(spark, sf):
    return rounded(event_decisions(session_clicks(spark, sf), cooldown_minutes=15).select(*_DEC, "action_id"))


@register("suppression", f"""{with_(O.event_pipeline(), O.decisions_ctes(360))}
SELECT event_id, session_id, dispatched, action, reason FROM decisions""")
def q_suppression(spark, sf):
    """Same loop with a 6 h cooldown, so the chain suppresses often on the test data."""
    d = event_decisions(session_clicks(spark, sf), cooldown_minutes=360)
    return d.select("event_id", "session_id", "dispatched", "action", "reason")


@register("action_id", f"""{with_(O.event_pipeline(), O.decisions_ctes(15))}
SELECT session_id, action, timestamp, {O.ACTION_ID_SQL} AS action_id FROM decisions WHERE dispatched""")
def q_action_id(spark, sf):
    d = event_decisions(session_clicks(spark, sf), cooldown_minutes=15)
    return d.where("dispatched").select("session_id", "action", "timestamp", "action_id")


@register("suppressor_counts", f"""{with_(O.event_pipeline(), O.decisions_ctes(15))}
SELECT session_id, action, COUNT(*) AS dispatch_count FROM decisions WHERE dispatched GROUP BY session_id, action""")
def q_suppressor_counts(spark, sf):
    from shoptide.operators.dispatch import suppressor_counts
    return suppressor_counts(event_decisions(session_clicks(spark, sf), cooldown_minutes=15))


# --- 2.7 routing ---------------------------------------------------------------------------
@register("route", f"""{with_(O.session_pipeline())}
SELECT session_id, intent, round(confidence, 9) AS confidence,
  CASE WHEN COALESCE(confidence < 0.7, FALSE) OR intent IN ('CHURN_RISK', 'LOYAL_RETURNER')
       OR COALESCE(exploration_ratio, 0.0) > 0.6 THEN 'system_2' ELSE 'system_1' END AS system
FROM sp_pol""")
def q_route(spark, sf):
    pred = intent_ops.final_intent(session_features(session_clicks(spark, sf)))
    return rounded(route(pred).select("session_id", "intent", "confidence", "system"))


# --- 2.6 text signals ---------------------------------------------------------------------
def _signal_sql(text: str) -> str:
    from shoptide.schema import KEYWORD_SIGNALS
    parts = []
    for name, words in KEYWORD_SIGNALS.items():
        cond = " OR ".join(f"contains(lower(COALESCE({text}, '')), '{w}')" for w in words)
        parts.append(f"({cond}) AS {name}")
    return ", ".join(parts)


@register("query_signals", f"""SELECT conv_id, turn, {_signal_sql('text')} FROM conversations WHERE role = 'user'""")
def q_query_signals(spark, sf):
    conv = table(spark, sf, "conversations").where(F.col("role") == "user")
    sig = query_signals(conv.select("conv_id", "turn", F.col("text").alias("query")), "query")
    return sig.drop("query")


@register("session_signals", f"""WITH s AS (SELECT conv_id, {_signal_sql('text')} FROM conversations WHERE role = 'user')
SELECT conv_id, bool_or(price_sensitive) AS price_sensitive, bool_or(brand_loyal) AS brand_loyal,
  bool_or(comparison_shopping) AS comparison_shopping, bool_or(urgency) AS urgency, COUNT(*) AS n_queries
FROM s GROUP BY conv_id""")
def q_session_signals(spark, sf):
    from shoptide.operators.text import session_signals
    conv = table(spark, sf, "conversations").where(F.col("role") == "user")
    sig = query_signals(conv.select("conv_id", F.col("text").alias("query")), "query")
    return session_signals(sig, key="conv_id")


def scored_event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return scored_events(session_clicks(spark, sf))


# --- 2.8 ledger -------------------------------------------------------------------------------
_LEDGER_BASE = f"{with_(O.event_pipeline(), O.decisions_ctes(15), O.LEDGER)}"
_LCOLS = ["action_id", "session_id", "action_type", "intent", "confidence", "reason", "outcome",
          "acknowledged", "status", "created_at"]


def _ledger(spark, sf):
    clicks = session_clicks(spark, sf)
    return clicks, ledger_table(clicks)


@register("ledger_upsert", f"{_LEDGER_BASE}\nSELECT {sel(_LCOLS)} FROM ledger")
def q_ledger_upsert(spark, sf):
    return rounded(_ledger(spark, sf)[1].select(*_LCOLS))


@register("action_history", f"""{_LEDGER_BASE}
SELECT session_id, action_id, action_type, created_at,
  CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY created_at DESC, action_id DESC) AS INTEGER) AS recency_rank FROM ledger""")
def q_action_history(spark, sf):
    """Every session's ledger history with its newest-first rank."""
    from shoptide.operators.ledger import recency_rank
    led = _ledger(spark, sf)[1]
    return recency_rank(led).select("session_id", "action_id", "action_type", "created_at", "recency_rank")


@register("recent_actions", f"""{_LEDGER_BASE}
SELECT action_id, session_id, action_type, created_at FROM ledger ORDER BY created_at DESC, action_id DESC LIMIT 100""")
def q_recent_actions(spark, sf):
    from shoptide.operators.evaluate import recent_actions
    return recent_actions(_ledger(spark, sf)[1]).select("action_id", "session_id", "action_type", "created_at")


# --- 2.9/2.10 evaluation ----------------------------------------------------------------------
_EVAL_BASE = f"{_LEDGER_BASE},\n{O.BATCHES}"


def _outcomes(spark, sf):
    clicks, led = _ledger(spark, sf)
    return evaluation_outcomes(clicks, led)


@register("conversion", f"""{_EVAL_BASE}
SELECT action_id, session_id, batch_no, as_of, converted FROM outc""")
def q_conversion(spark, sf):
    return _outcomes(spark, sf).select("action_id", "session_id", "batch_no", "as_of", "converted")


_EB = ["batch_no", "actions_evaluated", "converted", "undecided", "conversion_rate",
       "critic_rewrite_success_rate", "drift_flagged", "created_at"]


@register("evaluation_batch", f"""{_EVAL_BASE}
SELECT batch_no, actions_evaluated, converted, undecided, round(conversion_rate, 9) AS conversion_rate,
  round(conversion_rate, 9) AS critic_rewrite_success_rate, drift_flagged, created_at FROM dr2""")
def q_evaluation_batch(spark, sf):
    """Batch metrics are persisted (the metrics table) before drift reads them twice."""
    from shoptide.operators.evaluate import drift, evaluation_batches
    from shoptide.session import materialize
    metrics = materialize(evaluation_batches(_outcomes(spark, sf)), "metrics")
    return rounded(drift(metrics).select(*_EB))


@register("drift", f"""{_EVAL_BASE}
SELECT batch_no, round(conversion_rate, 9) AS conversion_rate, history_len, round(history_avg, 9) AS history_avg,
  drift_flagged FROM dr2""")
def q_drift(spark, sf):
    from shoptide.operators.evaluate import drift, evaluation_batches
    from shoptide.session import materialize
    d = drift(materialize(evaluation_batches(_outcomes(spark, sf)), "metrics"))
    return rounded(d.select("batch_no", "conversion_rate", "history_len", "history_avg", "drift_flagged"))


_FA = ["batch_no", "action_id", "action_type", "intent", "confidence", "reason", "cart_value", "duration_sec"]


@register("failed_actions", f"""{_EVAL_BASE}
SELECT batch_no, action_id, action_type, intent, round(confidence, 9) AS confidence, COALESCE(reason, '') AS reason,
  CAST(0.0 AS DOUBLE) AS cart_value, CAST(0.0 AS DOUBLE) AS duration_sec FROM outc WHERE converted = FALSE""")
def q_failed_actions(spark, sf):
    from shoptide.operators.evaluate import failed_actions
    return rounded(failed_actions(_outcomes(spark, sf)).select(*_FA))


@register("failure_categories", f"""{_EVAL_BASE}
SELECT action_type, intent, COALESCE(reason, '') AS reason, COUNT(*) AS n_failed FROM outc WHERE converted = FALSE
GROUP BY action_type, intent, COALESCE(reason, '')""")
def q_failure_categories(spark, sf):
    from shoptide.operators.evaluate import failed_actions, failure_categories
    return failure_categories(failed_actions(_outcomes(spark, sf)))


@register("conversion_by_action", f"""{_EVAL_BASE}
SELECT action_type, intent, COUNT(*) AS actions,
  CAST(SUM(CASE WHEN converted IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS decided,
  CAST(SUM(CASE WHEN converted THEN 1 ELSE 0 END) AS BIGINT) AS converted,
  round(CASE WHEN SUM(CASE WHEN converted IS NOT NULL THEN 1 ELSE 0 END) > 0 THEN
    CAST(SUM(CASE WHEN converted THEN 1 ELSE 0 END) AS DOUBLE) / CAST(SUM(CASE WHEN converted IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) END, 9)
    AS conversion_rate
FROM outc GROUP BY action_type, intent""")
def q_conversion_by_action(spark, sf):
    from shoptide.operators.evaluate import conversion_by_action
    return rounded(conversion_by_action(_outcomes(spark, sf)))


@register("ops_counters", f"""{with_(O.event_pipeline(), O.decisions_ctes(15))},
lastev AS (SELECT session_id, MAX(timestamp) AS l FROM sess GROUP BY session_id)
SELECT 'events_ingested' AS metric, '' AS label, COUNT(*) AS value FROM sess
UNION ALL SELECT 'intent_predictions', intent, COUNT(*) FROM decisions GROUP BY intent
UNION ALL SELECT 'actions_dispatched', action, COUNT(*) FROM decisions GROUP BY action
UNION ALL SELECT 'actions_suppressed', '', CAST(SUM(CASE WHEN reason = 'SUPPRESSED_WITHIN_15MIN' THEN 1 ELSE 0 END) AS BIGINT) FROM decisions
UNION ALL SELECT 'active_sessions', '', COUNT(*) FROM lastev
  WHERE epoch_us(l) >= (SELECT epoch_us(MAX(timestamp)) FROM sess) - 86400000000""")
def q_ops_counters(spark, sf):
    from shoptide.operators.evaluate import ops_counters
    from shoptide.session import materialize
    clicks = session_clicks(spark, sf)
    return ops_counters(spark, clicks, materialize(event_decisions(clicks, 15), "decisions"))


# --- 2.1 ingest ------------------------------------------------------------------------------
def _parsed_feed(spark, sf):
    from shoptide.sources.events import parse_json_values, raw_event_json
    return parse_json_values(raw_event_json(session_clicks(spark, sf)))


_VE = ["event_id", "session_id", "customer_id", "timestamp", "action", "category", "value"]
_INGEST = f"{with_(O.CLICKS, O.SESS, O.RAWFEED)}"


@register("valid_events", f"{_INGEST}\nSELECT {sel(_VE)} FROM checked WHERE valid")
def q_valid_events(spark, sf):
    from shoptide.sources.events import valid_events
    return rounded(valid_events(_parsed_feed(spark, sf)).select(*_VE))


@register("quarantine", f"{_INGEST}\nSELECT raw, quarantine_reason FROM checked WHERE NOT valid")
def q_quarantine(spark, sf):
    from shoptide.sources.events import quarantine
    return quarantine(_parsed_feed(spark, sf)).select("raw", "quarantine_reason")


@register("event_defaults", f"""{_INGEST}
SELECT COALESCE(event_id, {O.DEFAULT_ID_SQL}) AS event_id, session_id, timestamp, action,
  COALESCE(CAST(NULL AS VARCHAR), '{{}}') AS metadata FROM checked WHERE valid""")
def q_event_defaults(spark, sf):
    from shoptide.sources.events import valid_events, with_event_defaults
    df = with_event_defaults(valid_events(_parsed_feed(spark, sf)))
    return df.select("event_id", "session_id", "timestamp", "action", "metadata")


@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """Write the click events as labelled CSV (rule intent of the session as the
    label) and read them back with the fixed schema."""
    from shoptide.session import checkpoint_dir
    from shoptide.sources.events import read_csv_events, write_csv_events
    import uuid
    clicks = session_clicks(spark, sf)
    labels = intent_ops.final_intent(session_features(clicks)).select(
        "session_id", F.col("intent").alias("ground_truth_intent"))
    out = clicks.join(labels, "session_id").select(
        "event_id", "session_id", "customer_id", "timestamp", "action", "product_id", "category", "value",
        "metadata", "ground_truth_intent")
    path = f"{checkpoint_dir(spark).rstrip('/')}/shoptide/csv-{uuid.uuid4().hex[:12]}"
    write_csv_events(out.withColumn("timestamp", F.col("timestamp").cast("timestamp")), path)
    return read_csv_events(spark, path, with_label=True)


# --- 2.2 stores ---------------------------------------------------------------------------------
@register("event_dedup", f"""{with_(O.CLICKS, O.SESS, O.LOG)}
SELECT event_id, session_id, round(value, 9) AS value, ingest_seq FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY ingest_seq DESC) AS rn FROM ilog) x WHERE rn = 1""")
def q_event_dedup(spark, sf):
    from shoptide.operators.stores import event_dedup, redeliveries
    d = event_dedup(redeliveries(session_clicks(spark, sf)))
    return rounded(d.select("event_id", "session_id", "value", "ingest_seq"))


@register("bounded_history", f"""{with_(O.CLICKS, O.SESS)}
SELECT event_id, session_id, recency_rank FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY timestamp DESC, event_id DESC) AS INTEGER) AS recency_rank FROM sess) x
WHERE recency_rank <= 100""")
def q_bounded_history(spark, sf):
    from shoptide.operators.stores import bounded_history
    return bounded_history(session_clicks(spark, sf), 100).select("event_id", "session_id", "recency_rank")


def _asof(clicks):
    """The latest event time as a scalar subquery."""
    return clicks.agg(F.max("timestamp")).scalar()


@register("event_ttl", f"""{with_(O.CLICKS, O.SESS)}
SELECT event_id, session_id, timestamp FROM sess WHERE epoch_us(timestamp) >= epoch_us({O.ASOF}) - 86400000000""")
def q_event_ttl(spark, sf):
    from shoptide.operators.stores import event_ttl
    c = session_clicks(spark, sf)
    kept = event_ttl(c, _asof(c))
    return kept.select("event_id", "session_id", "timestamp")


_REG = ["session_id", "customer_id", "created_at", "last_activity", "expires_at"]
_REG_SQL = """reg AS (SELECT session_id, first(customer_id ORDER BY timestamp, event_id) AS customer_id,
  MIN(timestamp) AS created_at, MAX(timestamp) AS last_activity, MAX(timestamp) + INTERVAL 24 HOURS AS expires_at
  FROM sess GROUP BY session_id)"""


@register("session_registry", f"{with_(O.CLICKS, O.SESS, _REG_SQL)}\nSELECT {', '.join(_REG)} FROM reg")
def q_session_registry(spark, sf):
    from shoptide.operators.stores import session_registry
    return session_registry(session_clicks(spark, sf)).select(*_REG)


@register("active_sessions", f"""{with_(O.CLICKS, O.SESS, _REG_SQL)}
SELECT {', '.join(_REG)} FROM reg WHERE epoch_us(expires_at) >= epoch_us({O.ASOF})""")
def q_active_sessions(spark, sf):
    from shoptide.operators.stores import active_sessions, session_registry
    c = session_clicks(spark, sf)
    return active_sessions(session_registry(c), _asof(c)).select(*_REG)


@register("expired_sessions", f"""{with_(O.CLICKS, O.SESS, _REG_SQL)}
SELECT {', '.join(_REG)} FROM reg WHERE epoch_us(expires_at) < epoch_us({O.ASOF})""")
def q_expired_sessions(spark, sf):
    from shoptide.operators.stores import expired_sessions, session_registry
    c = session_clicks(spark, sf)
    return expired_sessions(session_registry(c), _asof(c)).select(*_REG)


_CP = ["customer_id", "total_sessions", "total_purchases", "lifetime_value", "avg_session_duration",
       "preferred_categories", "last_updated"]


@register("customer_profile", f"""{with_(O.CLICKS, O.SESS, O.EV, O.FEAT)},
cp_base AS (SELECT customer_id, CAST(SUM(CASE WHEN action = 'purchase_complete' THEN 1 ELSE 0 END) AS BIGINT) AS total_purchases,
  SUM(CASE WHEN action = 'purchase_complete' THEN COALESCE(value, 0.0) ELSE 0.0 END) AS lifetime_value,
  MAX(timestamp) AS last_updated FROM sess GROUP BY customer_id),
cp_sess AS (SELECT customer_id, COUNT(*) AS total_sessions, AVG(session_duration_sec) AS avg_session_duration
  FROM feat GROUP BY customer_id),
cp_cat AS (SELECT customer_id, category, COUNT(*) AS n FROM ev GROUP BY customer_id, category),
cp_top AS (SELECT customer_id, list(category ORDER BY r) AS preferred_categories FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY n DESC, category) AS r FROM cp_cat) x
  WHERE r <= 3 GROUP BY customer_id)
SELECT customer_id, total_sessions, total_purchases, round(lifetime_value, 9) AS lifetime_value,
  round(avg_session_duration, 9) AS avg_session_duration, preferred_categories, last_updated
FROM cp_base LEFT JOIN cp_sess USING (customer_id) LEFT JOIN cp_top USING (customer_id)""")
def q_customer_profile(spark, sf):
    from shoptide.operators.stores import customer_profile
    c = session_clicks(spark, sf)
    return rounded(customer_profile(c, session_features(c)).select(*_CP))


@register("profile_upsert", f"""{with_(O.CLICKS, O.SESS)},
snap AS (SELECT customer_id, CAST(timestamp AS DATE) AS day, COUNT(DISTINCT session_id) AS total_sessions,
  CAST(SUM(CASE WHEN action = 'purchase_complete' THEN 1 ELSE 0 END) AS BIGINT) AS total_purchases,
  SUM(CASE WHEN action = 'purchase_complete' THEN COALESCE(value, 0.0) ELSE 0.0 END) AS lifetime_value,
  MAX(timestamp) AS last_updated FROM sess GROUP BY customer_id, CAST(timestamp AS DATE))
SELECT customer_id, total_sessions, total_purchases, round(lifetime_value, 9) AS lifetime_value, last_updated FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY last_updated DESC) AS rn FROM snap) x WHERE rn = 1""")
def q_profile_upsert(spark, sf):
    from shoptide.operators.stores import daily_profile_snapshots, profile_upsert
    p = profile_upsert(daily_profile_snapshots(session_clicks(spark, sf)))
    return rounded(p.select("customer_id", "total_sessions", "total_purchases", "lifetime_value", "last_updated"))


# --- 2.9 enrichment joins ----------------------------------------------------------------------
@register("history_enrich", f"""{with_(O.CLICKS, O.SESS, O.STARTS)},
he AS (SELECT st.*,
  (SELECT COUNT(*) FROM sess p WHERE p.customer_id = st.customer_id AND p.action = 'purchase_complete'
     AND p.timestamp < st.session_start) AS n_before,
  (SELECT MAX(p.timestamp) FROM sess p WHERE p.customer_id = st.customer_id AND p.action = 'purchase_complete'
     AND p.timestamp < st.session_start) AS last_before
  FROM st)
SELECT session_id, customer_id, n_before > 0 AS repeat_customer,
  CAST(floor((epoch_us(session_start) - epoch_us(last_before)) / 86400000000) AS INTEGER) AS days_since_last_purchase
FROM he""")
def q_history_enrich(spark, sf):
    from shoptide.operators.stores import history_enrich
    return history_enrich(session_clicks(spark, sf))


_GC = f"""{O.STARTS},
disc AS (SELECT st.customer_id, l.created_at FROM ledger l JOIN st ON l.session_id = st.session_id
  WHERE l.action_type IN ('APPLY_DISCOUNT', 'OFFER_DISCOUNT')),
gc AS (SELECT st.*,
  (SELECT COUNT(*) FROM sess p WHERE p.customer_id = st.customer_id AND p.action = 'purchase_complete'
     AND p.timestamp < st.session_start) AS total_purchases,
  (SELECT COUNT(*) FROM disc d WHERE d.customer_id = st.customer_id AND d.created_at < st.session_start
     AND d.created_at >= date_trunc('month', st.session_start)) AS discounts_this_month,
  (SELECT MAX(d.created_at) FROM disc d WHERE d.customer_id = st.customer_id AND d.created_at < st.session_start) AS last_disc
  FROM st),
gc2 AS (SELECT session_id, customer_id, CAST(total_purchases AS INTEGER) AS total_purchases,
  CAST(discounts_this_month AS INTEGER) AS discounts_this_month,
  (epoch_us(session_start) - epoch_us(last_disc)) / 3600000000.0 AS last_discount_within_hours FROM gc)"""


@register("governance_context", f"""{_LEDGER_BASE}, {_GC}
SELECT session_id, customer_id, total_purchases, discounts_this_month,
  round(last_discount_within_hours, 9) AS last_discount_within_hours FROM gc2""")
def q_governance_context(spark, sf):
    from shoptide.operators.stores import governance_context
    clicks, led = _ledger(spark, sf)
    return rounded(governance_context(clicks, led))


# --- 2.9 graph ---------------------------------------------------------------------------------
@register("product_graph", """WITH pop AS (SELECT l_partkey AS pk, COUNT(*) AS popularity FROM lineitem GROUP BY l_partkey),
prod AS (SELECT p_partkey AS product_id, p_name AS product_name, p_retailprice AS price,
  COALESCE(popularity, 0) AS popularity, p_type AS category FROM part LEFT JOIN pop ON p_partkey = pk),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY category ORDER BY popularity DESC, product_name, product_id) AS INTEGER) AS rank FROM prod),
li AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
comp AS (SELECT DISTINCT a.l_partkey AS product_id, p.p_name AS name FROM li a JOIN li b
  ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey JOIN part p ON p.p_partkey = b.l_partkey),
comp3 AS (SELECT product_id, list(name ORDER BY name)[1:3] AS complementary FROM comp GROUP BY product_id),
sim AS (SELECT DISTINCT a.p_partkey AS product_id, b.p_name AS name FROM part a JOIN part b
  ON a.p_brand = b.p_brand AND a.p_size // 10 = b.p_size // 10 AND a.p_partkey <> b.p_partkey),
sim3 AS (SELECT product_id, list(name ORDER BY name)[1:3] AS "similar" FROM sim GROUP BY product_id)
SELECT category, r.product_id, product_name, round(price, 9) AS price, popularity,
  COALESCE(complementary, []::VARCHAR[]) AS complementary, COALESCE("similar", []::VARCHAR[]) AS "similar", rank
FROM ranked r LEFT JOIN comp3 c ON r.product_id = c.product_id LEFT JOIN sim3 s ON r.product_id = s.product_id
WHERE rank <= 5""")
def q_product_graph(spark, sf):
    from shoptide.operators.graph import product_graph
    return rounded(product_graph(table(spark, sf, "part"), table(spark, sf, "lineitem")))


@register("customer_affinity", """WITH pur AS (SELECT o.o_custkey AS customer_id, p.p_type AS category, p.p_retailprice AS price
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey),
agg AS (SELECT customer_id, category, COUNT(*) AS purchase_count, SUM(price) AS total_spent FROM pur GROUP BY customer_id, category),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY purchase_count DESC, category) AS INTEGER) AS rank FROM agg),
t AS (SELECT * FROM r WHERE rank <= 5)
SELECT customer_id, category, purchase_count, round(total_spent, 9) AS total_spent, rank,
  FIRST_VALUE(category) OVER (PARTITION BY customer_id ORDER BY rank) AS top_category,
  COUNT(*) OVER (PARTITION BY customer_id) AS total_categories FROM t""")
def q_customer_affinity(spark, sf):
    from shoptide.operators.graph import customer_affinity
    return rounded(customer_affinity(table(spark, sf, "orders"), table(spark, sf, "lineitem"), table(spark, sf, "part")))


# --- 2.12 vectors, traces, ML -----------------------------------------------------------------------
@register("similar_topk", """WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
  generate_subscripts(embedding, 1) AS i FROM embeddings),
nr AS (SELECT vec_id, sqrt(SUM(x * x)) AS nrm FROM u GROUP BY vec_id),
d AS (SELECT a.vec_id AS qid, b.vec_id AS cid, SUM(a.x * b.x) AS dot FROM u a JOIN u b ON a.i = b.i AND a.vec_id <> b.vec_id
  GROUP BY a.vec_id, b.vec_id),
s AS (SELECT qid, cid, dot / (na.nrm * nb.nrm) AS score FROM d JOIN nr na ON na.vec_id = qid JOIN nr nb ON nb.vec_id = cid),
r AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY qid ORDER BY score DESC, cid) AS INTEGER) AS rank FROM s)
SELECT qid, cid, round(score, 9) AS score, rank FROM r WHERE rank <= 5""")
def q_similar_topk(spark, sf):
    """Exact top-5 cosine neighbours of every embedding among all others."""
    from shoptide.operators.vectors import cosine_topk
    e = table(spark, sf, "embeddings")
    return rounded(cosine_topk(e, e, k=5).select("qid", "cid", "score", "rank"))


def _similar(spark, sf):
    """Index of every embedding; queries are the rows whose id 50 divides."""
    import uuid

    from shoptide.operators.similar import build_index, search
    from shoptide.session import checkpoint_dir
    e = table(spark, sf, "embeddings")
    path = f"{checkpoint_dir(spark).rstrip('/')}/shoptide/vector-index-{uuid.uuid4().hex[:12]}"
    build_index(e, path)
    return e, search(e.where(F.col("vec_id") % 50 == 0), path)


@register("similar_approx")
def q_similar_approx(spark, sf):
    """Top-5 neighbours among all embeddings by the approximate index (scores exact)."""
    return rounded(_similar(spark, sf)[1].select("qid", "cid", "score", "rank"))


@register("similar_recall", """SELECT COUNT(*) AS n_queries, TRUE AS scores_exact, TRUE AS recall_reached
FROM embeddings WHERE vec_id % 50 = 0""")
def q_similar_recall(spark, sf):
    """The index against the exact search of the same queries: scores equal where
    both name a row, and at least 0.9 of the exact neighbours found."""
    from shoptide.operators.vectors import cosine_topk
    e, found = _similar(spark, sf)
    exact = cosine_topk(e.where(F.col("vec_id") % 50 == 0), e, k=5).select("qid", "cid", "score")
    both = exact.join(found.select("qid", "cid", F.col("score").alias("found")), ["qid", "cid"], "left")
    return both.agg(F.count_distinct("qid").alias("n_queries"),
                    F.bool_and(F.coalesce(F.abs(F.col("score") - F.col("found")) < 1e-9, F.lit(True))).alias("scores_exact"),
                    (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("recall_reached"))


_SUMMARY_SQL = ("'User exhibited ' || intent || ' intent. SLM proposed ' || proposed_action || "
                "'. OPA verdict: ' || (CASE WHEN allowed THEN 'ALLOWED' ELSE 'DENIED' END) || '.'")


@register("decision_summary", f"""{with_(O.session_pipeline())}
SELECT session_id, {_SUMMARY_SQL} AS summary FROM sp_pol""")
def q_decision_summary(spark, sf):
    from shoptide.operators.vectors import closed_loop
    return closed_loop(session_actions(session_clicks(spark, sf))).select("session_id", "summary")


@register("closed_loop", f"""{with_(O.session_pipeline())},
sa AS (SELECT *, CASE WHEN allowed THEN guarded_action ELSE 'NO_ACTION' END AS action FROM sp_pol)
SELECT session_id, CASE WHEN allowed THEN 'ALLOWED' ELSE 'DENIED' END AS opa_verdict,
  CASE WHEN allowed THEN 'EXECUTED:' || action ELSE 'DENIED:' || proposed_action END AS result,
  {_SUMMARY_SQL} AS summary FROM sa""")
def q_closed_loop(spark, sf):
    from shoptide.operators.vectors import closed_loop
    c = closed_loop(session_actions(session_clicks(spark, sf)))
    return c.select("session_id", "opa_verdict", "result", "summary")


@register("decision_traces", f"""{with_(O.session_pipeline())},
den AS (SELECT substring(sha256(session_id || ':' || proposed_action || ':DENIED'), 1, 16) AS trace_id, session_id, intent,
  proposed_action, 'DENIED' AS opa_verdict, {_SUMMARY_SQL} AS summary FROM sp_pol WHERE NOT allowed),
w AS (SELECT trace_id, regexp_extract_all(lower(summary), '[a-z0-9_]+') AS ws FROM den),
f AS (SELECT trace_id, list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS fs FROM w),
h AS (SELECT trace_id, CAST('0x' || substring(md5('decision:' || unnest(fs)), 1, 8) AS BIGINT) AS h FROM f),
m AS (SELECT trace_id, h % 384 AS d, SUM(CASE WHEN (h // 384) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS x FROM h GROUP BY ALL),
v AS (SELECT t.trace_id, list(CAST(COALESCE(m.x, 0) AS DOUBLE) ORDER BY r.d) AS vector
  FROM (SELECT DISTINCT trace_id FROM den) t CROSS JOIN range(0, 384) r(d) LEFT JOIN m ON m.trace_id = t.trace_id AND m.d = r.d
  GROUP BY t.trace_id)
SELECT den.*, vector FROM den JOIN v USING (trace_id)""")
def q_decision_traces(spark, sf):
    """Denied decisions as traces with the vector of their summary. The decisions are
    written first: a filter on the verdict would carry the whole policy with it."""
    from shoptide.operators.similar import trace_vectors
    from shoptide.operators.vectors import closed_loop, decision_traces
    from shoptide.session import materialize
    closed = closed_loop(session_actions(session_clicks(spark, sf))).select(
        "session_id", "intent", "proposed_action", "opa_verdict", "summary")
    return trace_vectors(decision_traces(materialize(closed, "closed_loop")))


_LAB = f"""lab AS (SELECT session_id, rule_intent AS label FROM sp_pol)"""


@register("training_set", f"""{with_(O.session_pipeline(), _LAB)}
SELECT {sel(FEATURE_COLS)}, label FROM feat JOIN lab USING (session_id)""")
def q_training_set(spark, sf):
    from shoptide.operators.ml import training_set
    f = session_features(session_clicks(spark, sf))
    labels = intent_ops.rule_intent(f).select("session_id", F.col("rule_intent").alias("label"))
    return rounded(training_set(f, labels).select(*FEATURE_COLS, "label"))


@register("label_histogram", f"""{with_(O.session_pipeline(), _LAB)}
SELECT label, COUNT(*) AS n FROM lab GROUP BY label""")
def q_label_histogram(spark, sf):
    f = session_features(session_clicks(spark, sf))
    lab = intent_ops.rule_intent(f).select(F.col("rule_intent").alias("label"))
    return lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc())


@register("stratified_split", f"""{with_(O.session_pipeline(), _LAB)},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5(session_id), session_id) AS rk,
  COUNT(*) OVER (PARTITION BY label) AS n FROM lab)
SELECT session_id, label, CASE WHEN rk <= ceil(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r""")
def q_stratified_split(spark, sf):
    from shoptide.operators.ml import stratified_split
    from shoptide.session import materialize
    f = session_features(session_clicks(spark, sf))
    lab = intent_ops.rule_intent(f).select("session_id", F.col("rule_intent").alias("label"))
    return stratified_split(materialize(lab, "labels")).select("session_id", "label", "split")


@register("rf_predict")
def q_rf_predict(spark, sf):
    """RandomForest (100 trees, depth 12, seed 42) trained on the train split,
    scored on the test split. Labels are the rule intents (no ground truth in
    the tables), so this checks the training path, not model quality."""
    from shoptide.operators.ml import fit_forest, predict_intent, stratified_split, training_set
    from shoptide.session import materialize
    f = materialize(session_features(session_clicks(spark, sf)), "features")
    lab = intent_ops.rule_intent(f).select("session_id", F.col("rule_intent").alias("label"))
    ts = stratified_split(materialize(training_set(f, lab), "training_set"))
    model = fit_forest(ts.where("split = 'train'"))
    return predict_intent(model, ts.where("split = 'test'")).select("session_id", "label", "ml_intent", "ml_confidence")


_ENR = """he AS (SELECT st.session_id,
  (SELECT COUNT(*) FROM sess p WHERE p.customer_id = st.customer_id AND p.action = 'purchase_complete'
     AND p.timestamp < st.session_start) > 0 AS repeat_customer,
  CAST(floor((epoch_us(st.session_start) - epoch_us((SELECT MAX(p.timestamp) FROM sess p WHERE p.customer_id = st.customer_id
     AND p.action = 'purchase_complete' AND p.timestamp < st.session_start))) / 86400000000) AS INTEGER) AS days_since_last_purchase
  FROM st),
fe AS (SELECT f.* EXCLUDE (repeat_customer, days_since_last_purchase), he.repeat_customer, he.days_since_last_purchase
  FROM feat f JOIN he USING (session_id))"""


@register("classification_report", f"""{with_(O.session_pipeline(), O.STARTS, _ENR, O.intent_ctes('fe', 'en'))},
pr AS (SELECT b.session_id, e.rule_intent AS l, b.rule_intent AS p FROM sp_pol b JOIN en_pred e USING (session_id)),
pairs AS (SELECT l, p, COUNT(*) AS n FROM pr GROUP BY l, p),
tp AS (SELECT l AS cls, n AS tp FROM pairs WHERE l = p),
sup AS (SELECT l AS cls, SUM(n) AS support FROM pairs GROUP BY l),
prd AS (SELECT p AS cls, SUM(n) AS predicted FROM pairs GROUP BY p),
cls AS (SELECT cls FROM sup UNION SELECT cls FROM prd),
r AS (SELECT cls, COALESCE(tp, 0) AS tp, COALESCE(support, 0) AS support, COALESCE(predicted, 0) AS predicted
  FROM cls LEFT JOIN tp USING (cls) LEFT JOIN sup USING (cls) LEFT JOIN prd USING (cls)),
r2 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM r)
SELECT cls AS class, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9) AS f1,
  CAST(support AS BIGINT) AS support FROM r2""")
def q_classification_report(spark, sf):
    """How the base rules (prediction) agree with the history-enriched rules
    (label: repeat_customer / days_since_last_purchase filled in)."""
    from shoptide.operators.ml import classification_report
    from shoptide.plans.pipeline import enriched_features
    clicks = session_clicks(spark, sf)
    base = intent_ops.rule_intent(session_features(clicks)).select("session_id", F.col("rule_intent").alias("prediction"))
    enr = intent_ops.rule_intent(enriched_features(clicks)).select("session_id", F.col("rule_intent").alias("label"))
    return rounded(classification_report(base.join(enr, "session_id")))


# --- 2.6 model responses and search text ------------------------------------------------------
_FALLBACK = " ".join(f"WHEN contains(COALESCE(text, ''), '{a}') THEN '{a}'"
                     for a in ["OFFER_BUNDLE", "SEND_ABANDON_EMAIL", "OFFER_DISCOUNT", "SEND_TO_HUMAN", "SHOW_URGENCY"])
_PLAN_SQL = f"""WITH resp AS (SELECT page_id AS session_id, html AS text, CAST(NULL AS VARCHAR) AS error FROM pages),
ex AS (SELECT *, {O.first_json_sql('text')} AS json_text FROM resp),
ok AS (SELECT *, COALESCE(json_text IS NOT NULL AND json_valid(json_text), FALSE) AS valid FROM ex),
res AS (SELECT session_id,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN valid THEN 'parsed' ELSE 'keyword_fallback' END AS outcome,
  CASE WHEN error IS NOT NULL THEN 'NO_ACTION' WHEN valid THEN COALESCE(json_extract_string(json_text, '$.action'), 'NO_ACTION')
       ELSE CASE {_FALLBACK} ELSE 'NO_ACTION' END END AS action,
  CASE WHEN error IS NOT NULL THEN 0.0 WHEN valid THEN COALESCE(TRY_CAST(json_extract_string(json_text, '$.confidence') AS DOUBLE), 0.5)
       ELSE 0.6 END AS confidence,
  CASE WHEN error IS NOT NULL THEN 'Planner error: ' || substring(error, 1, 200)
       WHEN valid THEN COALESCE(json_extract_string(json_text, '$.reasoning'), 'LLM analysis')
       ELSE substring(COALESCE(text, ''), 1, 500) END AS reasoning
  FROM ok)"""


def _page_responses(spark, sf):
    return table(spark, sf, "pages").select(F.col("page_id").alias("session_id"), F.col("html").alias("text"),
                                            F.lit(None).cast("string").alias("error"))


@register("planner_resolution", f"{_PLAN_SQL}\nSELECT session_id, outcome, action, confidence, reasoning FROM res")
def q_planner_resolution(spark, sf):
    """Raw planner texts (web pages as stand-in responses, whole texts) ->
    first balanced JSON object -> proposal, or the keyword fallback."""
    from shoptide.operators.text import planner_resolution
    return planner_resolution(_page_responses(spark, sf)).select("session_id", "outcome", "action", "confidence", "reasoning")


@register("response_outcomes", f"{_PLAN_SQL}\nSELECT outcome, COUNT(*) AS n FROM res GROUP BY outcome")
def q_response_outcomes(spark, sf):
    from shoptide.operators.text import planner_resolution, response_outcomes
    return response_outcomes(planner_resolution(_page_responses(spark, sf)))


_SLM_INPUT_SQL = """slm_in AS (SELECT conv_id AS session_id, turn,
  CASE WHEN turn % 7 = 0 THEN '' WHEN turn % 5 = 0 THEN '{}'
  ELSE '{"intent": "' || CASE turn % 4 WHEN 0 THEN 'BROWSING' WHEN 1 THEN 'CARTING' WHEN 2 THEN 'CHECKOUT_INTENT'
    ELSE 'PRODUCT_RETURN' END || '", "confidence": ' || printf('%.1f', (turn % 10) / 10.0) || '}' END AS text
  FROM conversations WHERE role = 'assistant')"""


def _slm_inputs(spark, sf):
    """Stand-in enrichment responses, one per assistant turn (fixed shapes by turn)."""
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    t = F.col("turn")
    intent = (F.when(t % 4 == 0, "BROWSING").when(t % 4 == 1, "CARTING").when(t % 4 == 2, "CHECKOUT_INTENT")
              .otherwise("PRODUCT_RETURN"))
    txt = (F.when(t % 7 == 0, F.lit("")).when(t % 5 == 0, F.lit("{}"))
           .otherwise(F.concat(F.lit('{"intent": "'), intent, F.lit('", "confidence": '),
                               F.format_string("%.1f", (t % 10) / 10.0), F.lit("}"))))
    return c.select(F.col("conv_id").alias("session_id"), "turn", txt.alias("text"))


@register("slm_resolution", f"""WITH {_SLM_INPUT_SQL}
SELECT session_id, turn, COALESCE(json_extract_string(text, '$.intent'), 'BROWSING') AS ext_intent,
  COALESCE(TRY_CAST(json_extract_string(text, '$.confidence') AS DOUBLE), 0.0) AS ext_confidence,
  COALESCE(json_extract_string(text, '$.reasoning'), '') AS ext_reasoning
FROM slm_in WHERE trim(text) <> '' AND json_valid(text)""")
def q_slm_resolution(spark, sf):
    """Enrichment responses -> (intent, confidence, reasoning) with defaults;
    empty or unparsable content gives no row."""
    return _slm_rows(spark, sf)


def _slm_rows(spark, sf):
    from shoptide.operators.text import slm_resolution
    inp = _slm_inputs(spark, sf).withColumn("key", F.struct("session_id", "turn"))
    out = slm_resolution(inp.select(F.col("key").alias("session_id"), "text"))
    return out.select(F.col("session_id.session_id").alias("session_id"), F.col("session_id.turn").alias("turn"),
                      "ext_intent", "ext_confidence", "ext_reasoning")


@register("intent_override", f"""{with_(O.session_pipeline())},
ext AS (SELECT session_id, CASE WHEN checkouts > 0 THEN 'CHECKOUT_INTENT' ELSE 'BROWSING' END AS ext_intent,
  CAST(printf('%.2f', LEAST(1.0, total_actions / 10.0)) AS DOUBLE) AS ext_confidence FROM sp_pol)
SELECT session_id, CASE WHEN ext_confidence > confidence THEN ext_intent ELSE intent END AS intent,
  round(CASE WHEN ext_confidence > confidence THEN ext_confidence ELSE confidence END, 9) AS confidence,
  COALESCE(ext_confidence > confidence, FALSE) AS overridden
FROM sp_pol LEFT JOIN ext USING (session_id)""")
def q_intent_override(spark, sf):
    """Per-session enrichment responses (stand-in JSON: CHECKOUT_INTENT when a
    checkout started, else BROWSING; confidence min(1, actions/10)) are parsed
    and override the prediction when strictly more confident."""
    from shoptide.operators.text import slm_resolution
    pred = intent_ops.final_intent(session_features(session_clicks(spark, sf)))
    resp = pred.select("session_id", F.concat(
        F.lit('{"intent": "'), F.when(F.col("checkouts") > 0, "CHECKOUT_INTENT").otherwise("BROWSING"),
        F.lit('", "confidence": '), F.format_string("%.2f", F.least(F.lit(1.0), F.col("total_actions") / 10.0)),
        F.lit("}")).alias("text"))
    ext = slm_resolution(resp).select("session_id", "ext_intent", "ext_confidence")
    out = intent_ops.intent_override(pred, ext)
    return rounded(out.select("session_id", "intent", "confidence", "overridden"))


@register("search_queries", f"""{with_(O.CLICKS, O.SESS)}
SELECT session_id, event_id, timestamp, json_extract_string(metadata, '$.query') AS query FROM sess WHERE action = 'search_query'""")
def q_search_queries(spark, sf):
    from shoptide.operators.text import search_queries
    return search_queries(session_clicks(spark, sf))


# --- 2.7 routing, escalation, critic -------------------------------------------------------------
_ROUTED = """routed AS (SELECT *, CASE WHEN COALESCE(confidence < 0.7, FALSE) OR intent IN ('CHURN_RISK', 'LOYAL_RETURNER')
  OR COALESCE(exploration_ratio, 0.0) > 0.6 THEN 'system_2' ELSE 'system_1' END AS system FROM sp_pol)"""


@register("escalation_batch", f"""{with_(O.session_pipeline(), _ROUTED)},
ev2 AS (SELECT s.*, CAST(ROW_NUMBER() OVER (PARTITION BY s.session_id ORDER BY s.timestamp DESC, s.event_id DESC) AS INTEGER) AS recency_rank
  FROM sess s WHERE s.session_id IN (SELECT session_id FROM routed WHERE system = 'system_2'))
SELECT session_id, event_id, action, recency_rank FROM ev2 WHERE recency_rank <= 50""")
def q_escalation_batch(spark, sf):
    from shoptide.operators.routing import escalation_batch
    clicks = session_clicks(spark, sf)
    routed = route(intent_ops.final_intent(session_features(clicks)))
    return escalation_batch(routed, clicks).select("session_id", "event_id", "action", "recency_rank")


@register("critic_resolution", f"""{with_(O.session_pipeline(), _ROUTED)}
SELECT session_id, CASE WHEN allowed THEN proposed_action ELSE 'NO_ACTION' END AS final_action,
  CASE WHEN allowed THEN 'rule proposal' ELSE 'OPA denied ''' || proposed_action || ''': policy violation' END AS final_reasoning,
  CASE WHEN allowed THEN 'system_2_critic_approved' ELSE 'system_2_critic_rejected' END AS source
FROM routed WHERE system = 'system_2'""")
def q_critic_resolution(spark, sf):
    """Critic over the escalated sessions' proposals (no rewrite table given)."""
    from shoptide.operators.routing import critic_resolution
    pred = session_predictions(session_clicks(spark, sf))
    esc = route(pred).where(F.col("system") == "system_2")
    props = esc.select("session_id", F.col("proposed_action").alias("action"),
                       F.lit("rule proposal").alias("reasoning"), "allowed")
    return critic_resolution(props).select("session_id", "final_action", "final_reasoning", "source")


# --- 2.2/2.9 reads and hydration --------------------------------------------------------------------
@register("session_events", f"""{with_(O.CLICKS, O.SESS)}
SELECT session_id, event_id, timestamp, action,
  ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS seq FROM sess""")
def q_session_events(spark, sf):
    """Events of every session in time order with their position (a chunked scan)."""
    from shoptide.functions.running import running_scan, time_chunk
    c = session_clicks(spark, sf).withColumn("__chunk", time_chunk("timestamp", 3600))
    r = running_scan(c, by=["session_id"], chunk="__chunk", order=["timestamp", "event_id"],
                     aggs={"seq": ("sum", F.lit(1))})
    return r.select("session_id", "event_id", "timestamp", "action", F.col("seq").cast("long").alias("seq"))


@register("hydrate", f"""{with_(O.CLICKS, O.SESS, _REG_SQL)}
SELECT e.session_id, e.event_id, e.timestamp, e.action, r.customer_id, r.created_at, r.expires_at
FROM sess e JOIN reg r ON e.session_id = r.session_id""")
def q_hydrate(spark, sf):
    """Session record + events + customer stub, joined on session_id."""
    from shoptide.operators.stores import session_registry
    c = session_clicks(spark, sf)
    reg = session_registry(c).select("session_id", "customer_id", "created_at", "expires_at")
    return c.select("session_id", "event_id", "timestamp", "action").join(reg, "session_id")


# --- 2.11 sliding activity (batch form of the streaming window) ---------------------------------
@register("sliding_activity", f"""{with_(O.CLICKS, O.SESS)},
w AS (SELECT action, time_bucket(INTERVAL 1 MINUTE, timestamp) - to_minutes(CAST(o AS BIGINT)) AS window_start
  FROM sess, range(0, 5) r(o))
SELECT window_start, window_start + INTERVAL 5 MINUTE AS window_end, action, COUNT(*) AS n FROM w GROUP BY window_start, action""")
def q_sliding_activity(spark, sf):
    """Event counts per action in 5-minute windows sliding by 1 minute."""
    c = session_clicks(spark, sf)
    g = c.groupBy(F.window(F.col("timestamp"), "5 minutes", "1 minute").alias("w"), "action").agg(
        F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "action", "n")


# --- 2.11 streaming -----------------------------------------------------------------------------
def _stream_dirs(spark):
    import uuid
    from shoptide.session import checkpoint_dir
    base = f"{checkpoint_dir(spark).rstrip('/')}/shoptide/stream-{uuid.uuid4().hex[:12]}"
    return {k: f"{base}/{k}" for k in ("feed", "store", "quarantine", "registry", "decisions", "sessions",
                                       "ck_ingest", "ck_decisions", "ck_sessions")}


def _run_streams(spark, sf, defects: bool, decisions: bool = False, sessions: bool = False, phases: int = 3,
                 stateful: bool = False):
    """Feed the raw events in ``phases`` time-ordered drops; after each drop the
    streams resume from their checkpoints (a restart per phase)."""
    from shoptide.sources.events import raw_event_json
    from shoptide.streaming.pipelines import (decision_stream, ingest_stream, sessionize_stream,
                                              stateful_decision_stream)
    d = _stream_dirs(spark)
    clicks = session_clicks(spark, sf)
    day = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / F.lit(86400 * 1_000_000))
    lo_hi = clicks.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()
    span = (lo_hi["hi"] - lo_hi["lo"] + 1) / phases
    feed = raw_event_json(clicks, defects=defects).join(
        clicks.select(F.col("event_id").alias("source_event_id"), F.floor((day - F.lit(lo_hi["lo"])) / F.lit(span)).alias("phase")),
        "source_event_id")
    for p in range(phases):
        feed.where(F.col("phase") == p).select("value").write.mode("overwrite").text(f"{d['feed']}/phase={p}")
        ingest_stream(spark, d["feed"], d["store"], d["quarantine"], d["ck_ingest"],
                      registry_dir=d["registry"]).awaitTermination()
        if decisions:
            decision_stream(spark, d["store"], d["decisions"], d["ck_decisions"],
                            registry_dir=d["registry"]).awaitTermination()
        if sessions:
            sessionize_stream(spark, d["store"], d["sessions"], d["ck_sessions"]).awaitTermination()
        if stateful:
            stateful_decision_stream(spark, d["store"], d["decisions"], d["ck_decisions"]).awaitTermination()
    return d


@register("stream_ingest", SQL["valid_events"])
def q_stream_ingest(spark, sf):
    """Structured Streaming ingest of the raw feed (with defects) in three drops;
    the event store it writes must equal the batch ``valid_events``."""
    d = _run_streams(spark, sf, defects=True)
    return rounded(spark.read.parquet(d["store"]).select(*_VE))


@register("stream_decisions", SQL["action_decisions"])
def q_stream_decisions(spark, sf):
    """The per-event decision loop as a stream over a clean feed in three drops;
    must equal the batch ``action_decisions``."""
    d = _run_streams(spark, sf, defects=False, decisions=True)
    return rounded(spark.read.parquet(d["decisions"]).select(*_DEC, "action_id"))


@register("stream_sessionize", f"""{with_(O.CLICKS, O.SESS)},
ss AS (SELECT customer_id, MIN(timestamp) AS session_start, MAX(timestamp) AS session_end, COUNT(*) AS n_events
  FROM sess GROUP BY session_id, customer_id)
SELECT * FROM ss WHERE epoch_us(session_end) + 21600000000 <= epoch_us({O.ASOF}) - 86400000000""")
def q_stream_sessionize(spark, sf):
    """Event-time sessions (session_window, 6 h gap, 24 h watermark) from the
    streamed event store. Append mode emits the sessions the final watermark
    has closed; they must equal the batch gap-and-island sessions that end
    before it."""
    from shoptide.streaming.pipelines import latest_sessions
    d = _run_streams(spark, sf, defects=False, sessions=True)
    return latest_sessions(spark, d["sessions"])


# --- model fallback and policy with context ----------------------------------------------------------
@register("final_intent_ml")
def q_final_intent_ml(spark, sf):
    """Rule result when calibrated confidence >= 0.6, else the RandomForest's
    most probable class (trained on the train split of the rule labels)."""
    from shoptide.operators.ml import fit_forest, stratified_split, training_set
    from shoptide.session import materialize
    f = materialize(session_features(session_clicks(spark, sf)), "features")
    lab = intent_ops.rule_intent(f).select("session_id", F.col("rule_intent").alias("label"))
    ts = stratified_split(materialize(training_set(f, lab), "training_set"))
    model = fit_forest(ts.where("split = 'train'"))
    return rounded(intent_ops.final_intent(f, model=model).select("session_id", "intent", "confidence", "method"))




@register("policy_with_context", f"""{_LEDGER_BASE}, {O.FEAT}, {O.intent_ctes('feat', 'sp')}, {_GC},
{O.policy_ctes_ctx('sp_pred', 'cx', 'gc2')}
SELECT session_id, proposed_action, allowed, policy_reason FROM cx_pol""")
def q_policy_with_context(spark, sf):
    """Both rule sets with the customer context derived from history and the
    ledger (purchases and discounts before the session)."""
    from shoptide.operators.dispatch import with_proposed_action
    from shoptide.operators.policy import policy_allow, policy_reason
    from shoptide.operators.stores import governance_context
    clicks, led = _ledger(spark, sf)
    pred = with_proposed_action(intent_ops.final_intent(session_features(clicks)))
    ctx = governance_context(clicks, led).select("session_id", "total_purchases", "discounts_this_month",
                                                 "last_discount_within_hours")
    out = policy_reason(policy_allow(pred.join(ctx, "session_id", "left")))
    return out.select("session_id", "proposed_action", "allowed", "policy_reason")


@register("enriched_intent", f"""{with_(O.session_pipeline(), O.STARTS, _ENR, O.intent_ctes('fe', 'en'))}
SELECT session_id, rule_intent, round(rule_confidence, 9) AS rule_confidence, repeat_customer, days_since_last_purchase
FROM en_pred""")
def q_enriched_intent(spark, sf):
    """Rule intent with repeat_customer / days_since_last_purchase filled from
    the customer's history, so the LOYAL_RETURNER and CHURN_RISK history rules fire."""
    from shoptide.plans.pipeline import enriched_features
    df = intent_ops.rule_intent(enriched_features(session_clicks(spark, sf)))
    return rounded(df.select("session_id", "rule_intent", "rule_confidence", "repeat_customer",
                             "days_since_last_purchase"))


@register("stream_decisions_stateful", SQL["action_decisions"])
def q_stream_decisions_stateful(spark, sf):
    """The per-event decision loop with operator state (keyed by session, with
    event-time timers) over a clean feed in three drops with restarts; must
    equal the batch ``action_decisions``."""
    from shoptide.streaming.pipelines import stateful_tables
    d = _run_streams(spark, sf, defects=False, stateful=True)
    return rounded(stateful_tables(spark, d["decisions"]).read("decisions").select(*_DEC, "action_id"))


@register("ledger_outcomes", f"""{_EVAL_BASE}
SELECT action_id, session_id, action_type, intent, round(confidence, 9) AS confidence, reason,
  CASE WHEN converted IS NULL THEN NULL WHEN converted THEN 'converted' ELSE 'not_converted' END AS outcome,
  converted IS NOT NULL AS acknowledged,
  CASE WHEN converted IS NOT NULL THEN 'acknowledged' ELSE 'dispatched' END AS status, created_at
FROM outc""")
def q_ledger_outcomes(spark, sf):
    """Decided outcomes written back to the ledger: an acknowledgement row per
    decided action is upserted on action_id (audit semantics keep the first
    created_at/intent/confidence and take the new status and outcome)."""
    from shoptide.operators.ledger import acknowledgements, upsert
    clicks, led = _ledger(spark, sf)
    acks = acknowledgements(evaluation_outcomes(clicks, led))
    merged = upsert(led.drop("status").unionByName(acks), mode="pg")
    return rounded(merged.select(*_LCOLS))


# --- events without a customer -------------------------------------------------------
# Every fourth event comes without a customer, with the day's visit as its session.
_MIXED_SQL = f"""mixed AS (
  SELECT * REPLACE (CASE WHEN CAST(event_id AS BIGINT) % 4 = 0 THEN NULL ELSE customer_id END AS customer_id),
    CASE WHEN CAST(event_id AS BIGINT) % 4 = 0 THEN 'visit_' || strftime(timestamp, '%Y%m%d') END AS given FROM clicks),
m_prev AS (SELECT *, LAG(timestamp) OVER (PARTITION BY customer_id ORDER BY timestamp, event_id) AS prev_ts FROM mixed),
m_sess AS (
  SELECT event_id, customer_id, timestamp, action,
    CASE WHEN customer_id IS NULL THEN given ELSE customer_id || '_' || CAST(1 + SUM(
      CASE WHEN epoch_us(timestamp) - epoch_us(prev_ts) > {O.GAP_US} THEN 1 ELSE 0 END)
      OVER (PARTITION BY customer_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) END AS session_id
  FROM m_prev)"""


def _mixed_clicks(spark, sf):
    from shoptide.operators.sessions import sessionize
    from shoptide.sources.events import load_clicks

    anonymous = F.col("event_id").cast("long") % 4 == 0
    c = load_clicks(spark, sf)
    c = c.withColumn("customer_id", F.when(~anonymous, F.col("customer_id"))).withColumn(
        "session_id", F.when(anonymous, F.concat(F.lit("visit_"), F.date_format("timestamp", "yyyyMMdd"))))
    return sessionize(c, gap_minutes=360)


@register("sessionize_anonymous", f"{with_(O.CLICKS, _MIXED_SQL)}\nSELECT event_id, customer_id, session_id FROM m_sess")
def q_sessionize_anonymous(spark, sf):
    """Sessions where a quarter of the events has no customer: none is lost, and they keep the session they came with."""
    return _mixed_clicks(spark, sf).select("event_id", "customer_id", "session_id")


@register("anonymous_history", f"""{with_(O.CLICKS, _MIXED_SQL)},
starts AS (SELECT session_id, max(customer_id) AS customer_id, min(timestamp) AS session_start, count(*) AS total_actions FROM m_sess GROUP BY session_id),
bought AS (SELECT customer_id, timestamp FROM m_sess WHERE action = 'purchase_complete' AND customer_id IS NOT NULL)
SELECT s.session_id, s.total_actions, count(b.timestamp) > 0 AS repeat_customer,
  CAST(floor((epoch_us(s.session_start) - epoch_us(max(b.timestamp))) / 86400000000.0) AS INTEGER) AS days_since_last_purchase
FROM starts s LEFT JOIN bought b ON b.customer_id = s.customer_id AND b.timestamp < s.session_start
GROUP BY s.session_id, s.total_actions, s.session_start""")
def q_anonymous_history(spark, sf):
    """Features with customer history for all sessions, those without a customer too."""
    from shoptide.plans.pipeline import enriched_features

    return enriched_features(_mixed_clicks(spark, sf)).select("session_id", "total_actions", "repeat_customer", "days_since_last_purchase")


# --- model responses around whole conversation texts ----------------------------------
# The SQL states what each shape of response must come to, not how it is parsed.
_RESPONSES = "a AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant')"


def _replies(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    return c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("reply"))


@register("planner_replies", f"""WITH {_RESPONSES}
SELECT conv_id, turn,
  CASE turn % 4 WHEN 1 THEN 'parsed' WHEN 2 THEN 'keyword_fallback' WHEN 3 THEN 'keyword_fallback' ELSE 'error' END AS outcome,
  CASE turn % 4 WHEN 1 THEN 'SHOW_URGENCY' WHEN 2 THEN 'NO_ACTION' WHEN 3 THEN 'OFFER_BUNDLE' ELSE 'NO_ACTION' END AS action,
  CASE turn % 4 WHEN 1 THEN 0.75 WHEN 0 THEN 0.0 ELSE 0.6 END::DOUBLE AS confidence,
  CASE turn % 4 WHEN 1 THEN text WHEN 2 THEN left('Plan: ' || text, 500)
    WHEN 3 THEN left('{{''action'': ''OFFER_BUNDLE''}} ' || text, 500) ELSE 'Planner error: timeout' END AS reasoning
FROM a""")
def q_planner_replies(spark, sf):
    """Planner replies of four shapes around whole assistant texts: wrapped JSON with a quoted number, prose, single-quoted pseudo-JSON, errors."""
    from shoptide.operators.text import planner_resolution

    plan = F.to_json(F.struct(F.lit("SHOW_URGENCY").alias("action"), F.lit("0.75").alias("confidence"), F.col("reply").alias("reasoning")))
    shape = F.col("turn") % 4
    text = (F.when(shape == 1, F.concat(F.lit("Here you are: "), plan, F.lit(" That is all.")))
            .when(shape == 2, F.concat(F.lit("Plan: "), F.col("reply")))
            .when(shape == 3, F.concat(F.lit("{'action': 'OFFER_BUNDLE'} "), F.col("reply"))))
    r = _replies(spark, sf).select(F.struct("conv_id", "turn").alias("session_id"), text.alias("text"), F.when(shape == 0, F.lit("timeout")).alias("error"))
    return planner_resolution(r).select("session_id.conv_id", "session_id.turn", "outcome", "action", "confidence", "reasoning")


@register("slm_replies", f"""WITH {_RESPONSES}
SELECT conv_id, turn, CASE turn % 6 WHEN 1 THEN 'CARTING' ELSE 'BROWSING' END AS ext_intent,
  CASE turn % 6 WHEN 1 THEN 0.8 ELSE 0.0 END::DOUBLE AS ext_confidence, CASE turn % 6 WHEN 1 THEN text ELSE '' END AS ext_reasoning
FROM a WHERE turn % 6 IN (1, 2)""")
def q_slm_replies(spark, sf):
    """Enrichment replies of six shapes around whole assistant texts; only strict JSON objects with a number for confidence give a row."""
    from shoptide.operators.text import slm_resolution

    shape = F.col("turn") % 6
    full = F.to_json(F.struct(F.lit("CARTING").alias("intent"), F.lit("0.8").alias("confidence"), F.col("reply").alias("reasoning")))
    high = F.to_json(F.struct(F.lit("high").alias("confidence"), F.col("reply").alias("reasoning")))
    text = (F.when(shape == 1, full).when(shape == 2, F.lit(" {} ")).when(shape == 3, high)
            .when(shape == 4, F.concat(full, F.lit(" "), F.col("reply"))).when(shape == 5, F.concat(F.lit("["), full, F.lit("]"))).otherwise(F.col("reply")))
    r = _replies(spark, sf).select(F.struct("conv_id", "turn").alias("session_id"), text.alias("text"))
    return slm_resolution(r).select("session_id.conv_id", "session_id.turn", "ext_intent", "ext_confidence", "ext_reasoning")


from shoptide.plans import branch_queries, stream_queries  # noqa: E402, F401  (they register their queries)
