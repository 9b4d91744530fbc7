"""Schemas, closed vocabularies and fixed constants of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Click event as ingested (JSON/CSV/Kafka). ``metadata`` is an open JSON map.
CLICK_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("action", T.StringType()),
        T.StructField("product_id", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("metadata", T.StringType()),
    ]
)

# --- fixed values: vocabularies that must equal the reference's ---------------
# Event actions.
PAGE_VIEW = "page_view"
ADD_TO_CART = "add_to_cart"
REMOVE_FROM_CART = "remove_from_cart"
CHECKOUT_START = "checkout_start"
PURCHASE_COMPLETE = "purchase_complete"
SEARCH_QUERY = "search_query"
FILTER_APPLY = "filter_apply"
EVENT_ACTIONS = [
    PAGE_VIEW, ADD_TO_CART, REMOVE_FROM_CART, CHECKOUT_START,
    PURCHASE_COMPLETE, SEARCH_QUERY, FILTER_APPLY,
]

# Intent classes, in the reference's declaration order.
INTENTS = [
    "BROWSE", "COMPARE", "CART_BUILDER", "CHECKOUT_INTENT",
    "PRICE_SENSITIVE", "CHURN_RISK", "LOYAL_RETURNER",
]

# Intent -> proposed action; anything else proposes NO_ACTION.
ACTION_MAP = {
    "BROWSE": "RECOMMEND_ALTERNATIVE",
    "COMPARE": "SHOW_COMPARISON_TOOL",
    "CART_BUILDER": "APPLY_DISCOUNT",
    "CHECKOUT_INTENT": "SHOW_URGENCY",
    "PRICE_SENSITIVE": "APPLY_DISCOUNT",
    "CHURN_RISK": "SEND_ABANDON_EMAIL",
    "LOYAL_RETURNER": "LOYALTY_REWARD",
}
NO_ACTION = "NO_ACTION"

# Actions the policy always allows.
ALWAYS_ALLOWED = [
    "NO_ACTION", "LOG_ANALYTICS", "RECOMMEND_PRODUCT", "OFFER_BUNDLE",
    "SEND_TO_HUMAN", "LOYALTY_REWARD", "RECOMMEND_ALTERNATIVE",
]

# Feature order of the model's input vector.
FEATURE_ORDER = [
    "session_duration_sec", "total_actions", "page_views", "cart_adds",
    "cart_removes", "checkouts", "searches", "total_cart_value",
    "max_item_value", "avg_item_value", "categories_viewed",
    "category_switches", "cart_conversion_rate", "checkout_conversion_rate",
    "cart_abandon_rate", "exploration_ratio", "cart_value_per_minute",
    "avg_inter_event_time",
]

# Markov chain: states, action -> state, and the fixed transition rows.
MARKOV_ACTION_TO_STATE = {
    "page_view": "BROWSING",
    "search_query": "COMPARING",
    "add_to_cart": "CARTING",
    "remove_from_cart": "BROWSING",
    "checkout_start": "CHECKOUT",
    "purchase_complete": "PURCHASE",
}
MARKOV_TRANSITIONS = {
    "LANDING": {"BROWSING": 0.7, "EXIT": 0.3},
    "BROWSING": {"BROWSING": 0.5, "COMPARING": 0.2, "CARTING": 0.1, "EXIT": 0.2},
    "COMPARING": {"COMPARING": 0.4, "CARTING": 0.3, "BROWSING": 0.2, "EXIT": 0.1},
    "CARTING": {"CARTING": 0.4, "CHECKOUT": 0.3, "BROWSING": 0.2, "EXIT": 0.1},
    "CHECKOUT": {"PURCHASE": 0.6, "CARTING": 0.2, "EXIT": 0.2},
    "PURCHASE": {"EXIT": 0.8, "BROWSING": 0.2},
}
# Boost per occurrence in the history: action -> (state, increment).
MARKOV_BOOSTS = [
    ("add_to_cart", "CARTING", 0.2),
    ("checkout_start", "CHECKOUT", 0.3),
    ("search_query", "COMPARING", 0.1),
]

# Search keyword signals (lower-case substring match).
KEYWORD_SIGNALS = {
    "price_sensitive": ["cheap", "discount", "sale", "deal", "price"],
    "brand_loyal": ["nike", "adidas", "apple", "sony"],
    "comparison_shopping": ["best", "compare", "vs", "versus", "top"],
    "urgency": ["now", "today", "urgent", "asap", "fast"],
}

# Thresholds and windows.
CALIBRATION_A = 5.0
CALIBRATION_B = -2.5
RULE_CONFIDENCE_THRESHOLD = 0.6
ROUTE_CONFIDENCE_THRESHOLD = 0.70
ROUTE_EXPLORATION_THRESHOLD = 0.6
ESCALATE_INTENTS = ["CHURN_RISK", "LOYAL_RETURNER"]
COOLDOWN_MINUTES = 15
CONVERSION_WINDOW_MINUTES = 15
OBSERVATION_GRACE_MINUTES = 5
CONVERSION_ACTIONS = ["checkout_start", "purchase_complete"]
DRIFT_HISTORY = 20
DRIFT_THRESHOLD = 0.20
COLD_START_RATE = 0.10
COLD_START_MIN_ACTIONS = 10
SESSION_TTL_HOURS = 24
BOUNDED_HISTORY = 100
ESCALATION_CONTEXT = 50
EVALUATION_BATCH = 100
# -----------------------------------------------------------------------------
