"""DuckDB restatement of the jobs, as CTE fragments, for the correctness oracle.

Each registered query has an SQL twin built from these fragments. They are an
independent statement of the semantics (window functions, recursive CTE for the
cooldown chain) over the same parquet tables, not generated from the Spark plan.
Double results are rounded to 9 digits on both sides.
"""

from __future__ import annotations

from shoptide.schema import ACTION_MAP, ALWAYS_ALLOWED, INTENTS, MARKOV_BOOSTS, MARKOV_TRANSITIONS

GAP_US = 360 * 60 * 1_000_000
RUN = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def q(items: list[str]) -> str:
    return ", ".join(f"'{i}'" for i in items)


CLICKS = """clicks AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS customer_id, ts AS timestamp,
    CASE event_type
      WHEN 'view' THEN 'page_view'
      WHEN 'click' THEN CASE WHEN k % 2 = 0 THEN 'add_to_cart' ELSE 'search_query' END
      WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'purchase_complete' ELSE 'checkout_start' END
      WHEN 'error' THEN 'remove_from_cart'
      WHEN 'signup' THEN 'filter_apply'
      ELSE event_type END AS action,
    'p' || CAST(k AS VARCHAR) AS product_id,
    'cat_' || CAST(k % 5 AS VARCHAR) AS category,
    value, props AS metadata
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e)"""

SESS = f"""s_prev AS (
  SELECT *, LAG(timestamp) OVER (PARTITION BY customer_id ORDER BY timestamp, event_id) AS prev_ts FROM clicks),
sess AS (
  SELECT event_id, customer_id, timestamp, action, product_id, category, value, metadata,
    customer_id || '_' || CAST(1 + SUM(CASE WHEN epoch_us(timestamp) - epoch_us(prev_ts) > {GAP_US} THEN 1 ELSE 0 END)
      OVER (PARTITION BY customer_id ORDER BY timestamp, event_id {RUN}) AS VARCHAR) AS session_id
  FROM s_prev)"""

EV = """ev AS (
  SELECT session_id, customer_id, timestamp, event_id, action, metadata,
    CASE WHEN category IS NULL OR category = '' THEN 'unknown' ELSE category END AS category,
    COALESCE(value, 0.0) AS value
  FROM sess)"""

COUNTERS = {
    "page_views": "page_view", "cart_adds": "add_to_cart", "cart_removes": "remove_from_cart",
    "checkouts": "checkout_start", "searches": "search_query", "purchases": "purchase_complete",
}


def derived(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *,
    CASE WHEN total_actions > 1 THEN session_duration_sec / (total_actions - 1) ELSE 0.0 END AS avg_inter_event_time,
    total_cart_value / total_actions AS avg_item_value,
    total_cart_value / (session_duration_sec / 60.0 + 1.0) AS cart_value_per_minute,
    CAST(cart_adds AS DOUBLE) / GREATEST(CAST(page_views AS DOUBLE), 1.0) AS cart_conversion_rate,
    CAST(checkouts AS DOUBLE) / GREATEST(CAST(cart_adds AS DOUBLE), 1.0) AS checkout_conversion_rate,
    CASE WHEN cart_adds > 0 THEN CAST(cart_removes AS DOUBLE) / CAST(cart_adds AS DOUBLE) ELSE 0.0 END AS cart_abandon_rate,
    GREATEST(0.0, LEAST(1.0, CAST(category_switches AS DOUBLE) / GREATEST(CAST(page_views AS DOUBLE), 1.0))) AS exploration_ratio,
    FALSE AS repeat_customer, CAST(NULL AS INTEGER) AS days_since_last_purchase
  FROM (SELECT *, (epoch_us(session_end) - epoch_us(session_start)) / 1e6 AS session_duration_sec FROM {src}) d)"""


_counts_sql = ",\n    ".join(
    f"CAST(SUM(CASE WHEN action = '{a}' THEN 1 ELSE 0 END) AS BIGINT) AS {n}" for n, a in COUNTERS.items()
)

FEAT = f"""ev_lag AS (
  SELECT *, LAG(category) OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS prev_cat FROM ev),
feat0 AS (
  SELECT session_id, first(customer_id ORDER BY timestamp, event_id) AS customer_id,
    MIN(timestamp) AS session_start, MAX(timestamp) AS session_end,
    COUNT(*) AS total_actions,
    {_counts_sql},
    SUM(value) AS total_cart_value, MAX(value) AS max_item_value,
    COUNT(DISTINCT category) AS categories_viewed,
    CAST(SUM(CASE WHEN category <> prev_cat THEN 1 ELSE 0 END) AS BIGINT) AS category_switches
  FROM ev_lag GROUP BY session_id),
{derived("feat0", "feat")}"""

_run_counts = ",\n    ".join(
    f"CAST(SUM(CASE WHEN action = '{a}' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS {n}" for n, a in COUNTERS.items()
)

RUNFEAT = f"""rf_base AS (
  SELECT *, LAG(category) OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS prev_cat,
    CASE WHEN ROW_NUMBER() OVER (PARTITION BY session_id, category ORDER BY timestamp, event_id) = 1 THEN 1 ELSE 0 END AS new_cat
  FROM ev),
rf0 AS (
  SELECT session_id, event_id, customer_id, timestamp, action, category, value,
    COUNT(*) OVER w AS total_actions,
    {_run_counts},
    SUM(value) OVER w AS total_cart_value, MAX(value) OVER w AS max_item_value,
    CAST(SUM(new_cat) OVER w AS BIGINT) AS categories_viewed,
    CAST(SUM(CASE WHEN category <> prev_cat THEN 1 ELSE 0 END) OVER w AS BIGINT) AS category_switches,
    MIN(timestamp) OVER w AS session_start, timestamp AS session_end
  FROM rf_base
  WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_id {RUN})),
{derived("rf0", "rfeat")}"""


def _pts(cond: str, p: int) -> str:
    return f"(CASE WHEN {cond} THEN {p} ELSE 0 END)"


SCORE_SQL = {
    "BROWSE": _pts("page_views > 5 AND cart_adds = 0", 3) + " + " + _pts("exploration_ratio > 0.5", 2),
    "COMPARE": _pts("categories_viewed > 3 AND cart_adds = 0", 3) + " + " + _pts("page_views > cart_adds * 3", 2),
    "CART_BUILDER": _pts("cart_adds > cart_removes AND total_cart_value > 50", 3) + " + "
    + _pts("cart_conversion_rate > 0.3", 2),
    "CHECKOUT_INTENT": _pts("checkouts > 0", 4) + " + " + _pts("total_cart_value > 100 AND exploration_ratio < 0.3", 2),
    "PRICE_SENSITIVE": _pts("searches > 3", 3) + " + " + _pts("cart_abandon_rate > 0.5", 2),
    "CHURN_RISK": _pts("session_duration_sec > 600 AND cart_adds = 0", 2) + " + " + _pts("days_since_last_purchase > 30", 3),
    "LOYAL_RETURNER": _pts("repeat_customer", 3) + " + " + _pts("avg_inter_event_time < 30 AND total_cart_value > 100", 2),
}


def sc(i: str) -> str:
    return f"score_{i.lower()}"


def intent_ctes(src: str, prefix: str) -> str:
    """scores -> rule intent -> calibrated -> final (no model) -> proposed action."""
    scores = ",\n    ".join(f"{SCORE_SQL[i]} AS {sc(i)}" for i in INTENTS)
    total = " + ".join(sc(i) for i in INTENTS)
    best = "GREATEST(" + ", ".join(sc(i) for i in INTENTS) + ")"
    pick = " ".join(f"WHEN {sc(i)} = best_score THEN '{i}'" for i in sorted(INTENTS, reverse=True))
    amap = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTION_MAP.items())
    return f"""{prefix}_sc AS (SELECT *, {scores} FROM {src}),
{prefix}_ri AS (
  SELECT *, CASE WHEN total_score = 0 THEN 'BROWSE' ELSE CASE {pick} END END AS rule_intent,
    CASE WHEN total_score = 0 THEN 0.0 ELSE LEAST(CAST(best_score AS DOUBLE) / CAST(total_score AS DOUBLE), 1.0) END AS rule_confidence
  FROM (SELECT *, {total} AS total_score, {best} AS best_score FROM {prefix}_sc) x),
{prefix}_pred AS (
  SELECT *, 1.0 / (1.0 + exp(-(5.0 * rule_confidence + (-2.5)))) AS calibrated_confidence,
    rule_intent AS intent, 1.0 / (1.0 + exp(-(5.0 * rule_confidence + (-2.5)))) AS confidence,
    'rule_based' AS method,
    CASE rule_intent {amap} ELSE 'NO_ACTION' END AS proposed_action
  FROM {prefix}_ri)"""


# Policy inputs that the pipeline does not supply are absent (NULL).
ABSENT_CTX = """CAST(NULL AS INTEGER) AS discounts_this_month, CAST(NULL AS DOUBLE) AS last_discount_within_hours,
    CAST(NULL AS INTEGER) AS total_purchases, CAST(NULL AS VARCHAR) AS customer_segment,
    CAST(NULL AS INTEGER) AS inventory_level, CAST(NULL AS VARCHAR) AS feature_intent,
    CAST(NULL AS VARCHAR) AS feature_segment, 0.0 AS discount_value"""


def allow_sql(a: str = "proposed_action", intent: str = "COALESCE(intent, '')") -> str:
    disc = f"{a} IN ('APPLY_DISCOUNT', 'OFFER_DISCOUNT')"
    deny = " OR ".join([
        f"COALESCE({disc} AND last_discount_within_hours < 24, FALSE)",
        f"COALESCE({disc} AND customer_segment <> feature_segment, FALSE)",
        f"COALESCE({a} = 'ISSUE_DISCOUNT' AND discount_value > 20, FALSE)",
        f"COALESCE({a} = 'ISSUE_DISCOUNT' AND {intent} = 'BROWSING', FALSE)",
    ])
    rules = " OR ".join([
        f"COALESCE({disc} AND discounts_this_month < 3 AND total_purchases > 0 AND total_cart_value > 50, FALSE)",
        f"COALESCE({a} = 'ISSUE_DISCOUNT' AND discount_value <= 20 AND {intent} <> 'BROWSING', FALSE)",
        f"COALESCE({a} = 'SHOW_URGENCY' AND inventory_level < 10 AND feature_intent = 'CHECKOUT_INTENT', FALSE)",
        f"COALESCE({a} = 'SEND_ABANDON_EMAIL' AND session_duration_sec > 300 AND cart_adds > 0 AND checkouts = 0, FALSE)",
    ])
    return f"(COALESCE({a} IN ({q(ALWAYS_ALLOWED)}), FALSE) OR (NOT ({deny}) AND ({rules})))"


def reason_sql(a: str = "proposed_action") -> str:
    d, u, m = f"{a} = 'APPLY_DISCOUNT'", f"{a} = 'SHOW_URGENCY'", f"{a} = 'SEND_ABANDON_EMAIL'"
    return f"""CASE
      WHEN {d} AND COALESCE(discounts_this_month, 0) >= 3 THEN 'MAX_DISCOUNT_CAP_REACHED'
      WHEN {d} AND COALESCE(last_discount_within_hours, 999.0) < 24 THEN 'ANTI_GAMING_COOLDOWN'
      WHEN {d} AND COALESCE(total_cart_value, 0.0) <= 50 THEN 'MIN_CART_VALUE_NOT_MET'
      WHEN {d} AND COALESCE(purchases, 0) > 0 THEN 'ALREADY_PURCHASED'
      WHEN {u} AND COALESCE(inventory_level, 100) >= 10 THEN 'INVENTORY_SUFFICIENT'
      WHEN {u} AND NOT COALESCE(feature_intent = 'CHECKOUT_INTENT', FALSE) THEN 'INTENT_MISMATCH'
      WHEN {m} AND COALESCE(session_duration_sec, 0.0) <= 300 THEN 'SESSION_TOO_SHORT'
      WHEN {m} AND COALESCE(cart_adds, 0) = 0 THEN 'NO_CART_ITEMS'
      WHEN {m} AND COALESCE(checkouts, 0) > 0 THEN 'ALREADY_CHECKED_OUT'
      WHEN {d} AND customer_segment IS NOT NULL AND feature_segment IS NOT NULL
           AND customer_segment <> feature_segment THEN 'DEMOGRAPHIC_MISMATCH'
      ELSE '' END"""


def guards_sql(a: str = "proposed_action") -> tuple[str, str]:
    low = f"({a} = 'APPLY_DISCOUNT' AND COALESCE(total_cart_value < 50, FALSE))"
    nochk = f"({a} = 'SHOW_URGENCY' AND COALESCE(checkouts = 0, FALSE))"
    act = f"CASE WHEN {low} OR {nochk} THEN 'NO_ACTION' ELSE {a} END"
    reason = f"CASE WHEN {low} THEN 'MIN_CART_VALUE_NOT_MET' WHEN {nochk} THEN 'NO_CHECKOUT_STARTED' ELSE '' END"
    return act, reason


def policy_ctes(src: str, prefix: str) -> str:
    g_act, g_reason = guards_sql()
    return f"""{prefix}_ctx AS (SELECT *, {ABSENT_CTX} FROM {src}),
{prefix}_pol AS (
  SELECT *, {allow_sql()} AS allowed, {reason_sql()} AS policy_reason,
    {g_act} AS guarded_action, {g_reason} AS guard_reason
  FROM {prefix}_ctx)"""


def policy_ctes_ctx(src: str, prefix: str, ctx: str) -> str:
    """Policy CTEs with the customer side taken from a context table."""
    g_act, g_reason = guards_sql()
    absent = ("CAST(NULL AS VARCHAR) AS customer_segment, CAST(NULL AS INTEGER) AS inventory_level, "
              "CAST(NULL AS VARCHAR) AS feature_intent, CAST(NULL AS VARCHAR) AS feature_segment, 0.0 AS discount_value")
    return f"""{prefix}_ctx AS (SELECT s.*, c.total_purchases, c.discounts_this_month, c.last_discount_within_hours, {absent}
  FROM {src} s LEFT JOIN {ctx} c ON s.session_id = c.session_id),
{prefix}_pol AS (
  SELECT *, {allow_sql()} AS allowed, {reason_sql()} AS policy_reason,
    {g_act} AS guarded_action, {g_reason} AS guard_reason
  FROM {prefix}_ctx)"""


def session_pipeline() -> str:
    """WITH-list up to per-session policy: sp_pol."""
    return ",\n".join([CLICKS, SESS, EV, FEAT, intent_ctes("feat", "sp"), policy_ctes("sp_pred", "sp")])


def event_pipeline() -> str:
    """WITH-list up to per-event policy: ep_pol."""
    return ",\n".join([CLICKS, SESS, EV, RUNFEAT, intent_ctes("rfeat", "ep"), policy_ctes("ep_pred", "ep")])


def decisions_ctes(cooldown_minutes: int = 15) -> str:
    cd = cooldown_minutes * 60 * 1_000_000
    return f"""cap AS (
  SELECT session_id, event_id, timestamp,
    ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY timestamp, event_id) AS crn
  FROM ep_pol WHERE allowed AND guarded_action <> 'NO_ACTION'),
chain(session_id, crn, event_id, last_us, fired) AS (
  SELECT session_id, crn, event_id, epoch_us(timestamp), TRUE FROM cap WHERE crn = 1
  UNION ALL
  SELECT c.session_id, c.crn, c.event_id,
    CASE WHEN epoch_us(c.timestamp) - ch.last_us >= {cd} THEN epoch_us(c.timestamp) ELSE ch.last_us END,
    epoch_us(c.timestamp) - ch.last_us >= {cd}
  FROM chain ch JOIN cap c ON c.session_id = ch.session_id AND c.crn = ch.crn + 1),
disp AS (SELECT session_id, event_id FROM chain WHERE fired),
dec0 AS (
  SELECT p.*, d.event_id IS NOT NULL AS dispatched
  FROM ep_pol p LEFT JOIN disp d ON p.session_id = d.session_id AND p.event_id = d.event_id),
dec1 AS (
  SELECT *,
    last_value(CASE WHEN dispatched THEN timestamp END IGNORE NULLS) OVER w AS last_ts,
    last_value(CASE WHEN dispatched THEN guarded_action END IGNORE NULLS) OVER w AS last_act
  FROM dec0 WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, event_id {RUN})),
dec2 AS (
  SELECT *, COALESCE(epoch_us(timestamp) - epoch_us(last_ts) < {cd}, FALSE) AS cooling FROM dec1),
decisions AS (
  SELECT * EXCLUDE (action),
    CASE WHEN dispatched THEN guarded_action ELSE 'NO_ACTION' END AS action,
    CASE WHEN dispatched THEN NULL
         WHEN cooling AND proposed_action = last_act THEN 'SUPPRESSED_WITHIN_15MIN'
         WHEN NOT allowed THEN ''
         WHEN cooling THEN 'SUPPRESSED_WITHIN_15MIN'
         ELSE guard_reason END AS reason
  FROM dec2)"""


ACTION_ID_SQL = ("substring(sha256(session_id || ':' || action || ':' || "
                 "CAST(epoch_us(timestamp) // 60000000 AS VARCHAR)), 1, 12)")


# --- Markov ------------------------------------------------------------------------
def _acc(base: str, inc: float, n: str) -> str:
    return (f"list_reduce(list_concat([CAST({base} AS DOUBLE)], list_resize([]::DOUBLE[], CAST({n} AS INTEGER), {inc})),"
            f" lambda a, x: a + x)")


def markov_next_sql(state: str, counts: dict[str, str], firsts: dict[str, str]) -> str:
    branches = []
    for st, row in MARKOV_TRANSITIONS.items():
        items = []
        for r, (t, p) in enumerate(row.items()):
            v = str(float(p))
            for a, s, inc in MARKOV_BOOSTS:
                if s == t:
                    v = _acc(str(float(p)), inc, counts[a])
            items.append(f"{{'g': 0, 'r': {r}, 's': '{t}', 'v': {v}}}")
        for a, s, inc in MARKOV_BOOSTS:
            if s in row:
                continue
            earlier = " + ".join(
                f"(CASE WHEN {counts[b]} > 0 AND {firsts[b]} < {firsts[a]} THEN 1 ELSE 0 END)"
                for b, _, _ in MARKOV_BOOSTS if b != a
            )
            items.append(f"CASE WHEN {counts[a]} > 0 THEN {{'g': 1, 'r': {earlier}, 's': '{s}', 'v': {_acc('0.0', inc, counts[a])}}} END")
        arr = f"list_sort(list_filter([{', '.join(items)}], lambda x: x IS NOT NULL))"
        expr = (f"(SELECT arr[list_position(ps, list_max(ps))].s FROM (SELECT arr, "
                f"list_transform(arr, lambda x: x.v / list_reduce(list_transform(arr, lambda y: y.v), lambda a, b: a + b)) AS ps "
                f"FROM (SELECT {arr} AS arr) i) j)")
        branches.append(f"WHEN '{st}' THEN {expr}")
    return f"CASE {state} {' '.join(branches)} ELSE 'EXIT' END"


def markov_state_sql(last_action: str) -> str:
    from shoptide.schema import MARKOV_ACTION_TO_STATE
    m = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MARKOV_ACTION_TO_STATE.items())
    return f"CASE WHEN {last_action} IS NULL THEN 'LANDING' ELSE CASE {last_action} {m} ELSE 'BROWSING' END END"


LEDGER = """ledger AS (
  SELECT action_id,
    first(session_id ORDER BY timestamp, event_id) AS session_id,
    first(action ORDER BY timestamp, event_id) AS action_type,
    first(intent ORDER BY timestamp, event_id) AS intent,
    first(confidence ORDER BY timestamp, event_id) AS confidence,
    last(reason ORDER BY timestamp, event_id) AS reason,
    CAST(NULL AS VARCHAR) AS outcome, FALSE AS acknowledged, 'dispatched' AS status,
    first(timestamp ORDER BY timestamp, event_id) AS created_at
  FROM (SELECT *, """ + ACTION_ID_SQL + """ AS action_id FROM decisions) d GROUP BY action_id)"""

CONV_EXISTS = """EXISTS (SELECT 1 FROM sess e WHERE e.session_id = {a}.session_id
      AND e.action IN ('checkout_start', 'purchase_complete')
      AND e.timestamp >= {a}.created_at AND epoch_us(e.timestamp) <= epoch_us({a}.created_at) + 900000000)"""

BATCHES = """lb AS (SELECT *, (ROW_NUMBER() OVER (ORDER BY created_at, action_id) - 1) // 100 AS batch_no FROM ledger),
lb2 AS (SELECT *, MAX(created_at) OVER (PARTITION BY batch_no) AS as_of FROM lb),
outc AS (
  SELECT lb2.*, CASE WHEN epoch_us(as_of) - epoch_us(created_at) <= 1200000000 THEN NULL
    ELSE """ + CONV_EXISTS.format(a="lb2") + """ END AS converted
  FROM lb2),
met AS (
  SELECT batch_no, COUNT(*) AS actions_evaluated,
    CAST(SUM(CASE WHEN converted THEN 1 ELSE 0 END) AS BIGINT) AS converted,
    CAST(SUM(CASE WHEN converted IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS undecided,
    MAX(as_of) AS created_at
  FROM outc GROUP BY batch_no),
met2 AS (SELECT *, CAST(converted AS DOUBLE) / CAST(actions_evaluated AS DOUBLE) AS conversion_rate FROM met),
dr AS (
  SELECT *, COUNT(*) OVER h AS history_len, AVG(conversion_rate) OVER h AS history_avg
  FROM met2 WINDOW h AS (ORDER BY batch_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
dr2 AS (
  SELECT *, (CASE WHEN history_len < 2 THEN FALSE WHEN history_avg = 0 THEN conversion_rate < 1.0
      ELSE (history_avg - conversion_rate) / history_avg > 0.2 END)
    OR (history_len = 0 AND conversion_rate < 0.1 AND actions_evaluated >= 10) AS drift_flagged
  FROM dr)"""


RAWFEED = """rawfeed AS (
  SELECT event_id AS source_event_id,
    CASE WHEN kk = 7 THEN '{"event_id": "' || event_id || '", "session_id": '
    ELSE '{' || CASE WHEN kk <> 1 THEN '"event_id": "' || event_id || '", ' ELSE '' END
      || CASE WHEN kk <> 3 THEN '"session_id": "' || session_id || '", ' ELSE '' END
      || '"customer_id": "' || customer_id || '"'
      || ', "timestamp": "' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') || '"'
      || ', "action": "' || action || '"'
      || ', "category": "' || category || '"'
      || ', "value": ' || CASE WHEN kk = 5 THEN '"n/a"' ELSE printf('%.2f', value) END || '}' END AS value
  FROM (SELECT *, CAST(json_extract_string(metadata, '$.k') AS INTEGER) % 10 AS kk FROM sess) s),
parsed0 AS (
  SELECT value AS raw, json_valid(value) AS ok_json,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.event_id') END AS event_id,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.session_id') END AS session_id,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.customer_id') END AS customer_id,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.timestamp') END AS ts_text,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.action') END AS action,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.category') END AS category,
    CASE WHEN json_valid(value) THEN json_extract_string(value, '$.value') END AS value_text
  FROM rawfeed),
parsed AS (
  SELECT *, TRY_CAST(ts_text AS TIMESTAMP) AS timestamp, TRY_CAST(value_text AS DOUBLE) AS value,
    (ts_text IS NOT NULL AND TRY_CAST(ts_text AS TIMESTAMP) IS NULL)
      OR (value_text IS NOT NULL AND TRY_CAST(value_text AS DOUBLE) IS NULL) AS mistyped
  FROM parsed0),
checked AS (
  SELECT *, ok_json AND NOT mistyped AND session_id IS NOT NULL AND action IS NOT NULL AS valid,
    CASE WHEN NOT ok_json THEN 'malformed_json' WHEN mistyped THEN 'mistyped_field'
         WHEN session_id IS NULL OR action IS NULL THEN 'missing_required' END AS quarantine_reason
  FROM parsed)"""

DEFAULT_ID_SQL = ("substring(sha256(concat_ws('|', COALESCE(session_id, ''), COALESCE(CAST(epoch_us(timestamp) AS VARCHAR), ''), "
                  "COALESCE(action, ''), COALESCE(category, ''))), 1, 12)")

LOG = """ilog AS (
  SELECT *, 0 AS ingest_seq FROM sess
  UNION ALL
  SELECT event_id, customer_id, timestamp, action, product_id, category, value + 1.0, metadata, session_id, 1
  FROM sess WHERE CAST(json_extract_string(metadata, '$.k') AS INTEGER) < 10)"""

ASOF = "(SELECT MAX(timestamp) FROM sess)"

STARTS = """st AS (SELECT session_id, first(customer_id ORDER BY timestamp, event_id) AS customer_id,
  MIN(timestamp) AS session_start FROM sess GROUP BY session_id)"""


# First balanced {...} of a text: the same segment fold as the Spark job.
_ESC = "(length(seg) >= 2 AND substring(seg, length(seg) - 1, 1) = '\\')"


SEGMENT_RE = r'(?s)[^\\"{}]*(?:\\.|\\|"|\{|\}|$)'

def first_json_sql(text: str) -> str:
    esc = _ESC
    step = (f"lambda acc, seg: CASE WHEN acc.fin IS NOT NULL THEN acc ELSE "
            f"{{'depth': CASE WHEN {esc} OR acc.instr THEN acc.depth WHEN right(seg, 1) = '{{' THEN acc.depth + 1 "
            f"WHEN right(seg, 1) = '}}' THEN acc.depth - 1 ELSE acc.depth END, "
            f"'instr': CASE WHEN NOT {esc} AND right(seg, 1) = '\"' THEN NOT acc.instr ELSE acc.instr END, "
            f"'pos': acc.pos + length(seg), "
            f"'fin': CASE WHEN NOT {esc} AND NOT acc.instr AND right(seg, 1) = '}}' AND acc.depth - 1 = 0 "
            f"THEN acc.pos + length(seg) END}} END")
    rest = f"substring({text}, strpos({text}, '{{'))"
    segs = "regexp_extract_all(" + rest + ", '" + SEGMENT_RE + "')"
    fold = f"list_reduce({segs}, {step}, {{'depth': 0, 'instr': false, 'pos': 0, 'fin': NULL::INTEGER}})"
    return f"CASE WHEN strpos({text}, '{{') > 0 THEN substring({rest}, 1, ({fold}).fin) END"
