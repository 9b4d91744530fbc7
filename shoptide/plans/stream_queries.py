"""Queries over the tables that the streaming loop keeps, fed with a feed that has every fault of delivery.

One run of the loop per session and input folder serves all of them; each reads
the table it is about. The SQL states what the tables must hold at the end from
the events alone: which deliveries the watermark lets in, and the batch
semantics over those.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.plans import oracle as O
from shoptide.plans.pipeline import rounded, session_clicks
from shoptide.plans.registry import _DEC, _LCOLS, _VE, register, sel, with_
from shoptide.session import checkpoint_dir
from shoptide.sources.events import DROPS, disordered_feed, open_feed
from shoptide.streaming.evaluation import evaluate_due, evaluation_tables, recent_metrics
from shoptide.streaming.loop import loop_tables, start_loop
from shoptide.streaming.pipelines import feed_events, stateful_decision_stream, stateful_tables
from shoptide.streaming.tables import BatchTables

_RUNS: dict[tuple[str, str], str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/shoptide/{name}-{uuid.uuid4().hex[:12]}"


def run_drops(spark: SparkSession, feed: DataFrame, base: str, drops: int = DROPS, **options) -> BatchTables:
    """Writes each drop of a feed (value, drop, arrival, copy) and runs the loop on it, started anew each time."""
    tables = loop_tables(spark, f"{base}/tables")
    for k in range(drops):
        part = feed.where(F.col("drop") == k).orderBy("arrival", "copy").select("value")
        part.write.mode("overwrite").text(f"{base}/feed/drop={k}")
        start_loop(tables, open_feed(spark, "files", path=f"{base}/feed"), f"{base}/checkpoint", **options).awaitTermination()
    return tables


def loop_run(spark: SparkSession, sf: str) -> BatchTables:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        base = _folder(spark, "loop")
        run_drops(spark, disordered_feed(session_clicks(spark, sf)), base)
        _RUNS[key] = base
    return loop_tables(spark, f"{_RUNS[key]}/tables")


_SESS0 = O.SESS.replace("sess AS (", "sess0 AS (")
_DELIVERED = f"""numbered AS (SELECT *, CAST(event_id AS BIGINT) AS n, epoch_us(timestamp) AS us FROM sess0),
days AS (SELECT MIN(us // 86400000000) AS lo, MAX(us // 86400000000) AS hi FROM numbered),
once AS (SELECT *, 0 AS copy, us + CASE WHEN n % 17 = 3 THEN 240 WHEN n % 5 = 0 THEN 20 ELSE 0 END * 3600000000 AS arrival FROM numbered),
copies AS (SELECT * FROM once UNION ALL
  SELECT * REPLACE (1 AS copy, value + 1.0 AS value, arrival + 5 * 3600000000 AS arrival) FROM once WHERE n % 7 = 2),
dropped AS (SELECT *, LEAST(floor((arrival // 86400000000 - lo) / ((hi - lo + 1) / {DROPS}.0)), {DROPS - 1}) AS drop FROM copies, days),
marks AS (SELECT d.drop, MAX(e.us) - 86400000000 AS mark FROM (SELECT DISTINCT drop FROM dropped) d JOIN dropped e ON e.drop < d.drop GROUP BY d.drop),
delivered AS (SELECT dropped.* EXCLUDE (event_id, value), round(value, 2) AS value, mark, coalesce(us < mark, FALSE) AS late,
  CASE WHEN n % 10 = 1 THEN {O.DEFAULT_ID_SQL} ELSE event_id END AS event_id FROM dropped LEFT JOIN marks USING (drop)),
sess AS (SELECT event_id, customer_id, timestamp, action, product_id, category, value, metadata, session_id FROM delivered WHERE NOT late
  QUALIFY ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY drop DESC, arrival DESC, copy DESC) = 1)"""
_FED = f"{_SESS0},\n{_DELIVERED}"
_FED_EVENTS = with_(O.CLICKS, _FED)
_FED_DECISIONS = with_(O.event_pipeline().replace(O.SESS, _FED), O.decisions_ctes(15))
_FED_LEDGER = with_(O.event_pipeline().replace(O.SESS, _FED), O.decisions_ctes(15), O.LEDGER)


@register("event_store", f"{_FED_EVENTS}\nSELECT {sel(_VE)}, product_id, CAST(json_extract_string(metadata, '$.k') AS INTEGER) AS k FROM sess")
def q_event_store(spark, sf):
    """The date-partitioned store after redeliveries, missing ids, disorder and late rows: one row per event, the last delivery."""
    return rounded(loop_run(spark, sf).read("events").select(*_VE, "product_id", F.get_json_object("metadata", "$.k").cast("int").alias("k")))


@register("stream_decisions_repaired", f"{_FED_DECISIONS}\nSELECT {sel(_DEC)}, {O.ACTION_ID_SQL} AS action_id FROM decisions")
def q_stream_decisions_repaired(spark, sf):
    """One decision per event of the store, as if the events had come in order: late events have repaired their sessions."""
    return rounded(loop_run(spark, sf).read("decisions").select(*_DEC, "action_id"))


@register("ledger_sink", f"{_FED_LEDGER}\nSELECT {sel(_LCOLS)} FROM ledger")
def q_ledger_sink(spark, sf):
    """The ledger that the loop keeps beside the decisions."""
    return rounded(loop_run(spark, sf).read("ledger").select(*_LCOLS))


@register("late_events", f"""{_FED_EVENTS}
SELECT event_id, session_id, timestamp, CAST(drop AS BIGINT) AS batch_id, make_timestamp(CAST(mark AS BIGINT)) AS watermark FROM delivered WHERE late""")
def q_late_events(spark, sf):
    """Rows older than the watermark, kept and not decided."""
    return loop_run(spark, sf).read("late").select("event_id", "session_id", "timestamp", "batch_id", "watermark")


@register("ingest_counts", f"""{_FED_EVENTS},
kinds AS (SELECT CAST(drop AS BIGINT) AS batch_id, COUNT(*) AS "read", 0 AS quarantined, COUNT(*) FILTER (late) AS late, COUNT(*) FILTER (NOT late) AS accepted,
  COUNT(DISTINCT event_id) FILTER (NOT late) AS "distinct" FROM delivered GROUP BY drop)
SELECT kind, CAST(n AS BIGINT) AS n, batch_id FROM (UNPIVOT kinds ON "read", quarantined, late, accepted, "distinct" INTO NAME kind VALUE n)""")
def q_ingest_counts(spark, sf):
    """What became of every record of each batch."""
    return loop_run(spark, sf).read("counts").select("kind", "n", "batch_id")


RUNS = 6


def _evaluations(spark: SparkSession, sf: str) -> BatchTables:
    """The evaluation job at ``RUNS`` even points of the events' days, each run sent twice."""
    loop = loop_run(spark, sf)
    store = evaluation_tables(spark, _folder(spark, "evaluations"))
    events, ledger = loop.read("events"), loop.read("ledger")
    lo, hi = events.agg(F.min("event_date"), F.max("event_date")).first()
    if lo is None:
        return store
    start, hours = datetime(lo.year, lo.month, lo.day), ((hi - lo).days + 1) * 24
    for k in range(RUNS):
        for _ in range(2):
            evaluate_due(store, ledger, events, start + timedelta(hours=hours * (k + 1) // RUNS), k)
    return store


_RUNS_SQL = f"""{_FED_LEDGER},
points AS (SELECT k AS batch_no, lo + to_hours(CAST(days * 24 * (k + 1) // {RUNS} AS BIGINT)) AS as_of
  FROM (SELECT MIN(CAST(timestamp AS DATE))::TIMESTAMP AS lo, date_diff('day', MIN(CAST(timestamp AS DATE)), MAX(CAST(timestamp AS DATE))) + 1 AS days FROM sess), range({RUNS}) r(k)),
taken AS (SELECT l.*, (SELECT MIN(p.batch_no) FROM points p WHERE l.created_at < p.as_of - INTERVAL 20 MINUTE) AS batch_no FROM ledger l),
outcome AS (SELECT t.*, EXISTS (SELECT 1 FROM sess s WHERE s.session_id = t.session_id AND s.action IN ('checkout_start', 'purchase_complete')
  AND s.timestamp >= t.created_at AND s.timestamp <= t.created_at + INTERVAL 15 MINUTE) AS converted FROM taken t WHERE batch_no IS NOT NULL),
met AS (SELECT CAST(batch_no AS BIGINT) AS batch_no, COUNT(*) AS actions_evaluated, COUNT(*) FILTER (converted) AS converted,
  CAST(COUNT(*) FILTER (converted) AS DOUBLE) / COUNT(*) AS conversion_rate FROM outcome GROUP BY batch_no),
hist AS (SELECT m.*, (SELECT as_of FROM points p WHERE p.batch_no = m.batch_no) AS created_at,
  COUNT(*) OVER w AS history_len, AVG(conversion_rate) OVER w AS history_avg FROM met m
  WINDOW w AS (ORDER BY batch_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
stored AS (SELECT *, CASE WHEN history_len = 0 THEN conversion_rate < 0.10 AND actions_evaluated >= 10 WHEN history_len < 2 THEN FALSE
  WHEN history_avg = 0 THEN conversion_rate < 1.0 ELSE (history_avg - conversion_rate) / history_avg > 0.20 END AS drift_flagged FROM hist)"""
_MET = ["batch_no", "created_at", "actions_evaluated", "converted", "conversion_rate", "history_len", "history_avg", "drift_flagged"]
_MET_SQL = ", ".join(f"round({c}, 9) AS {c}" if c in ("conversion_rate", "history_avg") else c for c in _MET)


@register("metrics_sink", f"{_RUNS_SQL}\nSELECT {_MET_SQL} FROM stored")
def q_metrics_sink(spark, sf):
    """The stored metrics of an incremental evaluation, one row per run."""
    return rounded(_evaluations(spark, sf).read("metrics").select(*_MET))


@register("recent_metrics", f"{_RUNS_SQL}\nSELECT {_MET_SQL} FROM stored ORDER BY batch_no DESC LIMIT 3")
def q_recent_metrics(spark, sf):
    """The newest three stored metrics (a top-k report)."""
    return rounded(recent_metrics(_evaluations(spark, sf), 3).select(*_MET))


@register("evaluation_outcomes", f"{_RUNS_SQL}\nSELECT action_id, session_id, CAST(batch_no AS BIGINT) AS batch_no, converted FROM outcome")
def q_evaluation_outcomes(spark, sf):
    """Every action that a run has taken, with its conversion."""
    return _evaluations(spark, sf).read("outcomes").select("action_id", "session_id", "batch_no", "converted")


_REPEATED = with_(O.event_pipeline().replace(O.SESS, _FED.replace("value + 1.0", "value + 0.0")), O.decisions_ctes(15))


@register("stream_stateful_repaired", f"{_REPEATED}\nSELECT {sel(_DEC)}, {O.ACTION_ID_SQL} AS action_id FROM decisions")
def q_stream_stateful_repaired(spark, sf):
    """The operator with state over the feed with faults (redeliveries repeat what they were): equal to decisions in order."""
    base = _folder(spark, "stateful")
    feed = disordered_feed(session_clicks(spark, sf), raised=0.0)
    for k in range(DROPS):
        part = feed.where(F.col("drop") == k).orderBy("arrival", "copy").select("value")
        part.write.mode("overwrite").text(f"{base}/feed/drop={k}")
        events = feed_events(open_feed(spark, "files", path=f"{base}/feed"))
        stateful_decision_stream(spark, events, f"{base}/tables", f"{base}/checkpoint").awaitTermination()
    return rounded(stateful_tables(spark, f"{base}/tables").read("decisions").select(*_DEC, "action_id"))
