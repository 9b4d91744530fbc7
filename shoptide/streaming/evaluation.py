"""Periodic evaluation as an incremental job with stored metrics.

Each run takes the ledger's actions whose observation time has passed at
``as_of`` and that no earlier run has taken, decides their conversion, and
appends their ``outcomes`` and one row of ``metrics``, compared for drift with
the metrics of the runs before. A run without any such action appends nothing;
a run whose id is committed already changes nothing.

A run reads the ledger from ``retention_hours`` before the last run's reach on,
since a late event may add an action to a time that was evaluated before; what
has an outcome is left out by its action_id.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.operators.evaluate import conversion, drift
from shoptide.schema import CONVERSION_WINDOW_MINUTES, DRIFT_HISTORY, OBSERVATION_GRACE_MINUTES, SESSION_TTL_HOURS
from shoptide.session import materialize
from shoptide.streaming.tables import BatchTables, Table

OBSERVED = timedelta(minutes=CONVERSION_WINDOW_MINUTES + OBSERVATION_GRACE_MINUTES)
TABLES = {
    "outcomes": Table("action_id string, session_id string, action_type string, intent string, confidence double, reason string, "
                      "created_at timestamp_ntz, converted boolean, batch_no long, as_of timestamp_ntz, ledger_date date", ["ledger_date"]),
    "metrics": Table("batch_no long, created_at timestamp_ntz, actions_evaluated long, converted long, conversion_rate double, "
                     "critic_rewrite_success_rate double, history_len long, history_avg double, drift_flagged boolean"),
}


def evaluation_tables(spark: SparkSession, path: str) -> BatchTables:
    return BatchTables(spark, path, TABLES)


def recent_metrics(store: BatchTables, n: int = DRIFT_HISTORY) -> DataFrame:
    """The newest ``n`` stored metrics."""
    return store.read("metrics").orderBy(F.col("batch_no").desc()).limit(n)


def evaluate_due(store: BatchTables, ledger: DataFrame, clicks: DataFrame, as_of: datetime, run_id: int,
                 retention_hours: int = SESSION_TTL_HOURS) -> bool:
    """One run at ``as_of``; False if run ``run_id`` is committed. ``clicks`` needs the events of the evaluated actions' sessions."""
    batch = store.begin(run_id)
    if batch is None:
        return False
    due = ledger.where(F.col("created_at") < F.lit(as_of - OBSERVED).cast("timestamp_ntz"))
    taken = batch.read("outcomes")
    if "reach" in batch.notes:
        start = F.lit(datetime.fromisoformat(batch.notes["reach"]) - timedelta(hours=retention_hours)).cast("timestamp_ntz")
        due, taken = due.where(F.col("created_at") >= start), taken.where(F.col("ledger_date") >= F.to_date(start))
        clicks = clicks.where(F.col("timestamp") >= start)
    clicks = clicks.where(F.col("timestamp") <= F.lit(as_of).cast("timestamp_ntz"))  # the windows of all due actions end before as_of
    due = materialize(due.join(taken.select("action_id"), "action_id", "left_anti"), "due")  # read by the scan and by its join
    decided = conversion(due, clicks, as_of=F.lit(as_of).cast("timestamp_ntz"))
    batch_no = int(batch.notes.get("batch_no", -1)) + 1
    decided = materialize(decided.select(
        "action_id", "session_id", "action_type", "intent", "confidence", "reason", "created_at", "converted", F.lit(batch_no).cast("long").alias("batch_no"),
        F.lit(as_of).cast("timestamp_ntz").alias("as_of"), F.to_date("created_at").alias("ledger_date")), "outcomes")
    metrics = decided.agg(F.count("*").alias("actions_evaluated"), F.count_if("converted").alias("converted")).where("actions_evaluated > 0")
    rate = F.col("converted") / F.col("actions_evaluated")
    metrics = metrics.select(F.lit(batch_no).cast("long").alias("batch_no"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"), "*",
                             rate.alias("conversion_rate"), rate.alias("critic_rewrite_success_rate"))
    history = batch.read("metrics").where(F.col("batch_no") >= batch_no - DRIFT_HISTORY).select(*metrics.columns)
    metrics = materialize(drift(history.unionByName(metrics)).where(F.col("batch_no") == batch_no), "metrics")
    batch.notes["reach"] = (as_of - OBSERVED).isoformat()
    if not metrics.isEmpty():
        batch.append("outcomes", decided)
        batch.append("metrics", metrics)
        batch.notes["batch_no"] = batch_no
    batch.commit()
    return True
