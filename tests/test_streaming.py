"""Streaming: stream equals batch, late data and watermark, Kafka value shape."""

import json
import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as E
from shoptide.sources.events import to_kafka_value
from shoptide.streaming.pipelines import session_window_stream

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_stream_decisions_equal_batch(spark):
    q = E.queries()
    cols = ["event_id", "session_id", "action", "reason", "action_id"]
    assert rows(q["stream_decisions"](spark, SF).select(*cols)) == rows(q["action_decisions"](spark, SF).select(*cols))


def test_stream_ingest_equals_batch_validation(spark):
    q = E.queries()
    assert rows(q["stream_ingest"](spark, SF)) == rows(q["valid_events"](spark, SF))


def test_late_event_beyond_watermark_is_dropped(spark):
    base = datetime(2024, 1, 10)
    d = tempfile.mkdtemp(prefix="late-")
    schema = "customer_id string, timestamp timestamp_ntz"

    def drop(name, items):
        spark.createDataFrame(items, schema).write.mode("overwrite").parquet(f"{d}/in/{name}")

    drop("a", [("c1", base), ("c1", base + timedelta(minutes=10))])
    drop("b", [("c2", base + timedelta(days=3))])          # moves the watermark past c1's session
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{d}/in")
    out = session_window_stream(src, gap_minutes=30, watermark="1 hour")
    qy = (out.writeStream.outputMode("append").format("parquet").option("path", f"{d}/out")
          .option("checkpointLocation", f"{d}/ck").option("maxFilesPerTrigger", 1).trigger(availableNow=True).start())
    qy.awaitTermination()
    drop("c", [("c1", base + timedelta(minutes=20))])      # late: older than the watermark
    qy = (out.writeStream.outputMode("append").format("parquet").option("path", f"{d}/out")
          .option("checkpointLocation", f"{d}/ck").trigger(availableNow=True).start())
    qy.awaitTermination()
    got = spark.read.parquet(f"{d}/out").where(F.col("customer_id") == "c1").collect()
    assert len(got) == 1 and got[0].n_events == 2


def test_kafka_value_is_json(spark, clicks):
    v = to_kafka_value(clicks([("page_view", 1.5, 0)])).first()
    assert v.key == "s1" and json.loads(v.value)["action"] == "page_view"


def test_empty_input_gives_empty_output(spark, clicks):
    from shoptide.operators.sessions import running_features, session_features
    empty = clicks([("page_view", None, 0)]).limit(0)
    assert session_features(empty).count() == 0 and running_features(empty).count() == 0


def test_unreachable_policy_denies(spark):
    from shoptide.operators.policy import policy_allow, unreachable_policy
    df = spark.createDataFrame([("NO_ACTION",)], "proposed_action string")
    out = unreachable_policy(policy_allow(df), F.lit(False)).first()
    assert out.allowed is False


def test_stateful_stream_equals_batch(spark):
    q = E.queries()
    cols = ["event_id", "session_id", "action", "reason", "action_id", "dispatched"]
    got = rows(q["stream_decisions_stateful"](spark, SF).select(*cols))
    assert got == rows(q["action_decisions"](spark, SF).select(*cols))
