"""Dedup, bounded history, TTL, session registry modes, history enrichment."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shoptide.operators.stores import bounded_history, event_dedup, event_ttl, history_enrich, session_registry

T0 = datetime(2024, 1, 1)


def test_dedup_last_write_wins(spark):
    df = spark.createDataFrame([("e1", 1.0, 0), ("e1", 2.0, 1), ("e2", 5.0, 0)], "event_id string, value double, ingest_seq int")
    assert {r.event_id: r.value for r in event_dedup(df).collect()} == {"e1": 2.0, "e2": 5.0}


def test_bounded_history_keeps_newest(spark):
    rows = [("s1", f"e{i:03d}", T0 + timedelta(seconds=i)) for i in range(120)]
    df = spark.createDataFrame(rows, "session_id string, event_id string, timestamp timestamp_ntz")
    kept = sorted(int(r.event_id[1:]) for r in bounded_history(df, 100).collect())
    assert kept == list(range(20, 120))


def test_ttl_strict(spark):
    df = spark.createDataFrame([("a", T0), ("b", T0 + timedelta(hours=1))], "event_id string, timestamp timestamp_ntz")
    kept = event_ttl(df, F.lit(T0 + timedelta(hours=25)).cast("timestamp_ntz"))
    assert [r.event_id for r in kept.collect()] == ["b"]


def test_registry_modes_keep_null_customer(spark):
    df = spark.createDataFrame([("s1", "e1", None, T0), ("s1", "e2", "c2", T0 + timedelta(minutes=5))],
                               "session_id string, event_id string, customer_id string, timestamp timestamp_ntz")
    first = session_registry(df).first()
    assert first.customer_id is None and first.created_at == T0
    assert first.expires_at == T0 + timedelta(minutes=5, hours=24)
    assert session_registry(df, mode="replace").first().customer_id == "c2"


def test_history_enrich(spark):
    rows = [("c1_1", "e1", "c1", T0, "purchase_complete"), ("c1_2", "e2", "c1", T0 + timedelta(days=40), "page_view"),
            ("c2_1", "e3", "c2", T0, "page_view")]
    df = spark.createDataFrame(rows, "session_id string, event_id string, customer_id string, timestamp timestamp_ntz, action string")
    out = {r.session_id: (r.repeat_customer, r.days_since_last_purchase) for r in history_enrich(df).collect()}
    assert out == {"c1_1": (False, None), "c1_2": (True, 40), "c2_1": (False, None)}


def test_empty_lookup_gives_empty_list(spark):
    from shoptide.operators.graph import empty_lookup
    keys = spark.createDataFrame([("a",), ("b",)], "k string")
    found = spark.createDataFrame([("a", ["x"])], "k string, names array<string>")
    out = {r.k: r.names for r in empty_lookup(keys, found, "k", "names").collect()}
    assert out == {"a": ["x"], "b": []}
