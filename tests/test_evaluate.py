"""Drift table, conversion window, ledger upsert."""

from datetime import datetime, timedelta

import pytest

from shoptide.operators.evaluate import conversion, drift
from shoptide.operators.ledger import upsert

T0 = datetime(2024, 1, 1)


def drift_of(spark, rate, history, n=100):
    rows = [(i, float(r), 100) for i, r in enumerate(history)] + [(len(history), float(rate), n)]
    m = spark.createDataFrame(rows, "batch_no long, conversion_rate double, actions_evaluated long")
    return {r.batch_no: r.drift_flagged for r in drift(m).collect()}[len(history)]


@pytest.mark.parametrize("rate,history,expected", [
    (0.05, [.30, .28, .32, .29, .31], True),
    (0.28, [.30, .28, .32, .29, .31], False),
    (0.05, [.30], False),
    (0.50, [0, 0, 0], True),
    (0.0, [0, 0], True),
    (1.0, [0, 0], False),
    (0.42, [.5, .5], False),
    (0.079, [.1, .1], True),
    (0.40, [.30, .28, .32], False),
])
def test_drift_table(spark, rate, history, expected):
    assert drift_of(spark, rate, history) is expected


def test_cold_start(spark):
    assert drift_of(spark, 0.0, [], n=12) is True
    assert drift_of(spark, 0.0, [], n=9) is False


def test_history_is_last_20(spark):
    hist = [0.0] * 5 + [0.5] * 20
    assert drift_of(spark, 0.5, hist) is False


def test_conversion_window(spark):
    clicks = spark.createDataFrame([
        ("s1", "e1", T0 + timedelta(minutes=15), "checkout_start"),
        ("s2", "e2", T0 + timedelta(minutes=16), "purchase_complete"),
        ("s3", "e3", T0 + timedelta(minutes=5), "page_view"),
        ("s4", "e4", T0, "checkout_start"),
        ("s5", "e5", T0 + timedelta(days=1), "page_view"),
    ], "session_id string, event_id string, timestamp timestamp_ntz, action string")
    acts = spark.createDataFrame([(f"a{i}", f"s{i}", T0) for i in range(1, 5)] + [("a5", "s5", T0 + timedelta(days=1))],
                                 "action_id string, session_id string, created_at timestamp_ntz")
    got = {r.action_id: r.converted for r in conversion(acts, clicks).collect()}
    assert got == {"a1": True, "a2": False, "a3": False, "a4": True, "a5": None}


def test_ledger_upsert_modes(spark):
    rows = [("id1", "s1", "APPLY_DISCOUNT", "CART_BUILDER", 0.7, None, None, False, T0, (T0, "e1")),
            ("id1", "s1", "APPLY_DISCOUNT", "OTHER", 0.9, "r", "converted", True, T0 + timedelta(seconds=30),
             (T0 + timedelta(seconds=30), "e2"))]
    df = spark.createDataFrame(rows, "action_id string, session_id string, action_type string, intent string, "
                               "confidence double, reason string, outcome string, acknowledged boolean, "
                               "created_at timestamp_ntz, seq struct<timestamp:timestamp_ntz,event_id:string>")
    pg = upsert(df, "pg").first()
    assert (pg.intent, pg.confidence, pg.created_at, pg.outcome, pg.status) == ("CART_BUILDER", 0.7, T0, "converted", "acknowledged")
    lite = upsert(df, "sqlite").first()
    assert (lite.intent, lite.confidence, lite.outcome) == ("OTHER", 0.9, "converted")
