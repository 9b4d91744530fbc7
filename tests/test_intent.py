"""Rule scoring, argmax tie-break, calibration, override, histogram."""

import math

import pytest

from shoptide.operators.intent import calibrated_intent, final_intent, intent_distribution, intent_override, rule_intent


def classify(features, **kw):
    r = final_intent(features(kw)).collect()[0]
    return r.rule_intent, r.rule_confidence, r.calibrated_confidence


@pytest.mark.parametrize("kw,expected", [
    (dict(page_views=8, cart_adds=0, exploration_ratio=0.6), "BROWSE"),
    (dict(categories_viewed=4, cart_adds=0, page_views=6), "COMPARE"),
    (dict(cart_adds=3, cart_removes=1, total_cart_value=75.0, cart_conversion_rate=0.5), "CART_BUILDER"),
    (dict(checkouts=1, total_cart_value=150.0, exploration_ratio=0.1), "CHECKOUT_INTENT"),
    (dict(searches=4, cart_abandon_rate=0.6), "PRICE_SENSITIVE"),
    (dict(session_duration_sec=700.0, cart_adds=0, days_since_last_purchase=45), "CHURN_RISK"),
    (dict(repeat_customer=True, avg_inter_event_time=20.0, total_cart_value=200.0), "LOYAL_RETURNER"),
])
def test_rule_cases(features, kw, expected):
    assert classify(features, **kw)[0] == expected


def test_empty_features_browse_zero(features):
    intent, raw, cal = classify(features)
    assert intent == "BROWSE" and raw == 0.0
    assert cal == pytest.approx(1 / (1 + math.exp(2.5)))


def test_ambiguous_low_confidence(features):
    _, raw, cal = classify(features, page_views=2, cart_adds=1, checkouts=0)
    assert cal < 0.6


def test_tie_goes_to_greatest_name(features):
    # COMPARE +2 (page_views > 3*cart_adds) and BROWSE +2 (exploration) tie -> COMPARE > BROWSE
    r = rule_intent(features(dict(page_views=1, exploration_ratio=0.9))).collect()[0]
    assert r.rule_intent == "COMPARE" and r.rule_confidence == 0.5


def test_worked_sessions(clicks):
    from shoptide.operators.sessions import session_features
    checkout = clicks([("page_view", None, 0), ("search_query", None, 60), ("add_to_cart", 150.0, 120),
                       ("checkout_start", None, 180)])
    r = calibrated_intent(session_features(checkout)).collect()[0]
    assert r.rule_intent == "CHECKOUT_INTENT" and r.rule_confidence == pytest.approx(6 / 11)
    assert r.calibrated_confidence == pytest.approx(0.5566, abs=1e-4)
    price = clicks([("search_query", None, i * 60) for i in range(4)] + [("add_to_cart", 40.0, 240), ("remove_from_cart", 40.0, 300)])
    r = calibrated_intent(session_features(price)).collect()[0]
    assert r.rule_intent == "PRICE_SENSITIVE" and r.calibrated_confidence == pytest.approx(0.7449, abs=1e-4)


def test_override_strictly_greater(spark, features):
    pred = final_intent(features(dict(session_id="a"), dict(session_id="b")))
    ext = spark.createDataFrame([("a", "CARTING", 0.9), ("b", "CARTING", 0.0758581800212435)],
                                "session_id string, ext_intent string, ext_confidence double")
    out = {r.session_id: r for r in intent_override(pred, ext).collect()}
    assert out["a"].intent == "CARTING" and out["a"].overridden
    assert out["b"].intent == "BROWSE" and not out["b"].overridden


def test_distribution_zero_filled(spark, features):
    pred = final_intent(features(dict(session_id="a"), dict(session_id="b", checkouts=1)))
    d = {r.intent: r.n for r in intent_distribution(spark, pred).collect()}
    assert d["BROWSE"] == 1 and d["CHECKOUT_INTENT"] == 1 and d["COMPARE"] == 0 and d["TOTAL"] == 2
