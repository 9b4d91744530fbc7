"""Authoritative policy (truth table) and the reasoned fallback rules."""

import pytest

from shoptide.operators.policy import policy_allow, policy_reason

SCHEMA = ("proposed_action string, intent string, discount_value double, discounts_this_month int, "
          "last_discount_within_hours double, total_purchases int, customer_segment string, total_cart_value double, "
          "session_duration_sec double, cart_adds long, checkouts long, purchases long, inventory_level int, "
          "feature_intent string, feature_segment string")
COLS = [c.split()[0] for c in SCHEMA.split(", ")]


def row(**kw):
    d = dict(proposed_action="NO_ACTION", intent="", discount_value=0.0)
    d.update(kw)
    return tuple(d.get(c) for c in COLS)


def allowed(spark, **kw):
    return policy_allow(spark.createDataFrame([row(**kw)], SCHEMA)).collect()[0].allowed


def reason(spark, **kw):
    return policy_reason(spark.createDataFrame([row(**kw)], SCHEMA)).collect()[0].policy_reason


@pytest.mark.parametrize("a", ["NO_ACTION", "LOG_ANALYTICS", "RECOMMEND_PRODUCT", "OFFER_BUNDLE", "SEND_TO_HUMAN",
                               "LOYALTY_REWARD", "RECOMMEND_ALTERNATIVE"])
def test_always_allowed(spark, a):
    assert allowed(spark, proposed_action=a)


def test_unknown_action_denied(spark):
    assert not allowed(spark, proposed_action="SHOW_COMPARISON_TOOL")


def test_discount(spark):
    ok = dict(proposed_action="APPLY_DISCOUNT", discounts_this_month=1, total_purchases=2, total_cart_value=80.0)
    assert allowed(spark, **ok)
    assert not allowed(spark, **{**ok, "discounts_this_month": 3})
    assert not allowed(spark, **{**ok, "total_purchases": 0})
    assert not allowed(spark, **{**ok, "last_discount_within_hours": 5.0})
    assert allowed(spark, **{**ok, "last_discount_within_hours": 30.0})
    assert not allowed(spark, **{**ok, "customer_segment": "a", "feature_segment": "b"})
    assert allowed(spark, **{**ok, "customer_segment": "a"})  # one side absent: deny does not fire
    assert not allowed(spark, proposed_action="APPLY_DISCOUNT", total_cart_value=80.0)  # customer absent
    assert allowed(spark, **{**ok, "proposed_action": "OFFER_DISCOUNT"})


def test_issue_discount(spark):
    assert allowed(spark, proposed_action="ISSUE_DISCOUNT", discount_value=20.0, intent="CARTING")
    assert not allowed(spark, proposed_action="ISSUE_DISCOUNT", discount_value=25.0)
    assert not allowed(spark, proposed_action="ISSUE_DISCOUNT", intent="BROWSING")


def test_urgency_and_email(spark):
    assert allowed(spark, proposed_action="SHOW_URGENCY", inventory_level=5, feature_intent="CHECKOUT_INTENT")
    assert not allowed(spark, proposed_action="SHOW_URGENCY", inventory_level=5)
    assert allowed(spark, proposed_action="SEND_ABANDON_EMAIL", session_duration_sec=400.0, cart_adds=1, checkouts=0)
    assert not allowed(spark, proposed_action="SEND_ABANDON_EMAIL", session_duration_sec=300.0, cart_adds=1, checkouts=0)


@pytest.mark.parametrize("kw,expected", [
    (dict(proposed_action="APPLY_DISCOUNT", discounts_this_month=3), "MAX_DISCOUNT_CAP_REACHED"),
    (dict(proposed_action="APPLY_DISCOUNT", last_discount_within_hours=2.0), "ANTI_GAMING_COOLDOWN"),
    (dict(proposed_action="APPLY_DISCOUNT", total_cart_value=50.0), "MIN_CART_VALUE_NOT_MET"),
    (dict(proposed_action="APPLY_DISCOUNT", total_cart_value=80.0, purchases=1), "ALREADY_PURCHASED"),
    (dict(proposed_action="APPLY_DISCOUNT", total_cart_value=80.0, customer_segment="a", feature_segment="b"),
     "DEMOGRAPHIC_MISMATCH"),
    (dict(proposed_action="APPLY_DISCOUNT", total_cart_value=80.0), ""),
    (dict(proposed_action="SHOW_URGENCY"), "INVENTORY_SUFFICIENT"),
    (dict(proposed_action="SHOW_URGENCY", inventory_level=3), "INTENT_MISMATCH"),
    (dict(proposed_action="SHOW_URGENCY", inventory_level=3, feature_intent="CHECKOUT_INTENT"), ""),
    (dict(proposed_action="SEND_ABANDON_EMAIL", session_duration_sec=100.0), "SESSION_TOO_SHORT"),
    (dict(proposed_action="SEND_ABANDON_EMAIL", session_duration_sec=400.0), "NO_CART_ITEMS"),
    (dict(proposed_action="SEND_ABANDON_EMAIL", session_duration_sec=400.0, cart_adds=1, checkouts=1), "ALREADY_CHECKED_OUT"),
    (dict(proposed_action="OFFER_DISCOUNT"), ""),
])
def test_fallback_reasons(spark, kw, expected):
    assert reason(spark, **kw) == expected
