"""Governance policy as columns.

Two rule sets, as in the reference:

* :func:`policy_allow` — the authoritative policy (default deny). An input that
  is absent (a Spark null) makes every rule that reads it not fire, for allow
  and deny rules alike.
* :func:`policy_reason` — the reasoned fallback (default allow) with ordered
  checks; returns the first failing reason or ''.

Inputs are plain columns; any of these that the DataFrame lacks is treated as
absent: discounts_this_month, last_discount_within_hours, total_purchases,
customer_segment (customer side); total_cart_value, session_duration_sec,
cart_adds, checkouts, inventory_level, feature_intent, feature_segment,
purchases (feature side); discount_value (default 0.0) and the intent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptide.schema import ALWAYS_ALLOWED

POLICY_INPUTS = {
    "discounts_this_month": "int",
    "last_discount_within_hours": "double",
    "total_purchases": "int",
    "customer_segment": "string",
    "total_cart_value": "double",
    "session_duration_sec": "double",
    "cart_adds": "long",
    "checkouts": "long",
    "purchases": "long",
    "inventory_level": "int",
    "feature_intent": "string",
    "feature_segment": "string",
}


def with_policy_inputs(df: DataFrame) -> DataFrame:
    """Add any missing policy input as a typed null (= absent)."""
    extra = [F.lit(None).cast(dtype).alias(name) for name, dtype in POLICY_INPUTS.items() if name not in df.columns]
    if "discount_value" not in df.columns:
        extra.append(F.lit(0.0).alias("discount_value"))
    return df.select("*", *extra) if extra else df


def _fires(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def allow_expr(action: Column, intent: Column) -> Column:
    c = F.col
    discount = action.isin("APPLY_DISCOUNT", "OFFER_DISCOUNT")
    deny = (
        _fires(discount & (c("last_discount_within_hours") < 24))
        | _fires(discount & (c("customer_segment") != c("feature_segment")))
        | _fires((action == "ISSUE_DISCOUNT") & (c("discount_value") > 20))
        | _fires((action == "ISSUE_DISCOUNT") & (intent == "BROWSING"))
    )
    rules = (
        _fires(discount & (c("discounts_this_month") < 3) & (c("total_purchases") > 0) & (c("total_cart_value") > 50))
        | _fires((action == "ISSUE_DISCOUNT") & (c("discount_value") <= 20) & (intent != "BROWSING"))
        | _fires((action == "SHOW_URGENCY") & (c("inventory_level") < 10) & (c("feature_intent") == "CHECKOUT_INTENT"))
        | _fires((action == "SEND_ABANDON_EMAIL") & (c("session_duration_sec") > 300) & (c("cart_adds") > 0)
                 & (c("checkouts") == 0))
    )
    return _fires(action.isin(*ALWAYS_ALLOWED)) | (~deny & rules)


def policy_allow(df: DataFrame, action_col: str = "proposed_action", intent_col: str = "intent") -> DataFrame:
    """Add boolean ``allowed`` (authoritative policy)."""
    df = with_policy_inputs(df)
    intent = F.coalesce(F.col(intent_col), F.lit("")) if intent_col in df.columns else F.lit("")
    return df.select("*", allow_expr(F.col(action_col), intent).alias("allowed"))


def reason_expr(action: Column) -> Column:
    c = F.col
    disc = action == "APPLY_DISCOUNT"
    urg = action == "SHOW_URGENCY"
    mail = action == "SEND_ABANDON_EMAIL"
    return (
        F.when(disc & (F.coalesce(c("discounts_this_month"), F.lit(0)) >= 3), "MAX_DISCOUNT_CAP_REACHED")
        .when(disc & (F.coalesce(c("last_discount_within_hours"), F.lit(999.0)) < 24), "ANTI_GAMING_COOLDOWN")
        .when(disc & (F.coalesce(c("total_cart_value"), F.lit(0.0)) <= 50), "MIN_CART_VALUE_NOT_MET")
        .when(disc & (F.coalesce(c("purchases"), F.lit(0)) > 0), "ALREADY_PURCHASED")
        .when(urg & (F.coalesce(c("inventory_level"), F.lit(100)) >= 10), "INVENTORY_SUFFICIENT")
        .when(urg & ~F.coalesce(c("feature_intent") == "CHECKOUT_INTENT", F.lit(False)), "INTENT_MISMATCH")
        .when(mail & (F.coalesce(c("session_duration_sec"), F.lit(0.0)) <= 300), "SESSION_TOO_SHORT")
        .when(mail & (F.coalesce(c("cart_adds"), F.lit(0)) == 0), "NO_CART_ITEMS")
        .when(mail & (F.coalesce(c("checkouts"), F.lit(0)) > 0), "ALREADY_CHECKED_OUT")
        .when(disc & c("customer_segment").isNotNull() & c("feature_segment").isNotNull()
              & (c("customer_segment") != c("feature_segment")), "DEMOGRAPHIC_MISMATCH")
        .otherwise("")
    )


def policy_reason(df: DataFrame, action_col: str = "proposed_action") -> DataFrame:
    """Add ``policy_reason`` ('' when allowed) and ``reason_allowed``."""
    df = with_policy_inputs(df)
    r = reason_expr(F.col(action_col))
    return df.select("*", r.alias("policy_reason"), (r == "").alias("reason_allowed"))


def unreachable_policy(df: DataFrame, reachable: Column) -> DataFrame:
    """Fail closed: when the policy context is unavailable every action is denied."""
    return df.withColumn("allowed", F.coalesce(reachable, F.lit(False)) & F.col("allowed"))
