"""Plan shape: chunked exchanges, no nested-loop joins, partial top-N, model fallback."""

from pyspark.sql import functions as F

from shoptide.operators.intent import final_intent
from shoptide.operators.ml import fit_forest
from shoptide.operators.sessions import running_features, sessionize
from shoptide.operators.stores import bounded_history


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sessionize_hashes_on_key_and_chunk(clicks):
    p = plan(sessionize(clicks([("page_view", None, 0)]).drop("session_id")))
    assert "hashpartitioning(customer_id" in p and "__chunk" in p
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_running_features_no_pairs(clicks):
    p = plan(running_features(clicks([("page_view", None, 0), ("add_to_cart", 3.0, 10)])))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "hashpartitioning(session_id" in p


def test_bounded_history_partial_limit(clicks):
    p = plan(bounded_history(clicks([("page_view", None, i) for i in range(5)]), 2))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_model_fallback(spark, features):
    rows = [dict(session_id=f"s{i}", page_views=i % 7, cart_adds=i % 3, checkouts=i % 2,
                 total_cart_value=float(i * 10)) for i in range(60)]
    feats = features(*rows)
    train = final_intent(feats).select("*", F.col("rule_intent").alias("label"))
    model = fit_forest(train, num_trees=5, max_depth=4)
    out = final_intent(feats, model=model).collect()
    for r in out:
        if r.calibrated_confidence >= 0.6:
            assert r.method == "rule_based" and r.intent == r.rule_intent
        else:
            assert r.method == "ml_ensemble" and 0.0 <= r.confidence <= 1.0
