"""Routing boundaries, critic outcomes, closed-loop texts, graph neighbours."""

import pytest

from shoptide.operators.graph import customer_affinity, product_graph
from shoptide.operators.routing import critic_resolution, route
from shoptide.operators.vectors import closed_loop, decision_traces


@pytest.mark.parametrize("conf,intent,er,threshold,expected", [
    (0.85, "BROWSE", 0.2, 0.7, "system_1"), (0.60, "BROWSE", 0.2, 0.7, "system_2"),
    (0.70, "BROWSE", 0.2, 0.7, "system_1"), (0.699, "BROWSE", 0.2, 0.7, "system_2"),
    (0.71, "BROWSE", 0.2, 0.7, "system_1"), (0.90, "CHURN_RISK", 0.2, 0.7, "system_2"),
    (0.90, "LOYAL_RETURNER", 0.2, 0.7, "system_2"), (0.85, "BROWSE", 0.7, 0.7, "system_2"),
    (0.85, "BROWSE", 0.3, 0.7, "system_1"), (None, "BROWSE", 0.2, 0.7, "system_1"),
    (0.65, "BROWSE", 0.2, 0.6, "system_1"), (0.55, "BROWSE", 0.2, 0.6, "system_2"),
    (0.50, "CHURN_RISK", 0.2, 0.7, "system_2"), (0.95, "BROWSE", 0.2, 0.7, "system_1"),
    (0.40, "COMPARE", 0.2, 0.7, "system_2"), (0.85, "BROWSE", None, 0.7, "system_1"),
])
def test_route(spark, conf, intent, er, threshold, expected):
    df = spark.createDataFrame([("s", conf, intent, er)], "session_id string, confidence double, intent string, exploration_ratio double")
    assert route(df, threshold=threshold).first().system == expected


def test_critic(spark):
    props = spark.createDataFrame([("a", "LOYALTY_REWARD", "ok", True), ("b", "APPLY_DISCOUNT", "x", False),
                                   ("c", "APPLY_DISCOUNT", "x", False), ("d", "SHOW_URGENCY", "x", None)],
                                  "session_id string, action string, reasoning string, allowed boolean")
    rw = spark.createDataFrame([("b", "FREE_SHIPPING", "cheaper")], "session_id string, rewrite_action string, rewrite_reasoning string")
    out = {r.session_id: r for r in critic_resolution(props, rw).collect()}
    assert (out["a"].final_action, out["a"].source) == ("LOYALTY_REWARD", "system_2_critic_approved")
    assert (out["b"].final_action, out["b"].final_reasoning, out["b"].source) == (
        "FREE_SHIPPING", "Critic rewrite: cheaper", "system_2_critic_rewrite")
    assert (out["c"].final_action, out["c"].final_reasoning) == ("NO_ACTION", "OPA denied 'APPLY_DISCOUNT': policy violation")
    assert out["d"].source == "system_2_critic_rejected"   # policy unreachable = denied
    strict = {r.session_id: r for r in critic_resolution(props, rw, enforce_whitelist=True).collect()}
    assert strict["b"].final_action == "NO_ACTION"


def test_closed_loop_texts(spark):
    df = spark.createDataFrame([("a", "BROWSE", "RECOMMEND_ALTERNATIVE", "RECOMMEND_ALTERNATIVE", True),
                                ("b", "COMPARE", "SHOW_COMPARISON_TOOL", "NO_ACTION", False)],
                               "session_id string, intent string, proposed_action string, action string, allowed boolean")
    out = {r.session_id: r for r in closed_loop(df).collect()}
    assert out["a"].result == "EXECUTED:RECOMMEND_ALTERNATIVE"
    assert out["b"].result == "DENIED:SHOW_COMPARISON_TOOL"
    assert out["b"].summary == "User exhibited COMPARE intent. SLM proposed SHOW_COMPARISON_TOOL. OPA verdict: DENIED."
    traces = decision_traces(closed_loop(df)).collect()
    assert [t.session_id for t in traces] == ["b"] and len(traces[0].trace_id) == 16


def test_product_graph_neighbours(spark):
    part = spark.createDataFrame([
        (1, "alpha", "B1", "T", 5, 10.0), (2, "beta", "B1", "T", 7, 20.0), (3, "gamma", "B2", "T", 5, 30.0),
        (4, "alpha", "B1", "U", 8, 40.0), (5, "delta", "B9", "T", 50, 50.0)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    li = spark.createDataFrame([(100, 1), (100, 2), (100, 3), (101, 1), (101, 4), (102, 2)], "l_orderkey long, l_partkey long")
    out = {r.product_id: r for r in product_graph(part, li, max_results=5).collect()}
    assert out[1].complementary == ["alpha", "beta", "gamma"]   # part 4 is also named alpha
    assert out[1].similar == ["alpha", "beta"] and out[1].popularity == 2
    assert out[3].complementary == ["alpha", "beta"] and out[3].similar == []
    assert out[5].complementary == [] and out[5].popularity == 0
    ranks = sorted((r.category, r.rank, r.product_id) for r in out.values())
    assert ranks[:2] == [("T", 1, 1), ("T", 2, 2)]


def test_customer_affinity(spark):
    part = spark.createDataFrame([(1, "T", 10.0), (2, "T", 5.0), (3, "U", 1.0)], "p_partkey long, p_type string, p_retailprice double")
    orders = spark.createDataFrame([(10, 7), (11, 7)], "o_orderkey long, o_custkey long")
    li = spark.createDataFrame([(10, 1), (10, 2), (11, 3), (11, 1)], "l_orderkey long, l_partkey long")
    out = sorted((r.category, r.purchase_count, r.total_spent, r.rank, r.top_category, r.total_categories)
                 for r in customer_affinity(orders, li, part).collect())
    assert out == [("T", 3, 25.0, 1, "T", 2), ("U", 1, 1.0, 2, "T", 2)]
