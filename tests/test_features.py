"""Exact feature values (the reference's feature-engineering cases)."""

import pytest

from shoptide.operators.sessions import running_features, session_features


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_single_page_view(clicks):
    f = one(session_features(clicks([("page_view", None, 0)])))
    assert f.page_views == 1 and f.session_duration_sec == 0.0 and f.avg_inter_event_time == 0.0


def test_cart_abandon_rate(clicks):
    f = one(session_features(clicks([("page_view", None, 0), ("add_to_cart", 50.0, 10), ("remove_from_cart", 50.0, 20)])))
    assert f.cart_abandon_rate == 1.0


def test_duration(clicks):
    f = one(session_features(clicks([("page_view", None, 0), ("page_view", None, 600)])))
    assert f.session_duration_sec == 600.0


def test_categories_and_switches(clicks):
    f = one(session_features(clicks([("page_view", None, 0, "A"), ("page_view", None, 10, "B"), ("page_view", None, 20, "A")])))
    assert f.categories_viewed == 2 and f.category_switches == 2


def test_cart_value_per_minute(clicks):
    f = one(session_features(clicks([("add_to_cart", 120.0, 0), ("add_to_cart", 120.0, 240)])))
    assert f.total_cart_value == 240.0
    assert f.cart_value_per_minute == pytest.approx(240 / 5)


def test_exploration_ratio(clicks):
    f = one(session_features(clicks([("page_view", None, 0, "A"), ("page_view", None, 10, "B"), ("page_view", None, 20, "C")])))
    assert f.exploration_ratio == pytest.approx(2 / 3)


def test_action_sequence_order(clicks):
    f = one(session_features(clicks([("search_query", None, 0), ("page_view", None, 10), ("add_to_cart", 5.0, 20)]),
                             include_sequence=True))
    assert f.action_sequence == ["search_query", "page_view", "add_to_cart"]


def test_checkout_conversion(clicks):
    f = one(session_features(clicks([("add_to_cart", 1.0, 0), ("add_to_cart", 1.0, 1), ("checkout_start", None, 2)])))
    assert f.checkout_conversion_rate == 0.5


def test_avg_inter_event_time(clicks):
    f = one(session_features(clicks([("page_view", None, 0), ("page_view", None, 30), ("page_view", None, 60)])))
    assert f.avg_inter_event_time == 30.0


def test_many_same_time(clicks):
    f = one(session_features(clicks([("page_view", None, 0)] * 100)))
    assert f.total_actions == 100


def test_null_and_empty_category_is_unknown(clicks):
    f = one(session_features(clicks([("page_view", None, 0, None), ("page_view", None, 1, ""), ("page_view", None, 2, "A")])))
    assert f.categories_viewed == 2 and f.category_switches == 1


def test_running_features_match_prefixes(clicks):
    spec = [("page_view", 1.0, 0, "A"), ("add_to_cart", 5.0, 4000, "B"), ("page_view", None, 8000, "A"),
            ("checkout_start", None, 9000, "C"), ("remove_from_cart", 5.0, 20000, "C")]
    df = clicks(spec)
    run = {r.event_id: r for r in running_features(df, chunk_seconds=3600).collect()}
    for n in range(1, len(spec) + 1):
        whole = one(session_features(clicks(spec[:n])))
        r = run[f"e{n - 1:04d}"]
        for c in ["total_actions", "page_views", "cart_adds", "categories_viewed", "category_switches",
                  "total_cart_value", "max_item_value", "session_duration_sec", "exploration_ratio"]:
            assert getattr(r, c) == pytest.approx(getattr(whole, c)), (n, c)


def test_bounded_running_features(clicks):
    spec = [("page_view", 1.0, i * 10, "A" if i % 2 else "B") for i in range(6)]
    rows = sorted(running_features(clicks(spec), max_events=3).collect(), key=lambda r: r.event_id)
    assert [r.total_actions for r in rows] == [1, 2, 3, 3, 3, 3]
    assert [r.category_switches for r in rows] == [0, 1, 2, 2, 2, 2]


def test_features_for_unknown_session_defaults(spark, clicks):
    from shoptide.operators.intent import final_intent
    from shoptide.operators.sessions import features_for
    feats = session_features(clicks([("page_view", None, 0)]))
    req = spark.createDataFrame([("s1",), ("nope",)], "session_id string")
    rows = {r.session_id: r for r in final_intent(features_for(req, feats)).collect()}
    assert rows["s1"].page_views == 1
    assert rows["nope"].total_actions == 0 and rows["nope"].intent == "BROWSE"
    assert rows["nope"].confidence == pytest.approx(0.0759, abs=1e-4)
