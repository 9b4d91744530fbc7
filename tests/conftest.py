import os
import sys
import tempfile
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

T0 = datetime(2024, 1, 1, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    from shoptide.session import build_session, checkpoint_dir

    folder = tempfile.mkdtemp(prefix="shoptide-tests-")
    s = build_session(master="local[4]", shuffle_partitions=4, extra={
        "spark.driver.memory": "4g", "spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": f"{folder}/warehouse"})
    assert folder in checkpoint_dir(s)
    yield s


def click_rows(spec, session="s1", customer="c1"):
    """spec: list of (action, value, seconds_offset[, category])."""
    rows = []
    for i, item in enumerate(spec):
        action, value, sec = item[:3]
        cat = item[3] if len(item) > 3 else "electronics"
        rows.append((f"e{i:04d}", session, customer, T0 + timedelta(seconds=sec), action, None, cat, value, "{}"))
    return rows


CLICK_SCHEMA = ("event_id string, session_id string, customer_id string, timestamp timestamp_ntz, action string, "
                "product_id string, category string, value double, metadata string")


@pytest.fixture
def clicks(spark):
    def make(spec, session="s1", customer="c1"):
        return spark.createDataFrame(click_rows(spec, session, customer), CLICK_SCHEMA)
    return make


FEATURE_DEFAULTS = dict(
    session_id="s1", customer_id=None, session_duration_sec=0.0, total_actions=0, page_views=0, cart_adds=0,
    cart_removes=0, checkouts=0, searches=0, purchases=0, total_cart_value=0.0, max_item_value=0.0,
    avg_item_value=0.0, categories_viewed=0, category_switches=0, cart_conversion_rate=0.0,
    checkout_conversion_rate=0.0, cart_abandon_rate=0.0, exploration_ratio=0.0, cart_value_per_minute=0.0,
    avg_inter_event_time=0.0, repeat_customer=False, days_since_last_purchase=None,
)
FEATURE_SCHEMA = (
    "session_id string, customer_id string, session_duration_sec double, total_actions long, page_views long, "
    "cart_adds long, cart_removes long, checkouts long, searches long, purchases long, total_cart_value double, "
    "max_item_value double, avg_item_value double, categories_viewed long, category_switches long, "
    "cart_conversion_rate double, checkout_conversion_rate double, cart_abandon_rate double, "
    "exploration_ratio double, cart_value_per_minute double, avg_inter_event_time double, "
    "repeat_customer boolean, days_since_last_purchase int"
)


@pytest.fixture
def features(spark):
    def make(*rows):
        data = []
        for r in rows:
            d = dict(FEATURE_DEFAULTS)
            d.update(r)
            data.append(tuple(d[k] for k in FEATURE_DEFAULTS))
        return spark.createDataFrame(data, FEATURE_SCHEMA)
    return make
