"""Rows with null keys or times come out of every scan; responses are parsed strictly."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from shoptide.functions.running import running_scan
from shoptide.operators.sessions import running_features, session_features, sessionize
from shoptide.operators.stores import history_enrich
from shoptide.operators.text import planner_resolution, slm_resolution
from shoptide.plans.pipeline import enriched_features
from shoptide.session import checkpoint_dir

from conftest import CLICK_SCHEMA, T0


def events(spark):
    rows = [("e1", None, "c1", 0), ("e2", "s9", None, 5), ("e3", None, "c1", 9), ("e4", None, None, 11), ("e5", "s9", None, 3 * 86400)]
    return spark.createDataFrame(
        [(e, s, c, T0 + timedelta(seconds=t), "purchase_complete" if e == "e2" else "page_view", None, "x", 1.0, "{}") for e, s, c, t in rows], CLICK_SCHEMA)


def test_sessionize_keeps_anonymous_events(spark):
    out = {r.event_id: (r.customer_id, r.session_id) for r in sessionize(events(spark)).collect()}
    assert out == {"e1": ("c1", "c1_1"), "e3": ("c1", "c1_1"), "e2": (None, "s9"), "e5": (None, "s9"), "e4": (None, "anonymous_e4")}


def test_features_and_history_keep_anonymous_sessions(spark):
    clicks = sessionize(events(spark))
    assert session_features(clicks).count() == 3 and running_features(clicks).count() == 5
    assert {r.session_id: r.repeat_customer for r in history_enrich(clicks).collect()} == {"c1_1": False, "s9": False, "anonymous_e4": False}
    assert enriched_features(clicks).count() == 3


def test_scan_with_null_keys_and_chunks(spark):
    rows = [(None, 0, 1, "a"), (None, 1, 2, "b"), ("k", None, 3, "a"), ("k", 0, 4, "a"), ("k", 1, 5, None), ("k", 1, 6, "c")]
    df = spark.createDataFrame(rows, "k string, c int, v int, d string")
    out = running_scan(df, by=["k"], chunk="c", order=["v"], aggs={"s": ("sum", F.col("v"))}, prev={"p": F.col("v")},
                       pairsums={"up": (F.col("v"), lambda a, b: F.when(a > b, 1).otherwise(0))}, distincts={"n": F.col("d")})
    got = sorted((r.v, r.s, r.p, r.up, r.n) for r in out.collect())
    assert got == [(1, 1, None, 0, 1), (2, 3, 1, 1, 2), (3, 3, None, 0, 1), (4, 7, 3, 1, 1), (5, 12, 4, 2, 1), (6, 18, 5, 3, 2)]


@pytest.mark.parametrize("text, expected", [
    ('{"confidence":"0.8"}', ("BROWSING", 0.8, "")), ("{}", ("BROWSING", 0.0, "")), (' {"intent":"CARTING","confidence":1}\n', ("CARTING", 1.0, "")),
    ("[1]", None), ('"x"', None), ('{"intent":"A"} tail', None), ("{'intent':'A'}", None), ('{"confidence":"high"}', None), ("", None), (None, None),
])
def test_enrichment_replies(spark, text, expected):
    out = slm_resolution(spark.createDataFrame([("s", text)], "session_id string, text string")).collect()
    assert [(r.ext_intent, r.ext_confidence, r.ext_reasoning) for r in out] == ([] if expected is None else [expected])


def test_planner_replies(spark):
    rows = [("a", "{'action':'OFFER_BUNDLE'}"), ("b", '{"action":"X","reasoning":"one\ntwo"}'), ("c", 'so {"action":"X","confidence":"0.7"} ok')]
    out = {r.session_id: r for r in planner_resolution(spark.createDataFrame([(i, t, None) for i, t in rows], "session_id string, text string, error string")).collect()}
    assert (out["a"].outcome, out["a"].action, out["a"].confidence) == ("keyword_fallback", "OFFER_BUNDLE", 0.6)
    assert (out["b"].outcome, out["b"].action, out["b"].confidence) == ("keyword_fallback", "NO_ACTION", 0.6)
    assert (out["c"].outcome, out["c"].action, out["c"].confidence) == ("parsed", "X", 0.7)


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
