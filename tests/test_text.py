"""Keyword signals, first balanced JSON object, planner and enrichment resolution."""

import pytest
from pyspark.sql import functions as F

from shoptide.operators.text import first_json_object, keyword_flags, planner_resolution, slm_resolution


@pytest.mark.parametrize("q,expected", [
    ("cheap laptop deals sale", dict(price_sensitive=True, brand_loyal=False, comparison_shopping=True, urgency=False)),
    ("nike running shoes", dict(price_sensitive=False, brand_loyal=True, comparison_shopping=False, urgency=False)),
    ("best laptop compare vs macbook", dict(price_sensitive=False, brand_loyal=False, comparison_shopping=True, urgency=False)),
    ("need it now today asap", dict(price_sensitive=False, brand_loyal=False, comparison_shopping=False, urgency=True)),
    ("shirt", dict(price_sensitive=False, brand_loyal=False, comparison_shopping=False, urgency=False)),
    ("", dict(price_sensitive=False, brand_loyal=False, comparison_shopping=False, urgency=False)),
])
def test_keyword_flags(spark, q, expected):
    df = spark.createDataFrame([(q,)], "q string")
    r = df.select(*[c.alias(n) for n, c in keyword_flags(F.col("q")).items()]).first().asDict()
    assert r == expected


CASES = {
    'Here is my plan: {"action": "OFFER_BUNDLE", "confidence": 0.8} thanks':
        '{"action": "OFFER_BUNDLE", "confidence": 0.8}',
    '```json\n{"action": "SEND_TO_HUMAN", "reasoning": "a } inside"}\n```':
        '{"action": "SEND_TO_HUMAN", "reasoning": "a } inside"}',
    '{"a": {"b": {"c": "x\\"}"}}, "d": 1} trailing {"e": 2}':
        '{"a": {"b": {"c": "x\\"}"}}, "d": 1}',
    "no json at all": None,
    "{unbalanced": None,
    'p{margin:0} then {"action": "X"}': "{margin:0}",
    'escaped \\{ brace {"k": "v"}': None,  # starts at the first brace; never closes
    "ends with backslash {\\": None,
    "": None,
}


def test_first_json_expected(spark):
    items = list(CASES.items())
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(items)], "i int, t string")
    got = {r.i: r.j for r in df.select("i", first_json_object(F.col("t")).alias("j")).collect()}
    assert got == {i: e for i, (_, e) in enumerate(items)}


def test_planner_resolution(spark):
    rows = [("a", '```json\n{"action": "OFFER_BUNDLE", "confidence": 0.8}\n```', None),
            ("b", '{"reasoning": "only"}', None),
            ("c", "I suggest SEND_TO_HUMAN or OFFER_DISCOUNT", None),
            ("d", "{not json}", None),
            ("e", None, "timeout")]
    df = spark.createDataFrame(rows, "session_id string, text string, error string")
    out = {r.session_id: r for r in planner_resolution(df).collect()}
    assert (out["a"].outcome, out["a"].action, out["a"].confidence) == ("parsed", "OFFER_BUNDLE", 0.8)
    assert (out["b"].action, out["b"].confidence, out["b"].reasoning) == ("NO_ACTION", 0.5, "only")
    assert (out["c"].outcome, out["c"].action, out["c"].confidence) == ("keyword_fallback", "OFFER_DISCOUNT", 0.6)
    assert out["d"].outcome == "keyword_fallback" and out["d"].action == "NO_ACTION"
    assert (out["e"].outcome, out["e"].action, out["e"].confidence) == ("error", "NO_ACTION", 0.0)


def test_slm_resolution_defaults(spark):
    df = spark.createDataFrame([("a", '{"intent": "CARTING", "confidence": 0.9}'), ("b", "{}"), ("c", ""), ("d", "nope")],
                               "session_id string, text string")
    out = {r.session_id: (r.ext_intent, r.ext_confidence) for r in slm_resolution(df).collect()}
    assert out == {"a": ("CARTING", 0.9), "b": ("BROWSING", 0.0)}
