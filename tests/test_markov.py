"""Markov current/next state, including float-accumulation ties."""

import numpy as np
import pytest

from shoptide.schema import MARKOV_BOOSTS
from pyspark.sql import functions as F

from shoptide.operators.markov import session_markov, sum_pieces
from shoptide.schema import MARKOV_ACTION_TO_STATE, MARKOV_TRANSITIONS


def py_next(state, history):
    """Independent restatement: values in insertion order, boosts added one
    occurrence at a time, normalised, first maximum wins."""
    row = MARKOV_TRANSITIONS.get(state)
    if row is None:
        return "EXIT"
    order = list(row)
    value = {k: float(v) for k, v in row.items()}
    boost = {act: (st, inc) for act, st, inc in MARKOV_BOOSTS}
    for a in history:
        if a in boost:
            st, inc = boost[a]
            if st not in value:
                order.append(st)
                value[st] = 0.0
            value[st] = value[st] + inc
    total = 0.0
    for k in order:
        total = total + value[k]
    best, best_p = None, None
    for k in order:
        p = value[k] / total
        if best is None or p > best_p:
            best, best_p = k, p
    return best


def run(clicks, history):
    df = clicks([(a, None, i) for i, a in enumerate(history)])
    return session_markov(df).collect()[0]


@pytest.mark.parametrize("history,state", [
    (["page_view"], "BROWSING"), (["checkout_start"], "CHECKOUT"), (["purchase_complete"], "PURCHASE"),
    (["page_view", "add_to_cart"], "CARTING"), (["filter_apply"], "BROWSING"),
])
def test_current_state(clicks, history, state):
    assert run(clicks, history).current_state == state


def test_checkout_boost(clicks):
    # CARTING row + one checkout -> CHECKOUT (0.3 + 0.3 beats 0.4)
    r = run(clicks, ["add_to_cart", "checkout_start", "add_to_cart"])
    assert r.current_state == "CARTING"
    assert r.predicted_next_state == py_next("CARTING", ["add_to_cart", "checkout_start", "add_to_cart"])


def test_random_histories_match_restatement(spark):
    rng = np.random.default_rng(7)
    acts = ["page_view", "add_to_cart", "checkout_start", "search_query", "purchase_complete", "remove_from_cart",
            "filter_apply"]
    rows, expect = [], {}
    for s in range(300):
        n = int(rng.integers(1, 14))
        hist = [acts[i] for i in rng.integers(0, len(acts), n)]
        state = MARKOV_ACTION_TO_STATE.get(hist[-1], "BROWSING")
        expect[f"s{s}"] = (state, py_next(state, hist))
        for i, a in enumerate(hist):
            rows.append((f"s{s}", f"e{i:03d}", a, i))
    df = spark.createDataFrame(rows, "session_id string, event_id string, action string, sec int").withColumn(
        "timestamp", F.timestamp_seconds(F.col("sec")).cast("timestamp_ntz"))
    got = {r.session_id: (r.current_state, r.predicted_next_state) for r in session_markov(df).collect()}
    assert got == expect


@pytest.mark.parametrize("base", sorted({0.0} | {float(v) for row in MARKOV_TRANSITIONS.values() for v in row.values()}))
@pytest.mark.parametrize("step", sorted({inc for _, _, inc in MARKOV_BOOSTS} | {0.1, 0.7, 1 / 3}))
def test_pieces_equal_repeated_addition(base, step):
    pieces = sum_pieces(base, step)
    assert len(pieces) < 200 and pieces[0][0] == 0 and all(a[0] < b[0] for a, b in zip(pieces, pieces[1:]))
    n = 200_000
    sums = np.cumsum(np.concatenate([[base], np.full(n, step)]))  # one addition after another
    at = np.searchsorted([c for c, _, _ in pieces], np.arange(n + 1), side="right") - 1
    first, start, moved = (np.array(v) for v in zip(*pieces))
    assert np.array_equal(start[at] + (np.arange(n + 1) - first[at]) * moved[at], sums)


def test_pieces_with_ties_in_rounding():
    """Steps whose last bit falls on half a spacing: rounding to even alternates once, then settles."""
    for step in (1.0 + 2.0**-52, 1.0 + 3 * 2.0**-52, 1.5 + 2.0**-52):
        for base in (0.0, 1.0, 1.0 + 2.0**-52, 3.0 + 2.0**-51):
            x, pieces = base, sum_pieces(base, step)
            for n in range(2_000):
                c, s, d = max(p for p in pieces if p[0] <= n)
                assert s + (n - c) * d == x, (step, base, n)
                x = x + step


def test_ten_million_events_of_one_action(spark):
    """Ten million searches in one session: the counts decide, no array is built."""
    n = 10_000_000
    df = spark.range(n).select(
        F.lit("s").alias("session_id"), F.format_string("e%08d", F.col("id")).alias("event_id"),
        F.when(F.col("id") == n - 1, "add_to_cart").otherwise("search_query").alias("action"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("timestamp"))
    r = session_markov(df).collect()[0]
    assert (r.current_state, r.predicted_next_state) == ("CARTING", py_next("CARTING", ["search_query"] * 1000 + ["add_to_cart"]))
