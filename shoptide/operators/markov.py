"""Markov next-state prediction from an action history.

The current state is the mapped last action. The next state starts from the
current state's fixed transition row; every add_to_cart / checkout_start /
search_query in the history adds its boost to one state (accumulated one
addition at a time, so float ties resolve exactly as repeated addition does).
Values are normalised by their sum in insertion order and the maximum wins;
ties go to the first inserted state (row order, then boosted states absent from
the row in order of their first appearance in the history).

Only counts, the last action and first-appearance keys are needed, so the
running form needs no per-session list.

Repeated addition is not replayed. Between two powers of two the doubles are
evenly spaced, so each addition moves the sum by the same rounded step; the
sums of one (base, step) are a few dozen straight pieces up to the point where
a further addition no longer changes the sum. These pieces are made once from
the fixed transition rows and looked up by the count, so a session of any
length costs the same.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoptide.schema import MARKOV_ACTION_TO_STATE, MARKOV_BOOSTS, MARKOV_TRANSITIONS


def current_state(last_action: Column) -> Column:
    """LANDING for an empty history (null last action); unknown actions -> BROWSING."""
    m = F.create_map(*[F.lit(x) for kv in MARKOV_ACTION_TO_STATE.items() for x in kv])
    return F.when(last_action.isNull(), F.lit("LANDING")).otherwise(
        F.coalesce(m[last_action], F.lit("BROWSING"))
    )


def sum_pieces(base: float, step: float) -> list[tuple[int, float, float]]:
    """(first count, sum at that count, rounded step) of ``base + step + step + ...``.

    For a count c in a piece the sum is exactly ``sum + (c - first) * rounded step``.
    A piece ends where the sum passes a power of two or where a tie in rounding
    makes one step differ (at most once between two powers); the last piece has
    step 0 or reaches past any 64-bit count.
    """
    pieces, count, x = [], 0, base
    while count < 2**63:
        moved = (x + step) - x
        if moved == 0.0:
            pieces.append((count, x, 0.0))
            break
        limit = math.ldexp(1.0, math.frexp(x)[1]) if x > 0.0 else 0.0
        inside = 0
        if x + step < limit and (x + step + step >= limit or (x + step + step) - (x + step) == moved):
            inside = math.ceil((Fraction(limit) - Fraction(x)) / Fraction(moved)) - 1
        pieces.append((count, x, moved))
        x, count = x + inside * moved + step, count + inside + 1
    return pieces


def _pieces(base: float, step: float) -> Column:
    return F.array(*[F.struct(F.lit(c).cast("long").alias("c"), F.lit(x).alias("x"), F.lit(d).alias("d"))
                     for c, x, d in sum_pieces(base, step)])


def _sum_after(pieces: Column, n: Column) -> Column:
    """The sum after ``n`` additions, from the pieces of its base and step."""
    n = n.cast("long")
    piece = F.array_max(F.filter(pieces, lambda p: p["c"] <= n))
    return piece["x"] + (n - piece["c"]).cast("double") * piece["d"]


def _row_pieces(target: str, step: float) -> Column:
    """Literal map: state whose transition row has ``target`` -> pieces from the row's value."""
    kv = []
    for st, row in MARKOV_TRANSITIONS.items():
        if target in row:
            kv += [F.lit(st), _pieces(float(row[target]), step)]
    return F.create_map(*kv) if kv else F.lit(None).cast("map<string,array<struct<c:bigint,x:double,d:double>>>")


def _rows_map() -> Column:
    """Literal map: state -> array<struct<r, s, v>> (the fixed transition rows)."""
    kv = []
    for st, row in MARKOV_TRANSITIONS.items():
        kv.append(F.lit(st))
        kv.append(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(t).alias("s"), F.lit(float(p)).alias("v"))
                            for r, (t, p) in enumerate(row.items())]))
    return F.create_map(*kv)


def _is_state(target: str):
    return lambda x: x["s"] == F.lit(target)


def next_state(state: Column, counts: dict[str, Column], first_keys: dict[str, Column]) -> Column:
    """Predicted next state.

    counts: action -> occurrences in the history (add_to_cart, checkout_start, search_query).
    first_keys: action -> orderable key of its first occurrence (null when absent).
    Unknown current state (no transition row) -> EXIT.
    """
    base = F.element_at(_rows_map(), state)

    def boost(s: Column, v: Column) -> Column:
        out = None
        for action, target, inc in MARKOV_BOOSTS:
            val = _sum_after(F.element_at(_row_pieces(target, inc), state), counts[action])
            out = F.when(s == target, val) if out is None else out.when(s == target, val)
        return out.otherwise(v)

    boosted = F.transform(base, lambda x: F.struct(F.lit(0).alias("g"), x["r"].alias("r"), x["s"].alias("s"),
                                                  boost(x["s"], x["v"]).alias("v")))
    appended = []
    for a, target, inc in MARKOV_BOOSTS:
        # insertion rank among appended states = how many boosted actions appeared earlier
        earlier = sum(
            (F.when((counts[b] > 0) & (first_keys[b] < first_keys[a]), 1).otherwise(0)
             for b, _, _ in MARKOV_BOOSTS if b != a),
            F.lit(0),
        )
        absent = ~F.exists(base, _is_state(target))
        appended.append(F.when((counts[a] > 0) & absent, F.struct(
            F.lit(1).alias("g"), earlier.alias("r"), F.lit(target).alias("s"),
            _sum_after(_pieces(0.0, inc), counts[a]).alias("v"))))
    arr = F.array_sort(F.concat(boosted, F.filter(F.array(*appended), lambda x: x.isNotNull())))
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x["v"])
    ranked = F.transform(arr, lambda x, i: F.struct((x["v"] / total).alias("p"), (-i).alias("neg_i"), x["s"].alias("s")))
    return F.when(base.isNull(), F.lit("EXIT")).otherwise(F.array_max(ranked)["s"])


def markov_columns(df: DataFrame, last_action: str = "last_action") -> DataFrame:
    """Add ``current_state`` and ``predicted_next_state`` from counter columns
    (cart_adds, checkouts, searches), first-occurrence keys (first_add_key,
    first_checkout_key, first_search_key) and the last action."""
    counts = {"add_to_cart": F.col("cart_adds"), "checkout_start": F.col("checkouts"),
              "search_query": F.col("searches")}
    keys = {"add_to_cart": F.col("first_add_key"), "checkout_start": F.col("first_checkout_key"),
            "search_query": F.col("first_search_key")}
    return df.withColumn("current_state", current_state(F.col(last_action))).withColumn(
        "predicted_next_state", next_state(F.col("current_state"), counts, keys)
    )


def session_markov(clicks: DataFrame) -> DataFrame:
    """Per session: last action, counters and first-occurrence keys -> states.

    One grouped aggregate (partial aggregation before the shuffle)."""
    k = F.struct("timestamp", "event_id")
    first = lambda a: F.min(F.when(F.col("action") == a, k))
    cnt = lambda a: F.sum(F.when(F.col("action") == a, 1).otherwise(0))
    g = clicks.groupBy("session_id").agg(
        F.max_by("action", k).alias("last_action"),
        cnt("add_to_cart").alias("cart_adds"),
        cnt("checkout_start").alias("checkouts"),
        cnt("search_query").alias("searches"),
        first("add_to_cart").alias("first_add_key"),
        first("checkout_start").alias("first_checkout_key"),
        first("search_query").alias("first_search_key"),
    )
    return markov_columns(g).select("session_id", "last_action", "current_state", "predicted_next_state")
