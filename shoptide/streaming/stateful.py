"""The per-event decision loop as a stateful operator that repairs itself.

``applyInPandasWithState`` keyed by one of ``GROUPS`` hashes of session_id: most
sessions have few rows, so a call takes the sessions of a group and its state row
holds those that are open, each by itself. The state of a session is

* ``prefix``: counters, value sum and maximum, times, categories seen and the last
  dispatch over the events older than the watermark, which nothing can come
  before any more, and
* ``tail``: the later events, each with the decision that was given for it.

A batch's events are put among the tail in time order (a redelivery replaces the
event with its id), the tail is decided again from the prefix, and a decision
leaves the operator when it is new or no longer what was given before: a late
event repairs what follows it. What the watermark has passed is then folded into
the prefix. So the state of a session is a fixed number of scalars, its
categories (bounded by their vocabulary) and the events of the last
``watermark``, and a batch's work on it is as long as those and the batch's own.

An event-time timeout closes a session that has had no event for the TTL (a group
wakes for the first of its sessions): it gives a row of kind ``closed`` and the
state goes. Control rows (kind ``clear``) end a
session at their time: earlier events are decided as before, the state goes, a
row of kind ``cleared`` says so, and later events start anew; events that come
after it from before that time are given back as ``ignored``.

Scoring restates the hot path in one pass over a session's events (the same fixed
rules, calibration, actions, the policy with the customer context absent, guards
and cooldown). It works on plain values and each row crosses to Python as one
text. ``groups=None`` keeps a state row and a call for every session instead, which
costs milliseconds for each and batch. The batch job
:func:`shoptide.plans.pipeline.event_decisions` is the reference; the two are
checked to be equal.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shoptide.schema import (
    ACTION_MAP, ALWAYS_ALLOWED, CALIBRATION_A, CALIBRATION_B, COOLDOWN_MINUTES, INTENTS, NO_ACTION, SESSION_TTL_HOURS,
)

PREFIX = ("n long, page_views long, cart_adds long, cart_removes long, checkouts long, searches long, total_value double, "
          "first_us long, last_us long, last_cat string, switches long, cats array<string>, last_disp_us long, last_disp_action string, cleared_us long")
TAIL = {"event_id": "string", "us": "long", "action": "string", "category": "string", "value": "double",
        "intent": "string", "confidence": "double", "out_action": "string", "out_reason": "string"}
STATE_SCHEMA = PREFIX + "".join(f", tail_{name} array<{kind}>" for name, kind in TAIL.items())
GIVEN = ["kind", "event_id", "us", "action", "category", "value", "arrived"]
OUTPUT = ["kind", "session_id", "event_id", "us", "intent", "confidence", "proposed_action", "allowed", "dispatched", "action", "reason", "n_events"]
OUTPUT_ROWS = (
    "array<struct<kind string, session_id string, event_id string, us long, intent string, confidence double, "
    "proposed_action string, allowed boolean, dispatched boolean, action string, reason string, n_events long>>"
)
ROWS_AT_ONCE = 1000
#: State rows: a group's sessions are held at once, so the number is a multiple of any cluster's cores; it is fixed for a checkpoint.
GROUPS = 4096
GROUP_STATE = "sessions string"  # JSON of (session_id, its state, its timeout)
SUPPRESSED = "SUPPRESSED_WITHIN_15MIN"
EMPTY = (0, 0, 0, 0, 0, 0, 0.0, None, None, None, 0, [], None, None, None)

# Ship this module's functions by value to the Python workers, so they do not
# need the package on their import path.
try:  # pragma: no cover - depends on the installed pyspark
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass


def _scored(pv: int, adds: int, removes: int, checkouts: int, searches: int, cats: int, switches: int, n: int, total: float, duration: float):
    """Intent, confidence, proposed action, whether it is allowed, the guarded action and the guard's reason."""
    views = max(pv, 1.0)
    explored = max(0.0, min(1.0, switches / views))
    score = {
        "BROWSE": 3 * (pv > 5 and adds == 0) + 2 * (explored > 0.5),
        "COMPARE": 3 * (cats > 3 and adds == 0) + 2 * (pv > adds * 3),
        "CART_BUILDER": 3 * (adds > removes and total > 50) + 2 * (adds / views > 0.3),
        "CHECKOUT_INTENT": 4 * (checkouts > 0) + 2 * (total > 100 and explored < 0.3),
        "PRICE_SENSITIVE": 3 * (searches > 3) + 2 * (adds > 0 and removes / max(adds, 1.0) > 0.5),
        # the history inputs (repeat customer, days since purchase) are absent in the hot path
        "CHURN_RISK": 2 * (duration > 600 and adds == 0),
        "LOYAL_RETURNER": 2 * ((duration / (n - 1) if n > 1 else 0.0) < 30 and total > 100),
    }
    points = sum(score.get(i, 0) for i in INTENTS)
    best, intent = max((score.get(i, 0), i) for i in INTENTS)  # of equal scores the greatest name
    raw = min(best / points, 1.0) if points else 0.0
    intent = intent if points else "BROWSE"
    proposed = ACTION_MAP.get(intent, NO_ACTION)
    allowed = proposed in ALWAYS_ALLOWED or (proposed == "SEND_ABANDON_EMAIL" and duration > 300 and adds > 0 and checkouts == 0)
    guarded, why = proposed, ""
    if proposed == "APPLY_DISCOUNT" and total < 50:
        guarded, why = NO_ACTION, "MIN_CART_VALUE_NOT_MET"
    elif proposed == "SHOW_URGENCY" and checkouts == 0:
        guarded, why = NO_ACTION, "NO_CHECKOUT_STARTED"
    return intent, 1.0 / (1.0 + math.exp(-(CALIBRATION_A * raw + CALIBRATION_B))), proposed, allowed, guarded, why


def _load(state: GroupState) -> tuple[tuple, list[tuple]]:
    if not state.exists:
        return EMPTY, []
    held = tuple(state.get)
    return held[:len(EMPTY)], list(zip(*held[len(EMPTY):]))


def _stored(prefix: tuple, tail: list[tuple]) -> tuple:
    return (*prefix, *([list(column) for column in zip(*tail)] if tail else [[] for _ in TAIL]))


def _note(kind: str, session: str, prefix: tuple, tail: list[tuple], us: int | None) -> tuple:
    return (kind, session, None, us, *[None] * 7, int(prefix[0]) + len(tail))


def _in_time(event: tuple) -> tuple:
    return event[1], event[0] is None, event[0]


def _decide(session: str, prefix: tuple, tail: list[tuple], new: list[tuple], mark_us: int, cooldown_us: int) -> tuple[tuple, list[tuple], list[tuple]]:
    """(prefix, tail, decisions that are new or have changed) after the new events, in one pass over the tail."""
    arrived = {e[0]: e for e in new}  # the last of repeated ids
    given = {e[0]: e[5:] for e in tail}  # a redelivery replaces an event, not what was given for it
    tail = [e for e in tail if e[0] not in arrived] + [(*e, *given.get(e[0], (None,) * 4)) for e in arrived.values()]
    tail.sort(key=_in_time)
    n, pv, adds, removes, checkouts, searches, total, first, _, last_cat, switches, cats, last_us, last_action, cleared = prefix
    held, folded, kept, out = cats or [], 0, [], []
    cats = set(held)
    for event_id, us, action, category, value, *old in tail:
        seen = category or "unknown"
        n += 1
        pv += action == "page_view"
        adds += action == "add_to_cart"
        removes += action == "remove_from_cart"
        checkouts += action == "checkout_start"
        searches += action == "search_query"
        total += value if value is not None and value == value else 0.0
        switches += last_cat is not None and seen != last_cat
        last_cat = seen
        cats.add(seen)
        first = us if first is None else first
        intent, confidence, proposed, allowed, guarded, why = _scored(
            pv, adds, removes, checkouts, searches, len(cats), switches, n, total, (us - first) / 1e6)
        cooling = last_us is not None and us - last_us < cooldown_us
        fired = allowed and guarded != NO_ACTION and not cooling
        if fired:
            done, reason, last_us, last_action = guarded, None, us, guarded
        elif cooling and (proposed == last_action or allowed):
            done, reason = NO_ACTION, SUPPRESSED
        else:
            done, reason = NO_ACTION, why if allowed else ""
        now = (intent, confidence, done, reason)
        if old[2] is None or tuple(old) != now:
            out.append(("decision" if old[2] is None else "correction", session, event_id, us, intent, confidence, proposed, allowed, fired, done, reason, n))
        if us < mark_us:  # nothing comes before it any more
            folded += 1
            prefix = (n, pv, adds, removes, checkouts, searches, total, first, us, last_cat, switches, held, last_us, last_action, cleared)
        kept.append((event_id, us, action, category, value, *now))
    if folded:
        prefix = (*prefix[:11], sorted({*held, *(e[3] or "unknown" for e in tail[:folded])}), *prefix[12:])
    return prefix, kept[folded:], out


def _advance(session: str, given: list[tuple], state: GroupState, cooldown_us: int, ttl_ms: int) -> list[tuple]:
    """Rows of ``OUTPUT`` after the rows of one session (as ``GIVEN``; none when its time has run out)."""
    prefix, tail = _load(state)
    if state.hasTimedOut:
        state.remove()
        if prefix[0] or tail:
            return [_note("closed", session, prefix, tail, max(e[1] for e in tail) if tail else prefix[8])]
        return []
    mark_ms = max(0, state.getCurrentWatermarkMs())
    ordered = sorted((g for g in given if g[0] == "event"), key=lambda g: (*_in_time(g[1:]), g[6] is None, g[6]))
    events, out = [g[1:6] for g in ordered], []
    for clear_us in sorted({int(g[2]) for g in given if g[0] == "clear"}):
        before, events = [e for e in events if e[1] < clear_us], [e for e in events if e[1] >= clear_us]
        later = [e[:5] for e in tail if e[1] >= clear_us]
        prefix, ended, decided = _decide(session, prefix, [e for e in tail if e[1] < clear_us], before, mark_ms * 1000, cooldown_us)
        out += [*decided, _note("cleared", session, prefix, ended, clear_us)]
        prefix, tail, events = (*EMPTY[:14], clear_us), [], later + events
    if prefix[14] is not None:
        out += [("ignored", session, e[0], e[1], *[None] * 8) for e in events if e[1] < prefix[14]]
        events = [e for e in events if e[1] >= prefix[14]]
    if events:
        prefix, tail, decided = _decide(session, prefix, tail, events, mark_ms * 1000, cooldown_us)
        out += decided
    last = max([x for x in (prefix[8], prefix[14], max(e[1] for e in tail) if tail else None) if x is not None], default=0)
    state.update(_stored(prefix, tail))
    state.setTimeoutTimestamp(max(int(last) // 1000 + ttl_ms, mark_ms + 1))
    return out


def _session(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState, cooldown_us: int, ttl_ms: int) -> Iterator[pd.DataFrame]:
    """One session with its rows as columns."""
    given = [g for pdf in pdfs for g in zip(*[pdf[name].astype(object).where(pdf[name].notna(), None).tolist() for name in GIVEN])]
    out = _advance(key[0], given, state, cooldown_us, ttl_ms)
    if out:
        frame = pd.DataFrame(out, columns=OUTPUT, dtype=object)
        yield frame.assign(us=pd.to_datetime(frame["us"].astype("Int64"), unit="us")).rename(columns={"us": "timestamp"})


def _packed(out: list[tuple]) -> Iterator[pd.DataFrame]:
    for k in range(0, len(out), ROWS_AT_ONCE):
        yield pd.DataFrame({"rows": [json.dumps([dict(zip(OUTPUT, row)) for row in out[k:k + ROWS_AT_ONCE]])]})


def _packed_session(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState, cooldown_us: int, ttl_ms: int) -> Iterator[pd.DataFrame]:
    """One session with each row as one text: a frame costs by its columns, and most sessions have few rows."""
    given = [tuple(map(json.loads(text).get, GIVEN)) for pdf in pdfs for text in pdf["row"]]  # bounded by the trigger's input limits
    yield from _packed(_advance(key[0], given, state, cooldown_us, ttl_ms))


class _Held:
    """One session's part of its group's state, with what :func:`_advance` uses of a ``GroupState``."""

    def __init__(self, mark_ms: int, value: list | None = None, timeout_ms: int | None = None):
        self.mark_ms, self.get, self.timeout_ms = mark_ms, value, timeout_ms
        self.hasTimedOut = False

    @property
    def exists(self) -> bool:
        return self.get is not None

    def update(self, value: tuple) -> None:
        self.get = value

    def remove(self) -> None:
        self.get = None

    def getCurrentWatermarkMs(self) -> int:
        return self.mark_ms

    def setTimeoutTimestamp(self, at_ms: int) -> None:
        self.timeout_ms = at_ms


def _packed_group(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState, cooldown_us: int, ttl_ms: int) -> Iterator[pd.DataFrame]:
    """The sessions of one group: those with rows advance, those whose time has run out without any are closed."""
    mark_ms = state.getCurrentWatermarkMs()
    held = {session: _Held(mark_ms, value, at) for session, value, at in json.loads(state.get[0])} if state.exists else {}
    given: dict[str | None, list[tuple]] = {}
    for pdf in pdfs:
        for text in pdf["row"]:
            row = json.loads(text)
            given.setdefault(row.get("session_id"), []).append(tuple(map(row.get, GIVEN)))
    out = []
    for session, one in held.items():
        one.hasTimedOut = session not in given and one.timeout_ms < mark_ms
        if one.hasTimedOut:
            out += _advance(session, [], one, cooldown_us, ttl_ms)
    for session, rows in given.items():
        out += _advance(session, rows, held.setdefault(session, _Held(mark_ms)), cooldown_us, ttl_ms)
    left = [(session, one.get, one.timeout_ms) for session, one in held.items() if one.exists]
    if left:
        state.update((json.dumps(left),))
        state.setTimeoutTimestamp(min(at for _, _, at in left))
    elif state.exists:
        state.remove()
    yield from _packed(out)


def stateful_decisions(events: DataFrame, cooldown_minutes: int = COOLDOWN_MINUTES, ttl_hours: int = SESSION_TTL_HOURS,
                       watermark: str = "24 hours", controls: DataFrame | None = None, groups: int | None = GROUPS) -> DataFrame:
    """Streaming click events -> decisions, corrections and the ends of sessions (column ``kind``).

    ``events`` may have a column ``arrived`` that orders deliveries of one event;
    ``controls`` is a stream of (session_id, timestamp) at which sessions are cleared;
    ``groups`` is the number of state rows that sessions are dealt to (None: a row each).
    """
    from shoptide.operators.dispatch import action_id

    cooldown_us, ttl_ms = cooldown_minutes * 60 * 1_000_000, ttl_hours * 3600 * 1000
    time = F.col("timestamp").cast("timestamp")
    arrived = F.col("arrived").cast("long") if "arrived" in events.columns else F.lit(0).cast("long")
    rows = events.select("session_id", F.lit("event").alias("kind"), "event_id", "action", "category", "value", arrived.alias("arrived"),
                         time.alias("__ts"), F.unix_micros(time).alias("us"))
    if controls is not None:
        none = F.lit(None).cast("string")
        rows = rows.unionByName(controls.select(
            "session_id", F.lit("clear").alias("kind"), none.alias("event_id"), none.alias("action"), none.alias("category"),
            F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("arrived"), time.alias("__ts"), F.unix_micros(time).alias("us")))
    by = "session_id" if groups is None else "group"
    rows = rows.withColumn("group", F.pmod(F.xxhash64("session_id"), F.lit(groups or 1)).cast("int"))
    rows = rows.select(by, F.to_json(F.struct("session_id", *GIVEN)).alias("row"), "__ts")
    advance, state_schema = (_packed_session, STATE_SCHEMA) if groups is None else (_packed_group, GROUP_STATE)
    out = rows.withWatermark("__ts", watermark).groupBy(by).applyInPandasWithState(
        lambda key, pdfs, state: advance(key, pdfs, state, cooldown_us, ttl_ms), "rows string", state_schema, "append", GroupStateTimeout.EventTimeTimeout)
    out = out.select(F.inline(F.from_json("rows", OUTPUT_ROWS)))
    out = out.select(*[F.timestamp_micros("us").cast("timestamp_ntz").alias("timestamp") if c == "us" else c for c in OUTPUT])
    return out.withColumn("action_id", F.when(F.col("action").isNotNull(), action_id(F.col("session_id"), F.col("action"), F.col("timestamp"))))
