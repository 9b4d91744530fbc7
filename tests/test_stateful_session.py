"""The stateful operator on one session, with a state of plain Python: repair, clear, reopen, timeout."""

import pandas as pd

from shoptide.streaming import stateful

COOLDOWN, TTL = 900_000_000, 86_400_000


class State:
    def __init__(self):
        self.value, self.hasTimedOut, self.mark_ms, self.timeout = None, False, 0, None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def getCurrentWatermarkMs(self):
        return self.mark_ms

    def setTimeoutTimestamp(self, at):
        self.timeout = at


def send(state, *rows):
    columns = ["kind", "event_id", "action", "category", "value", "us"]
    frame = pd.DataFrame([(k, e, a, c, v, int(s * 1e6)) for k, e, a, c, v, s in rows], columns=columns).assign(session_id="s", arrived=0)
    out = list(stateful._session(("s",), iter([frame]), state, COOLDOWN, TTL))
    return [(r.kind, r.event_id, r.action) for r in pd.concat(out).itertuples()] if out else []


def event(event_id, seconds, action="page_view", value=60.0, category="c"):
    return ("event", event_id, action, category, value, seconds)


def test_a_late_event_corrects_what_follows_and_equals_the_order_of_time():
    late, ordered = State(), State()
    assert [x[:2] for x in send(late, event("a", 10), event("c", 30, "add_to_cart"), event("d", 2000))] == [("decision", i) for i in "acd"]
    second = send(late, event("b", 20, "checkout_start"), event("c", 30, "add_to_cart"))
    assert ("decision", "b") in [x[:2] for x in second] and {x[:2] for x in second} <= {("decision", "b"), ("correction", "c"), ("correction", "d")}
    assert len(second) > 1
    send(ordered, event("a", 10), event("b", 20, "checkout_start"), event("c", 30, "add_to_cart"), event("d", 2000))
    assert late.value == ordered.value


def test_what_the_watermark_has_passed_is_folded_and_nothing_changes():
    folded, whole = State(), State()
    events = [event(f"e{i:02d}", 100 * i, ["page_view", "add_to_cart", "checkout_start", "search_query"][i % 4], 30.0 + i, f"c{i % 5}") for i in range(30)]
    given = {x[1]: x[2] for x in send(whole, *events)}
    got = {}
    for i, e in enumerate(events):
        folded.mark_ms = max(0, 100 * i - 300) * 1000
        got |= {x[1]: x[2] for x in send(folded, e)}
    assert got == given
    assert folded.value[0] == 26 and len(folded.value[len(stateful.EMPTY)]) == 4


def test_clear_reopen_and_timeout():
    state = State()
    send(state, event("a", 10), event("later", 50))
    out = send(state, ("clear", None, None, None, None, 40), event("old", 30), event("new", 60))
    assert [x[:2] for x in out] == [("decision", "old"), ("cleared", None), ("decision", "later"), ("decision", "new")]
    assert send(state, event("too old", 20)) == [("ignored", "too old", None)]
    assert state.timeout == 60_000 + TTL
    state.hasTimedOut = True
    (closed,) = list(stateful._session(("s",), iter([]), state, COOLDOWN, TTL))
    assert closed[["kind", "n_events"]].values.tolist() == [["closed", 2]] and not state.exists
    state.hasTimedOut = False
    assert send(state, event("again", 90_000))[0][:2] == ("decision", "again")


def test_a_short_session_costs_no_frames_of_its_own_work(monkeypatch):
    """Most sessions have one or two events, so a call may build one frame, its result (was: dozens)."""
    import json

    made, plain = [], pd.DataFrame.__init__
    monkeypatch.setattr(pd.DataFrame, "__init__", lambda self, *a, **k: (made.append(1), plain(self, *a, **k))[1])
    frame = pd.DataFrame({"row": [json.dumps(dict(zip(stateful.GIVEN, ("event", "a", 10, "page_view", None, 60.0, None))))]})
    made.clear()
    (out,) = list(stateful._packed_session(("s",), iter([frame]), State(), COOLDOWN, TTL))
    assert len(made) == 1
    (row,) = json.loads(out["rows"][0])
    assert (row["kind"], row["event_id"], row["us"], row["n_events"]) == ("decision", "a", 10, 1)


def test_one_call_takes_all_sessions_of_a_group_and_gives_what_each_gives_alone():
    """A call costs milliseconds, so a session must not need one of its own in each batch (was: a call and a state row a session)."""
    import json

    def texts(rows):
        return pd.DataFrame({"row": [json.dumps({"session_id": s, **dict(zip(stateful.GIVEN, (kind, i, int(t * 1e6), a, c, v, 0)))})
                                     for s, (kind, i, a, c, v, t) in rows]})

    def call(fn, key, state, rows):
        return [row for frame in fn(key, iter([texts(rows)]), state, COOLDOWN, TTL) for text in frame["rows"] for row in json.loads(text)]

    sessions = ["a", "b", None, "d"]
    batches = [[(s, event(f"{s}{i}", 100 * i + k, ["page_view", "add_to_cart", "checkout_start"][i % 3])) for i in range(6) for k, s in enumerate(sessions)],
               [("a", event("a1x", 150)), ("b", ("clear", None, None, None, None, 300)), ("d", event("d2", 203, "add_to_cart", 99.0))],
               [("a", event("later", 86_400 + 700)), ("b", event("anew", 86_400 + 700))], []]
    marks, group, alone = [0, 400_000, 500_000, 86_400_000 + 600_000], State(), {s: State() for s in sessions}
    closed = 0
    for mark, rows in zip(marks, batches):
        want = []
        for s, state in alone.items():
            state.mark_ms, mine = mark, [r for r in rows if r[0] == s]
            state.hasTimedOut = not mine and state.exists and state.timeout < mark
            if mine or state.hasTimedOut:
                want += call(stateful._packed_session, (s,), state, mine)
        group.mark_ms, group.hasTimedOut = mark, not rows
        got = call(stateful._packed_group, (7,), group, rows)
        order = lambda r: json.dumps(r, sort_keys=True)
        assert sorted(got, key=order) == sorted(want, key=order)
        closed += sum(r["kind"] == "closed" for r in got)
        live = {s: state for s, state in alone.items() if state.exists}
        assert {s: value for s, value, _ in json.loads(group.value[0])} == {s: json.loads(json.dumps(state.value)) for s, state in live.items()}
        assert group.timeout == min(state.timeout for state in live.values())
    assert closed == 2 and set(live) == {"a", "b"}


def test_the_stream_keeps_fewer_state_rows_than_sessions(spark, tmp_path):
    from shoptide.streaming.stateful import stateful_decisions

    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.sql("SELECT concat('s', id) AS session_id, concat('e', id) AS event_id, timestamp_ntz'2024-01-01 00:00:00' AS timestamp, "
                     "'page_view' AS action, 'c' AS category, 1.0D AS value FROM range(200)")
    rows.write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    kept = []
    for groups in (None, 8):
        out = f"{tmp_path}/out-{groups}"
        query = (stateful_decisions(events, groups=groups).writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", f"{out}-ck").trigger(availableNow=True).start())
        query.awaitTermination()
        kept.append((spark.read.parquet(out).where("kind = 'decision'").count(), query.recentProgress[0]["stateOperators"][0]["numRowsTotal"]))
    assert kept == [(200, 200), (200, 8)]
