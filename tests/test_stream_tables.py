"""The streaming tables: one commit per batch, replacement, late rows, repair, faults in mid-batch, incremental evaluation."""

import json
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shoptide.plans.pipeline import event_decisions
from shoptide.session import checkpoint_dir
from shoptide.sources.events import kafka_options, open_feed
from shoptide.streaming import evaluation, loop
from shoptide.streaming.tables import BatchTables, Table

T0 = datetime(2024, 3, 1, 12, 0, 0)
RECORDS = "value string, topic string, partition int, offset long"


@pytest.fixture
def folder(spark):
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex[:8]}"


def record(offset, seconds, action, event_id=None, session="s1", value=60.0, category="c", raw=None):
    e = {"event_id": event_id, "session_id": session, "customer_id": "u1", "timestamp": (T0 + timedelta(seconds=seconds)).isoformat(),
         "action": action, "category": category, "value": value}
    return (raw or json.dumps({k: v for k, v in e.items() if v is not None}), "clicks", 0, offset)


def feed(spark, *records):
    return spark.createDataFrame(list(records), RECORDS)


def rows(df, *cols):
    return sorted(repr(tuple(r)) for r in (df.select(*cols) if cols else df).collect())


ONE = [record(0, 0, "page_view", "a"), record(1, 60, "add_to_cart", "b"), record(2, 30, "page_view"), record(3, 5, "x", raw="{broken"),
       record(4, 1200, "checkout_start", "d"), record(5, 60, "add_to_cart", "b", value=75.0)]
TWO = [record(6, 2400, "page_view", "e"), record(7, 600, "remove_from_cart", "late"), record(8, 0, "page_view", "a"),
       record(9, -90_000, "page_view", "too late"), record(10, 10, "page_view", "z", session="s2")]
DECIDED = ["session_id", "event_id", "timestamp", "intent", "action", "reason", "dispatched", "action_id"]


def expected(tables):
    """The batch decisions over the stored events."""
    return event_decisions(tables.read("events").drop("event_date", "arrived_batch", "arrived_seq"))


def test_replacement_late_rows_repair_and_counts(spark, folder):
    t = loop.loop_tables(spark, folder)
    assert loop.run_batch(t, feed(spark, *ONE), 0)
    assert {r["event_id"]: r["value"] for r in t.read("events").collect() if len(r["event_id"]) == 1} == {"a": 60.0, "b": 75.0, "d": 60.0}
    first = {r["event_id"]: r["action"] for r in t.read("decisions").collect()}
    assert len(first) == 4 and {r["offset"] for r in t.read("quarantine").collect()} == {3}
    assert loop.run_batch(t, feed(spark, *TWO), 1)
    assert rows(t.read("decisions"), *DECIDED) == rows(expected(t), *DECIDED)
    assert [(r["event_id"], r["offset"], r["batch_id"]) for r in t.read("late").collect()] == [("too late", 9, 1)]
    counts = {(r["batch_id"], r["kind"]): r["n"] for r in t.read("counts").collect()}
    assert counts == {(0, "read"): 6, (0, "quarantined"): 1, (0, "late"): 0, (0, "accepted"): 5, (0, "distinct"): 4,
                      (1, "read"): 5, (1, "quarantined"): 0, (1, "late"): 1, (1, "accepted"): 4, (1, "distinct"): 4}
    second = {r["event_id"]: r["action"] for r in t.read("decisions").collect()}
    changed = {i for i in first if first[i] != second[i]}
    assert {r["event_id"] for r in t.read("corrections").collect()} >= changed
    assert {r["action_id"] for r in t.read("ledger").collect()} == {r["action_id"] for r in t.read("decisions").collect()}


@pytest.mark.parametrize("step", ["events", "corrections", "ledger"])
def test_a_fault_in_mid_batch_leaves_nothing_and_a_replay_changes_nothing(spark, folder, step):
    clean, broken = loop.loop_tables(spark, f"{folder}/clean"), loop.loop_tables(spark, f"{folder}/broken")
    loop.run_batch(clean, feed(spark, *ONE), 0)
    loop.run_batch(broken, feed(spark, *ONE), 0)
    before = {name: rows(broken.read(name)) for name in loop.TABLES}

    def fail(done):
        if done == step:
            raise OSError(f"lost after {done}")

    with pytest.raises(OSError):
        loop.run_batch(broken, feed(spark, *TWO), 1, after=fail)
    assert {name: rows(broken.read(name)) for name in loop.TABLES} == before
    assert loop.run_batch(broken, feed(spark, *TWO), 1) and loop.run_batch(clean, feed(spark, *TWO), 1)
    assert not loop.run_batch(broken, feed(spark, *TWO), 1)
    for name in loop.TABLES:
        assert rows(broken.read(name)) == rows(clean.read(name)), name


def test_an_event_that_moves_to_another_session_leaves_the_old_one(spark, folder):
    t = loop.loop_tables(spark, folder)
    loop.run_batch(t, feed(spark, record(0, 0, "page_view", "a", session="old")), 0)
    loop.run_batch(t, feed(spark, record(1, 0, "page_view", "a", session="new")), 1)
    assert [(r["session_id"], r["event_id"]) for r in t.read("decisions").collect()] == [("new", "a")]
    assert {r["session_id"] for r in t.read("ledger").collect()} == {"new"}


def test_merge_replaces_only_touched_partitions(spark, folder):
    t = BatchTables(spark, folder, {"x": Table("k string, day int, v int", ["day"])})
    def put(batch_id, *new):
        b = t.begin(batch_id)
        b.merge("x", spark.createDataFrame(list(new), "k string, day int, v int"), "k")
        b.commit()
        return b
    put(0, ("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", 3, 1))
    b = put(1, ("a", 2, 2))  # moves from day 1 to day 2
    assert rows(t.read("x")) == sorted(map(repr, [("a", 2, 2), ("b", 1, 1), ("c", 2, 1), ("d", 3, 1)]))
    assert b.live["x", "day=3"].startswith("data/x/batch=0") and b.live["x", "day=1"].startswith("data/x/batch=1")
    put(2, ("d", 1, 5))
    assert ("x", "day=3") not in t.live()[0]
    assert t.begin(2) is None


def test_evaluation_takes_each_action_once_and_compares_with_stored_metrics(spark, folder):
    schema = "action_id string, session_id string, action_type string, intent string, confidence double, reason string, created_at timestamp_ntz"
    def action(i, minutes):
        return (f"a{i}", f"s{i}", "APPLY_DISCOUNT", "CART_BUILDER", 0.9, None, T0 + timedelta(minutes=minutes))
    clicks = spark.createDataFrame([("s0", T0 + timedelta(minutes=5), "checkout_start"), ("s2", T0 + timedelta(minutes=75), "purchase_complete")],
                                   "session_id string, timestamp timestamp_ntz, action string")
    store = evaluation.evaluation_tables(spark, folder)
    ledger = spark.createDataFrame([action(0, 0), action(1, 1), action(2, 61)], schema)
    run = lambda led, minutes, k: evaluation.evaluate_due(store, led, clicks, T0 + timedelta(minutes=minutes), k)
    assert run(ledger, 10, 0)
    assert store.read("metrics").collect() == []  # nothing observed yet: no record
    assert run(ledger, 40, 1)
    late = ledger.unionByName(spark.createDataFrame([action(3, 2)], schema))  # a late event has added an action to an evaluated time
    assert run(late, 90, 2) and not run(late, 90, 2)
    got = [(r["batch_no"], r["actions_evaluated"], r["converted"], r["history_len"], r["history_avg"]) for r in evaluation.recent_metrics(store).collect()]
    assert got == [(1, 2, 1, 1, 0.5), (0, 2, 1, 0, None)]
    assert {(r["action_id"], r["converted"], r["batch_no"]) for r in store.read("outcomes").collect()} == {
        ("a0", True, 0), ("a1", False, 0), ("a2", True, 1), ("a3", False, 1)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_batch_joins_its_history_once_and_copies_no_written_rows(spark, folder, monkeypatch):
    plans, written = [], []
    decide, write = loop.event_decisions, loop.materialize
    monkeypatch.setattr(loop, "event_decisions", lambda df, **k: plans.append(_plan(df)) or decide(df, **k))
    monkeypatch.setattr("shoptide.streaming.tables.materialize", lambda df, name: written.append(name) or write(df, name))
    t = loop.loop_tables(spark, folder)
    for k, records in enumerate([ONE, TWO]):
        loop.run_batch(t, feed(spark, *records), k)
    assert len(plans) == 2 and not any("Join" in p for p in plans)
    assert written == ["ledger-rows", "ledger-rows"]
    assert rows(t.read("decisions"), *DECIDED) == rows(expected(t), *DECIDED)


def test_a_run_finds_its_due_actions_once_and_no_later_events(spark, folder, monkeypatch):
    seen = []
    convert = evaluation.conversion
    monkeypatch.setattr(evaluation, "conversion", lambda due, clicks, **k: seen.append((_plan(due), clicks.count())) or convert(due, clicks, **k))
    schema = "action_id string, session_id string, action_type string, intent string, confidence double, reason string, created_at timestamp_ntz"
    ledger = spark.createDataFrame([("a", "s", "X", "I", 0.9, None, T0), ("b", "s", "X", "I", 0.9, None, T0 + timedelta(minutes=30))], schema)
    clicks = spark.createDataFrame([("s", T0 + timedelta(minutes=m), "checkout_start") for m in (15, 40, 45, 46, 500)],
                                   "session_id string, timestamp timestamp_ntz, action string")
    store = evaluation.evaluation_tables(spark, folder)
    assert evaluation.evaluate_due(store, ledger, clicks, T0 + timedelta(minutes=25), 0)
    assert evaluation.evaluate_due(store, ledger, clicks, T0 + timedelta(minutes=51), 1)
    assert [(("Join" in plan), n) for plan, n in seen] == [(False, 1), (False, 4)]
    assert {(r["action_id"], r["converted"]) for r in store.read("outcomes").collect()} == {("a", True), ("b", True)}


def test_the_kafka_reader_keeps_topic_partition_and_offset(spark):
    class Reader:
        def format(self, name):
            self.name = name
            return self

        def options(self, **options):
            self.given = options
            return self

        def load(self):
            return spark.createDataFrame([(bytearray(b'{"session_id": "s"}'), "clicks", 3, 17)], "value binary, topic string, partition int, offset long")

    reader = Reader()
    got = open_feed(spark, "kafka", reader, bootstrap="broker:9092", topic="clicks")
    assert [tuple(r) for r in got.collect()] == [('{"session_id": "s"}', "clicks", 3, 17)]
    assert reader.name == "kafka" and reader.given == kafka_options("broker:9092", "clicks")
    with pytest.raises(ValueError):
        open_feed(spark, "pigeon")
