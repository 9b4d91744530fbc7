"""The chunked prefix scan equals a plain per-key window."""

import random

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoptide.functions.running import running_scan
from shoptide.session import materialize


def test_scan_equals_window(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(5):
        for i in range(rnd.randint(1, 200)):
            rows.append((f"k{k}", rnd.randint(0, 5000), f"e{i:04d}", rnd.choice(["a", "b", "c"]), rnd.random()))
    df = spark.createDataFrame(rows, "key string, t long, eid string, cat string, v double")
    df = df.withColumn("chunk", F.floor(F.col("t") / 300))
    sw = lambda cur, prev: F.when(cur != prev, 1).otherwise(0)
    got = running_scan(df, ["key"], "chunk", ["t", "eid"],
                       aggs={"s": ("sum", F.col("v")), "mx": ("max", F.col("v")), "mn": ("min", F.col("t"))},
                       prev={"pc": F.col("cat")}, pairsums={"sw": (F.col("cat"), sw)})
    w = Window.partitionBy("key").orderBy("t", "eid")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("key", "eid", F.sum("v").over(run).alias("s"), F.max("v").over(run).alias("mx"),
                    F.min("t").over(run).alias("mn"), F.lag("cat").over(w).alias("pc"),
                    F.coalesce(F.sum(F.when(F.col("cat") != F.lag("cat").over(w), 1).otherwise(0)).over(run), F.lit(0)).alias("x"))
    ref = ref.select("*")
    a = {(r.key, r.eid): (round(r.s, 9), r.mx, r.mn, r.pc, r.sw) for r in got.collect()}
    b = {}
    for r in df.select("key", "eid", "t", "cat").collect():
        pass
    lag = df.withColumn("pc", F.lag("cat").over(w)).withColumn("flag", F.when(F.col("cat") != F.col("pc"), 1).otherwise(0))
    lag = lag.withColumn("sw", F.sum("flag").over(run)).withColumn("s", F.sum("v").over(run)).withColumn(
        "mx", F.max("v").over(run)).withColumn("mn", F.min("t").over(run))
    for r in lag.collect():
        b[(r.key, r.eid)] = (round(r.s, 9), r.mx, r.mn, r.pc, r.sw)
    assert a == b


def test_global_rank_without_key(spark):
    df = spark.range(0, 1000).select(F.col("id"), (F.col("id") % 97).alias("chunk"))
    df = df.withColumn("chunk", F.floor(F.col("id") / 100))
    got = running_scan(df, [], "chunk", ["id"], aggs={"rank": ("sum", F.lit(1))})
    assert all(r.rank == r.id + 1 for r in got.collect())


def test_hot_session_spread_over_chunks(spark):
    """One session with most of the rows: the scan still equals the plain window
    and the exchange is keyed by (session, chunk), not the session alone."""
    from shoptide.operators.sessions import running_features
    from pyspark.sql import functions as F2
    rows = [("hot" if i % 4 else f"s{i}", f"e{i:05d}", i * 37, "page_view" if i % 3 else "add_to_cart",
             f"c{i % 5}", float(i % 11)) for i in range(3000)]
    df = spark.createDataFrame(rows, "session_id string, event_id string, sec long, action string, category string, value double")
    df = df.withColumn("timestamp", F2.timestamp_seconds("sec").cast("timestamp_ntz")).withColumn(
        "customer_id", F2.lit("c")).drop("sec")
    rf = running_features(df, chunk_seconds=600)
    p = rf._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session_id" in p and "__chunk" in p
    got = {r.event_id: (r.total_actions, r.categories_viewed, r.category_switches, r.cart_adds)
           for r in rf.where("session_id = 'hot'").collect()}
    hot = sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[2])
    seen, sw, adds, prev = set(), 0, 0, None
    for n, r in enumerate(hot, 1):
        seen.add(r[4]); adds += r[3] == "add_to_cart"
        if prev is not None and r[4] != prev:
            sw += 1
        prev = r[4]
        assert got[r[1]] == (n, len(seen), sw, adds)


def test_distinct_count_equals_window(spark):
    rnd = random.Random(5)
    rows = [(f"k{rnd.randint(0, 3)}", rnd.randint(0, 20000), f"e{i:05d}", rnd.choice(["a", "b", "c", "d", None]))
            for i in range(1500)]
    df = spark.createDataFrame(rows, "key string, t long, eid string, cat string").withColumn(
        "chunk", F.floor(F.col("t") / 500))
    got = {(r.key, r.eid): r.nd for r in
           running_scan(df, ["key"], "chunk", ["t", "eid"], distincts={"nd": F.col("cat")}).collect()}
    w = Window.partitionBy("key").orderBy("t", "eid").rowsBetween(Window.unboundedPreceding, 0)
    ref = df.select("key", "eid", F.size(F.collect_set("cat").over(w)).alias("nd"))
    assert got == {(r.key, r.eid): r.nd for r in ref.collect()}


def test_hot_customer_sessionize(spark):
    """One customer with most events across many hourly chunks: the chunked
    gap-and-island equals a sequential restatement."""
    from datetime import datetime, timedelta
    from shoptide.operators.sessions import sessionize
    rnd = random.Random(9)
    t, rows, expect, n = datetime(2024, 1, 1), [], {}, 1
    for i in range(2000):
        gap = rnd.choice([1, 5, 30, 59, 60, 61, 200])
        t += timedelta(minutes=gap)
        if i and gap > 60:
            n += 1
        rows.append((f"e{i:05d}", "hot", t))
        expect[f"e{i:05d}"] = f"hot_{n}"
    rows += [(f"x{i}", f"c{i}", t) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id string, customer_id string, timestamp timestamp_ntz")
    got = {r.event_id: r.session_id for r in sessionize(df, gap_minutes=60).where("customer_id = 'hot'").collect()}
    assert got == expect


def test_the_rows_are_shuffled_once(spark):
    """Windows, summary and join share one exchange of the rows by one key that is never null (was: the join shuffled them again)."""
    df = spark.createDataFrame([("a", 1, 1, "x"), (None, 1, 2, "y"), (None, None, 3, "y")], "k string, c long, t long, v string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = running_scan(df, by=["k"], chunk="c", order=["t"], aggs={"n": ("sum", F.lit(1))}, distincts={"d": F.col("v")})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sum("isnull(" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line) == 0
        assert {(r["k"], r["t"], r["n"], r["d"]) for r in out.collect()} == {("a", 1, 1, 1), (None, 3, 1, 1), (None, 2, 2, 1)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("hot_rows", [0, 60, 1000])
def test_large_and_small_keys_scan_alike(spark, hot_rows):
    """Keys of one chunk, keys cut into chunks and both together give what a plain window gives."""
    rnd = random.Random(5)
    rows = [(rnd.choice(["a", "b", "c", "d", None]) if i % 3 else "a", rnd.randint(0, 4000) if i % 20 else None, f"e{i:04d}",
             rnd.choice(["x", "y", "z", None]), rnd.randint(0, 50) if i % 4 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, t long, eid string, cat string, v long").withColumn("chunk", F.floor(F.col("t") / 250))
    step = lambda cur, prev: F.when(cur - prev >= 3, 1).otherwise(0)
    differs = lambda cur, prev: F.when(cur != prev, 1).otherwise(0)
    got = running_scan(df, ["key"], "chunk", ["t", "eid"], aggs={"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, prev={"p": F.col("cat")},
                       pairsums={"sw": (F.col("cat"), differs)}, distincts={"d": F.col("cat")}, gapsums={"g": (F.col("v"), step)}, hot_rows=hot_rows)
    expected = {}
    for key in {r[0] for r in rows}:
        total, top, before, switches, seen, held, gaps = None, None, None, 0, set(), None, 0
        for i, (_, _, eid, cat, v) in enumerate(sorted([r for r in rows if r[0] == key], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            if v is not None:
                total, top = (total or 0) + v, v if top is None else max(top, v)
                gaps += held is not None and v - held >= 3
                held = v
            switches += i > 0 and cat is not None and before is not None and cat != before
            seen |= {cat} - {None}
            expected[eid] = (total, top, before, switches, len(seen), gaps)
            before = cat
    assert {r["eid"]: (r["s"], r["m"], r["p"], r["sw"], r["d"], r["g"]) for r in got.collect()} == expected


def test_rows_without_a_large_key_are_shuffled_once(spark):
    """Each row is shuffled once, whatever columns it has; the count before it shuffles keys alone."""
    df = spark.range(0, 4000).select((F.col("id") % 500).cast("string").alias("key"), F.col("id").alias("t"), F.floor(F.col("id") / 300).alias("chunk"))
    differs = lambda cur, prev: F.when(cur != prev, 1).otherwise(0)
    got = running_scan(materialize(df, "scan-input"), ["key"], "chunk", ["t"], aggs={"n": ("sum", F.lit(1))}, pairsums={"sw": (F.col("t"), differs)},
                       distincts={"d": F.col("key")})
    got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("REPARTITION_BY_COL") == 1 and "Join" not in plan
