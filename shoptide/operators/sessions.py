"""Sessionization and behavioural session features.

All ordered per-key work goes through :func:`running_scan`, which cuts a key
into time chunks so a hot user or session is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoptide.functions.running import running_scan, time_chunk

ORDER = ["timestamp", "event_id"]
DEFAULT_CHUNK_SECONDS = 3600


def _micros(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp"))


def normalise(clicks: DataFrame) -> DataFrame:
    """Category '' or null -> 'unknown'; value null -> 0.0 (the feature engineer's rule)."""
    cat = F.when(F.col("category").isNull() | (F.col("category") == ""), F.lit("unknown")).otherwise(F.col("category"))
    return clicks.withColumn("category", cat).withColumn("value", F.coalesce(F.col("value"), F.lit(0.0)))


# --- sessionization ------------------------------------------------------------
def sessionize(
    clicks: DataFrame,
    gap_minutes: int = 360,
    key: str = "customer_id",
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
) -> DataFrame:
    """Gap-and-island sessions: a new session starts when the gap to the key's
    previous event is strictly greater than ``gap_minutes`` (a gap of exactly the
    limit stays in the session, as with ``session_window``).

    ``session_id = key || '_' || n`` with n = 1, 2, ... per key in time order;
    n is 1 + the running number of breaks, one chunked scan over
    ``(key, time chunk)`` (default one hour; tune to the data's density).

    An event without a key is anonymous and keeps the session it came with; one
    that came without a session either is a session of its own, named by its
    event id.
    """
    gap_us = gap_minutes * 60 * 1_000_000
    given = F.col("session_id").cast("string") if "session_id" in clicks.columns else F.lit(None).cast("string")
    own = F.coalesce(given, F.concat(F.lit("anonymous_"), F.col("event_id").cast("string")))
    who = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\u0000"), own))
    df = clicks.withColumn("__chunk", time_chunk("timestamp", chunk_seconds)).withColumn("__own", own).withColumn("__key", F.col(key)).withColumn(key, who)
    brk = lambda cur, prev: F.when((_micros(cur) - _micros(prev)) > gap_us, 1).otherwise(0)
    out = running_scan(df, by=[key], chunk="__chunk", order=ORDER,
                       pairsums={"__breaks": (F.col("timestamp"), brk)})
    n = F.col("__breaks") + 1
    named = F.concat(F.col("__key").cast("string"), F.lit("_"), n.cast("string"))
    out = out.withColumn("session_id", F.coalesce(named, F.col("__own"))).withColumn(key, F.col("__key"))
    return out.drop("__chunk", "__breaks", "__key", "__own")


# --- whole-session features ----------------------------------------------------
def _flag(action: str) -> Column:
    return F.when(F.col("action") == action, 1).otherwise(0)


_COUNTERS = {
    "page_views": "page_view",
    "cart_adds": "add_to_cart",
    "cart_removes": "remove_from_cart",
    "checkouts": "checkout_start",
    "searches": "search_query",
    "purchases": "purchase_complete",
}


def session_features(
    clicks: DataFrame,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    include_sequence: bool = False,
) -> DataFrame:
    """One row per session with the 18 behavioural features.

    Events are ordered by (timestamp, event_id); session_id/customer_id are the
    first event's. ``purchases`` (count of purchase_complete) is carried for the
    policy rules.

    Plan: rows are hashed once on (session, hour); a window gives each row's
    previous category inside its hour; rows fold to one summary per
    (session, hour) without a further shuffle; hours fold to sessions, where
    category switches across an hour boundary are settled from the neighbouring
    summaries. Distinct categories are merged from the hours' sets, which the
    category vocabulary bounds. No step holds a whole session; events without a
    session id form one row.

    ``action_sequence`` (the whole ordered action list) is opt-in: its size grows
    with the session, so large jobs should use the counters.
    """
    ev = normalise(clicks).withColumn("__chunk", time_chunk("timestamp", chunk_seconds))
    keys = ["session_id", "__chunk"]
    order_key = F.struct(*[F.col(c) for c in ORDER])
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in ORDER])
    rows = ev.repartition(*keys).select("*", F.lag("category").over(w).alias("__prev_cat"))
    sw = F.when(F.col("category") != F.col("__prev_cat"), 1).otherwise(0)
    chunk_aggs = [
        F.min_by("customer_id", order_key).alias("__cust"),
        F.min(order_key).alias("__first_key"),
        F.min("timestamp").alias("session_start"),
        F.max("timestamp").alias("session_end"),
        F.count(F.lit(1)).alias("total_actions"),
        *[F.sum(_flag(a)).alias(n) for n, a in _COUNTERS.items()],
        F.sum("value").alias("total_cart_value"),
        F.max("value").alias("max_item_value"),
        F.sum(sw).alias("__sw"),
        F.min_by("category", order_key).alias("__first_cat"),
        F.max_by("category", order_key).alias("__last_cat"),
        F.collect_set("category").alias("__cats"),
    ]
    chunks = rows.groupBy(*keys).agg(*chunk_aggs)
    wc = Window.partitionBy("session_id").orderBy("__chunk")
    bnd = F.when(F.col("__first_cat") != F.lag("__last_cat").over(wc), 1).otherwise(0)
    chunks = chunks.select("*", bnd.alias("__bnd"))
    g = chunks.groupBy("session_id").agg(
        F.min_by("__cust", F.col("__first_key")).alias("customer_id"),
        F.min("session_start").alias("session_start"),
        F.max("session_end").alias("session_end"),
        F.sum("total_actions").alias("total_actions"),
        *[F.sum(n).alias(n) for n in _COUNTERS],
        F.sum("total_cart_value").alias("total_cart_value"),
        F.max("max_item_value").alias("max_item_value"),
        F.sum(F.col("__sw") + F.col("__bnd")).alias("category_switches"),
        F.size(F.array_distinct(F.flatten(F.collect_list("__cats")))).cast("long").alias("categories_viewed"),
    )
    if include_sequence:
        seq = ev.groupBy("session_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in ORDER], F.col("action")))),
                        lambda x: x["action"]).alias("action_sequence"))
        g = g.join(seq.withColumnRenamed("session_id", "__sid"), F.col("session_id").eqNullSafe(F.col("__sid")), "inner").drop("__sid")
    return derive_features(g)


def derive_features(g: DataFrame) -> DataFrame:
    """Ratios and rates from the counters (shared by whole-session and running features)."""
    dur = (_micros("session_end") - _micros("session_start")) / F.lit(1e6)
    n = F.col("total_actions")
    pv = F.col("page_views").cast("double")
    adds = F.col("cart_adds").cast("double")
    safe_pv = F.greatest(pv, F.lit(1.0))
    safe_adds = F.greatest(adds, F.lit(1.0))
    g = g.select("*", dur.alias("session_duration_sec"))
    d = F.col("session_duration_sec")
    return g.select(
        "*",
        F.when(n > 1, d / (n - 1)).otherwise(F.lit(0.0)).alias("avg_inter_event_time"),
        (F.col("total_cart_value") / n).alias("avg_item_value"),
        (F.col("total_cart_value") / (d / 60.0 + 1.0)).alias("cart_value_per_minute"),
        (adds / safe_pv).alias("cart_conversion_rate"),
        (F.col("checkouts").cast("double") / safe_adds).alias("checkout_conversion_rate"),
        F.when(adds > 0, F.col("cart_removes").cast("double") / adds).otherwise(F.lit(0.0)).alias("cart_abandon_rate"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("category_switches").cast("double") / safe_pv)).alias("exploration_ratio"),
        F.lit(False).alias("repeat_customer"),
        F.lit(None).cast("int").alias("days_since_last_purchase"),
    )


# --- running (per-event) features ------------------------------------------------
def running_features(
    clicks: DataFrame,
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
    max_events: int | None = None,
) -> DataFrame:
    """Features of the session *so far* at every event (the per-event hot path).

    Every counter is a prefix aggregate computed by one chunked scan over
    ``(session_id, hour)`` (a single shuffle of the events); no per-session
    list is built, so the cost is linear in the events. ``categories_viewed``
    is the scan's running distinct count: a category counts at its first row in
    a chunk unless an earlier chunk of the session already had it (each chunk
    summary carries its set of categories, bounded by the vocabulary).

    ``max_events`` keeps only the last N events in each frame (bounded history);
    ``None`` means the whole session so far.

    Extra columns for later stages: ``purchases`` and the first-occurrence keys
    of add_to_cart / checkout_start / search_query (Markov tie order).
    """
    if max_events is not None:
        return _bounded_running_features(clicks, max_events)
    ev = normalise(clicks).withColumn("__chunk", time_chunk("timestamp", chunk_seconds))
    order_key = F.struct(*[F.col(c) for c in ORDER])
    first_of = lambda a: F.when(F.col("action") == a, order_key)
    aggs = {
        "total_actions": ("sum", F.lit(1)),
        **{n: ("sum", _flag(a)) for n, a in _COUNTERS.items()},
        "total_cart_value": ("sum", F.col("value")),
        "max_item_value": ("max", F.col("value")),
        "session_start": ("min", F.col("timestamp")),
        "first_add_key": ("min", first_of("add_to_cart")),
        "first_checkout_key": ("min", first_of("checkout_start")),
        "first_search_key": ("min", first_of("search_query")),
    }
    switch = lambda cur, prev: F.when(cur != prev, 1).otherwise(0)
    ev = running_scan(ev, by=["session_id"], chunk="__chunk", order=ORDER, aggs=aggs,
                      pairsums={"category_switches": (F.col("category"), switch)},
                      distincts={"categories_viewed": F.col("category")})
    ev = ev.withColumn("session_end", F.col("timestamp"))
    return derive_features(ev).drop("__chunk")


def _bounded_running_features(clicks: DataFrame, max_events: int) -> DataFrame:
    """Running features over the last ``max_events`` events (a bounded store).

    The frame is ``rowsBetween(-(N-1), 0)``; distinct categories need the frame's
    set, which is bounded by N, so ``size(collect_set)`` is safe here.
    """
    ev = normalise(clicks)
    order_key = F.struct(*[F.col(c) for c in ORDER])
    w = Window.partitionBy("session_id").orderBy(*[F.col(c) for c in ORDER])
    frame = w.rowsBetween(-(max_events - 1), Window.currentRow)
    ev = ev.withColumn("__prev_cat", F.lag("category").over(w))
    # A switch is counted on the row where it happens, and only if the previous
    # row is also inside the frame (the oldest row of the frame has no predecessor).
    ev = ev.withColumn("__sw", F.when(F.col("category") != F.col("__prev_cat"), 1).otherwise(0))
    sw_frame = w.rowsBetween(-(max_events - 2), Window.currentRow) if max_events > 1 else None
    first_of = lambda a: F.when(F.col("action") == a, order_key)
    cols = {
        "total_actions": F.count(F.lit(1)).over(frame),
        "page_views": F.sum(_flag("page_view")).over(frame),
        "cart_adds": F.sum(_flag("add_to_cart")).over(frame),
        "cart_removes": F.sum(_flag("remove_from_cart")).over(frame),
        "checkouts": F.sum(_flag("checkout_start")).over(frame),
        "searches": F.sum(_flag("search_query")).over(frame),
        "purchases": F.sum(_flag("purchase_complete")).over(frame),
        "total_cart_value": F.sum("value").over(frame),
        "max_item_value": F.max("value").over(frame),
        "categories_viewed": F.size(F.collect_set("category").over(frame)),
        "category_switches": F.sum("__sw").over(sw_frame) if sw_frame is not None else F.lit(0),
        "session_start": F.min("timestamp").over(frame),
        "first_add_key": F.min(first_of("add_to_cart")).over(frame),
        "first_checkout_key": F.min(first_of("checkout_start")).over(frame),
        "first_search_key": F.min(first_of("search_query")).over(frame),
    }
    for name, c in cols.items():
        ev = ev.withColumn(name, c)
    ev = ev.withColumn("session_end", F.col("timestamp"))
    return derive_features(ev).drop("__prev_cat", "__sw")


def features_for(requested: DataFrame, features: DataFrame) -> DataFrame:
    """Features for requested session ids (a point read). Sessions without
    events get the default feature row (zeros, no customer), as the feature
    engineer does for an empty event list; empty input otherwise stays empty."""
    zero = {f.name: F.lit(0).cast(f.dataType) for f in features.schema.fields
            if f.name not in ("session_id", "customer_id", "repeat_customer", "days_since_last_purchase",
                              "session_start", "session_end", "action_sequence")
            and f.dataType.typeName() in ("long", "integer", "double")}
    j = requested.select("session_id").join(features, "session_id", "left")
    return j.select("session_id", *[F.coalesce(F.col(c), zero[c]).alias(c) if c in zero else F.col(c)
                                    for c in features.columns if c != "session_id"]).withColumn(
        "repeat_customer", F.coalesce(F.col("repeat_customer"), F.lit(False)))
