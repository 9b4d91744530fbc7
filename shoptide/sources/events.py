"""Click-event sources: readers, validation with quarantine, defaults, test-data adapter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptide.schema import CLICK_EVENT

CORRUPT = "_corrupt_record"

# JSON payload schema: every field as text so a mistyped field is detectable
# instead of silently nulled by the parser.
_RAW_JSON = T.StructType([T.StructField(f.name, T.StringType()) for f in CLICK_EVENT.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- test-data adapter -------------------------------------------------------
def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def clicks_from_events(events: DataFrame) -> DataFrame:
    """Map the driver's generic ``events`` table onto the click-event schema.

    The rows only take the shape the jobs expect (a fixed mapping of
    event_type and the ``k`` property); no session or result is derived here.
    ``session_id`` is left null: sessions come from :func:`sessionize`.

    view -> page_view; click -> add_to_cart (k even) / search_query (k odd);
    purchase -> purchase_complete (k even) / checkout_start (k odd);
    error -> remove_from_cart; signup -> filter_apply; category ``cat_{k%5}``.
    """
    k = _k(F.col("props"))
    et = F.col("event_type")
    even = (k % 2) == 0
    action = (
        F.when(et == "view", F.lit("page_view"))
        .when(et == "click", F.when(even, F.lit("add_to_cart")).otherwise(F.lit("search_query")))
        .when(et == "purchase", F.when(even, F.lit("purchase_complete")).otherwise(F.lit("checkout_start")))
        .when(et == "error", F.lit("remove_from_cart"))
        .when(et == "signup", F.lit("filter_apply"))
        .otherwise(et)
    )
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("ts").alias("timestamp"),
        action.alias("action"),
        F.concat(F.lit("p"), k.cast("string")).alias("product_id"),
        F.concat(F.lit("cat_"), (k % 5).cast("string")).alias("category"),
        F.col("value").alias("value"),
        F.col("props").alias("metadata"),
    )


def load_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_from_events(table(spark, sf_dir, "events"))


# --- readers -----------------------------------------------------------------
def read_json_events(spark: SparkSession, path: str) -> DataFrame:
    """Line-delimited JSON click events, PERMISSIVE: bad lines land in ``_corrupt_record``."""
    schema = T.StructType([*_RAW_JSON.fields, T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )
    return typed_events(raw)


def parse_json_values(values: DataFrame, value_col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """Parse a column of JSON text (e.g. Kafka ``value`` bytes) into typed events.

    PERMISSIVE parsing: text that is not a JSON object keeps its raw text in
    ``_corrupt_record``; the raw payload is kept as ``raw`` for quarantine, and
    the columns in ``keep`` (where a record came from) stay beside it."""
    keep = keep or []
    text = F.col(value_col).cast("string")
    schema = T.StructType([*_RAW_JSON.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = values.select(
        F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("j"),
        text.alias("raw"), *keep,
    )
    bad = F.col("j").isNull() | F.col(f"j.{CORRUPT}").isNotNull()
    flat = parsed.select(*[F.col(f"j.{f.name}").alias(f.name) for f in _RAW_JSON.fields],
                         F.when(bad, F.coalesce(F.col("raw"), F.lit(""))).alias(CORRUPT), "raw", *keep)
    return typed_events(flat, keep)


def raw_event_json(clicks: DataFrame, defects: bool = True) -> DataFrame:
    """Stand-in raw feed for the ingest jobs: each click as one JSON text, with
    fixed defects by the ``k`` property (k % 10 = 7: truncated text; 3: no
    session_id; 5: non-numeric value; 1: no event_id) unless ``defects`` is
    False. Only shapes input."""
    k = F.get_json_object("metadata", "$.k").cast("int") % 10
    if not defects:
        k = F.lit(0)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    ts = F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    val = F.when(k == 5, F.lit('"n/a"')).otherwise(F.format_string("%.2f", F.col("value")))
    parts = [
        F.when(k != 1, F.concat(F.lit('"event_id": '), q(F.col("event_id")), F.lit(", "))).otherwise(F.lit("")),
        F.when(k != 3, F.concat(F.lit('"session_id": '), q(F.col("session_id")), F.lit(", "))).otherwise(F.lit("")),
        F.lit('"customer_id": '), q(F.col("customer_id")),
        F.lit(', "timestamp": '), q(ts),
        F.lit(', "action": '), q(F.col("action")),
        F.lit(', "category": '), q(F.col("category")),
        F.lit(', "value": '), val, F.lit("}"),
    ]
    full = F.concat(F.lit("{"), *parts)
    broken = F.concat(F.lit('{"event_id": '), q(F.col("event_id")), F.lit(', "session_id": '))
    return clicks.select(F.col("event_id").alias("source_event_id"),
                         F.when(k == 7, broken).otherwise(full).alias("value"))


DROPS = 4
_DAY_US = 86_400_000_000


def disordered_feed(clicks: DataFrame, drops: int = DROPS, raised: float = 1.0) -> DataFrame:
    """Stand-in feed with faults of delivery, in ``drops`` equal spans of arrival time: (value, drop, arrival, copy).

    By the number n of the event: n % 17 = 3 arrives ten days late, n % 5 = 0
    20 hours late; n % 7 = 2 is delivered again 5 hours later with its value
    raised by ``raised``; n % 10 = 1 has no event_id. Only shapes input.
    """
    n = F.col("event_id").cast("long")
    late = F.when(n % 17 == 3, 240).when(n % 5 == 0, 20).otherwise(0)
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    once = clicks.select("*", n.alias("n"), F.lit(0).alias("copy"), (us + late * F.lit(3_600_000_000)).alias("arrival"))
    again = once.where(F.col("n") % 7 == 2).withColumn("copy", F.lit(1)).withColumn("value", F.col("value") + raised).withColumn("arrival", F.col("arrival") + 5 * F.lit(3_600_000_000))
    bounds = clicks.agg(F.min(F.floor(us / _DAY_US)).alias("lo"), F.max(F.floor(us / _DAY_US)).alias("hi")).first()
    span = ((bounds["hi"] or 0) - (bounds["lo"] or 0) + 1) / drops
    drop = F.least(F.floor((F.floor(F.col("arrival") / _DAY_US) - F.lit(bounds["lo"] or 0)) / F.lit(span)), F.lit(drops - 1))
    fields = F.struct(
        F.when(F.col("n") % 10 != 1, F.col("event_id")).alias("event_id"), "session_id", "customer_id",
        F.date_format(F.col("timestamp").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "action", "product_id", "category", F.round("value", 2).alias("value"), "metadata")
    return once.unionByName(again).select(F.to_json(fields).alias("value"), drop.cast("int").alias("drop"), "arrival", "copy")


def typed_events(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Cast text fields to the event schema; a failed cast becomes a validation error."""
    ts_text = F.col("timestamp")
    ts = F.coalesce(
        F.try_to_timestamp(ts_text),
        F.try_to_timestamp(ts_text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
    )
    value = F.col("value").try_cast("double")
    mistyped = (
        (ts_text.isNotNull() & ts.isNull()) | (F.col("value").isNotNull() & value.isNull())
    )
    corrupt = F.col(CORRUPT) if CORRUPT in raw.columns else F.lit(None).cast("string")
    extra = [*(["raw"] if "raw" in raw.columns else []), *(keep or [])]
    return raw.select(*extra,
        "event_id", "session_id", "customer_id",
        ts.cast("timestamp_ntz").alias("timestamp"),
        "action", "product_id", "category",
        value.alias("value"),
        "metadata",
        F.when(mistyped & corrupt.isNull(), F.lit("mistyped field")).alias("_type_error"),
        corrupt.alias(CORRUPT),
    )


def read_csv_events(spark: SparkSession, path: str, with_label: bool = False) -> DataFrame:
    """Labelled clickstream CSV (header row); metadata stays JSON text."""
    schema = CLICK_EVENT
    if with_label:
        schema = T.StructType([*CLICK_EVENT.fields, T.StructField("ground_truth_intent", T.StringType())])
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def write_csv_events(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def kafka_options(bootstrap: str, topic: str = "ecommerce.clicks.raw", group_id: str = "shoptide-clicks") -> dict[str, str]:
    """Options for ``readStream.format('kafka')`` (needs the Kafka connector jar):
    earliest offsets, a named consumer group; parse ``value`` with
    :func:`parse_json_values`. Offsets are tracked by the query checkpoint."""
    return {
        "kafka.bootstrap.servers": bootstrap,
        "subscribe": topic,
        "startingOffsets": "earliest",
        "kafka.group.id": group_id,
        "failOnDataLoss": "true",
    }


ORIGIN = ["topic", "partition", "offset"]


def open_feed(spark: SparkSession, kind: str, reader=None, **options: str) -> DataFrame:
    """A stream of raw records (value, topic, partition, offset) from files or from Kafka.

    ``files``: ``path`` and the text source's own options; the topic is the file,
    offsets are null. ``kafka``: the arguments of :func:`kafka_options`; a
    record's offset stays with it, into the store and into quarantine.
    ``reader`` replaces ``spark.readStream``.
    """
    reader = reader if reader is not None else spark.readStream
    if kind == "kafka":
        rows = reader.format("kafka").options(**kafka_options(**options)).load()
        return rows.select(F.col("value").cast("string").alias("value"), "topic",
                           F.col("partition").cast("int").alias("partition"), F.col("offset").cast("long").alias("offset"))
    if kind == "files":
        path = options.pop("path")
        rows = reader.format("text").options(**options).load(path)
        return rows.select("value", F.col("_metadata.file_path").alias("topic"), F.lit(0).alias("partition"),
                           F.lit(None).cast("long").alias("offset"))
    raise ValueError("kind must be 'files' or 'kafka'")


def to_kafka_value(events: DataFrame) -> DataFrame:
    """Serialise events as one JSON object per row in a ``value`` column (Kafka sink shape)."""
    return events.select(
        F.col("session_id").cast("string").alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("value"),
    )


# --- validation ----------------------------------------------------------------
def is_valid(df: DataFrame) -> Column:
    ok = F.col("session_id").isNotNull() & F.col("action").isNotNull()
    if CORRUPT in df.columns:
        ok = ok & F.col(CORRUPT).isNull()
    if "_type_error" in df.columns:
        ok = ok & F.col("_type_error").isNull()
    return ok


def valid_events(df: DataFrame) -> DataFrame:
    """Rows that pass validation, without the bookkeeping columns."""
    return df.filter(is_valid(df)).drop(CORRUPT, "_type_error")


def quarantine(df: DataFrame) -> DataFrame:
    """Rows that fail validation, with the reason.

    Missing ``session_id``/``action``, unparsable JSON text and mistyped fields
    are all kept here instead of ending the stream.
    """
    reason = F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed_json")) if CORRUPT in df.columns else None
    if "_type_error" in df.columns:
        c = F.col("_type_error").isNotNull()
        reason = (reason.when(c, F.lit("mistyped_field")) if reason is not None
                  else F.when(c, F.lit("mistyped_field")))
    miss = F.col("session_id").isNull() | F.col("action").isNull()
    reason = reason.when(miss, F.lit("missing_required")) if reason is not None else F.when(miss, F.lit("missing_required"))
    return df.filter(~is_valid(df)).withColumn("quarantine_reason", reason)


def with_event_defaults(df: DataFrame, ingest_ts: Column | None = None) -> DataFrame:
    """Fill the model defaults: event_id, timestamp and metadata.

    A missing ``event_id`` becomes the first 12 hex characters of the SHA-256 of
    'session|epoch micros|action|category', so a replay yields the same id (the
    reference draws a random uuid). A missing timestamp takes ``ingest_ts``
    (default: now); metadata ``{}``.
    """
    ingest_ts = ingest_ts if ingest_ts is not None else F.current_timestamp()
    return (
        df.withColumn("event_id", F.coalesce(F.col("event_id"), default_event_id()))
        .withColumn("timestamp", F.coalesce(F.col("timestamp"), ingest_ts.cast(df.schema["timestamp"].dataType)))
        .withColumn("metadata", F.coalesce(F.col("metadata"), F.lit("{}")))
    )


def default_event_id() -> Column:
    key = F.concat_ws("|", F.coalesce(F.col("session_id"), F.lit("")),
                      F.coalesce(F.unix_micros(F.col("timestamp").cast("timestamp")).cast("string"), F.lit("")),
                      F.coalesce(F.col("action"), F.lit("")), F.coalesce(F.col("category"), F.lit("")))
    return F.substring(F.sha2(key, 256), 1, 12)
