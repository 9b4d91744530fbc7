"""Text signals from search queries and normalisation of model responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoptide.schema import KEYWORD_SIGNALS, SEARCH_QUERY

SIGNALS = list(KEYWORD_SIGNALS)


def keyword_flags(text: Column) -> dict[str, Column]:
    """Lower-case *substring* match per signal ('top' also hits 'laptop').
    Blank or null text gives all false."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = {}
    for name, words in KEYWORD_SIGNALS.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out[name] = hit
    return out


def query_signals(df: DataFrame, text_col: str = "query") -> DataFrame:
    flags = keyword_flags(F.col(text_col))
    return df.select("*", *[c.alias(n) for n, c in flags.items()])


def search_queries(clicks: DataFrame) -> DataFrame:
    """Search text of search_query events: ``metadata.query``."""
    return clicks.filter(F.col("action") == SEARCH_QUERY).select(
        "session_id", "event_id", "timestamp", F.get_json_object("metadata", "$.query").alias("query")
    )


def session_signals(signals: DataFrame, key: str = "session_id") -> DataFrame:
    """Any-signal roll-up per key (partial aggregation before the shuffle)."""
    return signals.groupBy(key).agg(*[F.bool_or(n).alias(n) for n in SIGNALS], F.count(F.lit(1)).alias("n_queries"))


# --- first balanced JSON object -------------------------------------------------
# Segments: a run of ordinary characters followed by one token: an escape
# (backslash + any char), a quote, a brace, or the end of the text. The run is
# possessive and the end is a token, so every match attempt succeeds at once
# (linear in the text; no backtracking over a long tail). The fold runs per
# segment, not per character.
_SEGMENT = r'(?s)[^\\"{}]*+(?:\\.|\\|"|\{|\}|$)'


def first_json_object(text: Column) -> Column:
    """The first balanced ``{...}`` in ``text`` (string- and escape-aware), or null."""
    start = F.instr(text, "{")
    rest = F.substring(text, start, F.length(text))
    segs = F.regexp_extract_all(rest, F.lit(_SEGMENT), 0)
    init = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("instr"),
                    F.lit(0).alias("pos"), F.lit(None).cast("int").alias("end"))

    def step(s: Column, seg: Column) -> Column:
        pos = s["pos"] + F.length(seg)
        tok = F.substring(seg, -1, 1)
        esc = (F.length(seg) >= 2) & (F.substring(seg, -2, 1) == F.lit("\\"))
        depth = (F.when(s["end"].isNotNull() | esc | s["instr"], s["depth"])
                 .when(tok == "{", s["depth"] + 1).when(tok == "}", s["depth"] - 1).otherwise(s["depth"]))
        instr = F.when(s["end"].isNull() & ~esc & (tok == '"'), ~s["instr"]).otherwise(s["instr"])
        closes = s["end"].isNull() & ~esc & ~s["instr"] & (tok == "}") & (s["depth"] - 1 == 0)
        end = F.when(closes, pos).otherwise(s["end"])
        return F.struct(depth.alias("depth"), instr.alias("instr"), pos.alias("pos"), end.alias("end"))

    end = F.aggregate(segs, init, step)["end"]
    return F.when((start > 0) & end.isNotNull(), F.substring(rest, 1, end))


# Values are read as text (raw JSON for nested ones); numbers are cast afterwards, as a response may quote them.
PLAN_FIELDS = ["action", "confidence", "reasoning", "product_context", "customer_segment"]
SLM_FIELDS = ["intent", "reasoning", "confidence"]
_STRICT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad", "allowSingleQuotes": "false"}
# After an object only white space may follow.
_ONE_OBJECT = r"(?s)\A[ \t\r\n]*\{.*\}[ \t\r\n]*\z"


def parsed_object(text: Column, fields: list[str]) -> Column:
    """The named fields of a strict JSON object as text, or null when ``text`` is anything else.

    Strict: double quotes only, no raw control characters in strings, nothing
    behind the object.
    """
    schema = T.StructType([*[T.StructField(f, T.StringType()) for f in fields], T.StructField("__bad", T.StringType())])
    p = F.from_json(text, schema, _STRICT)
    whole = text.rlike(_ONE_OBJECT) & (F.trim(first_json_object(text)) == F.trim(F.regexp_replace(text, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")))
    return F.when(whole & p["__bad"].isNull(), p)


def number(text: Column, default: float) -> tuple[Column, Column]:
    """(value, failed) of a number given as JSON number or text; an absent one is ``default``."""
    value = F.trim(text).try_cast("double")
    return F.when(text.isNull(), F.lit(default)).otherwise(value), text.isNotNull() & value.isNull()


# --- fixed values: fallback keyword scan order of the planner -------------------
PLANNER_FALLBACK_ACTIONS = ["OFFER_BUNDLE", "SEND_ABANDON_EMAIL", "OFFER_DISCOUNT", "SEND_TO_HUMAN", "SHOW_URGENCY"]


def planner_resolution(responses: DataFrame) -> DataFrame:
    """Resolve raw planner responses (session_id, text, error) into a proposal.

    Parsed JSON object -> its fields with defaults (NO_ACTION, 0.5,
    'LLM analysis', '', 'unknown'); no balanced object or unparsable -> keyword
    scan (first hit in a fixed order) with confidence 0.6 and the first 500
    characters as reasoning; an error -> NO_ACTION with confidence 0.0. A
    confidence given as text counts as its number (null if it is none).
    """
    js = first_json_object(F.col("text"))
    df = responses.withColumn("json_text", js)
    df = df.withColumn("__p", parsed_object(F.col("json_text"), PLAN_FIELDS))
    df = df.withColumn("__confidence", number(F.col("__p.confidence"), 0.5)[0]).withColumn("__valid", F.col("__p").isNotNull())
    kw = F.lit("NO_ACTION")
    for a in reversed(PLANNER_FALLBACK_ACTIONS):
        kw = F.when(F.coalesce(F.col("text"), F.lit("")).contains(a), F.lit(a)).otherwise(kw)
    err = F.col("error").isNotNull()
    valid = F.col("__valid")
    return df.select(
        "session_id",
        F.when(err, "error").when(valid, "parsed").otherwise("keyword_fallback").alias("outcome"),
        F.when(err, F.lit("NO_ACTION")).when(valid, F.coalesce(F.col("__p.action"), F.lit("NO_ACTION")))
        .otherwise(kw).alias("action"),
        F.when(err, F.lit(0.0)).when(valid, F.col("__confidence"))
        .otherwise(F.lit(0.6)).alias("confidence"),
        F.when(err, F.concat(F.lit("Planner error: "), F.substring(F.col("error"), 1, 200)))
        .when(valid, F.coalesce(F.col("__p.reasoning"), F.lit("LLM analysis")))
        .otherwise(F.substring(F.coalesce(F.col("text"), F.lit("")), 1, 500)).alias("reasoning"),
        F.when(valid & ~err, F.coalesce(F.col("__p.product_context"), F.lit(""))).otherwise(F.lit("")).alias("product_context"),
        F.when(valid & ~err, F.coalesce(F.col("__p.customer_segment"), F.lit("unknown"))).otherwise(F.lit("unknown")).alias("customer_segment"),
    )


def response_outcomes(resolved: DataFrame) -> DataFrame:
    """Counts per outcome (parsed / keyword_fallback / error)."""
    return resolved.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def slm_resolution(responses: DataFrame, json_col: str = "text") -> DataFrame:
    """Enrichment responses (session_id, JSON text) -> (ext_intent, ext_confidence, reasoning).

    Defaults: intent BROWSING, reasoning '', confidence 0.0; a confidence given
    as text counts as its number. Content that is empty, not one strict JSON
    object, or has a confidence that is no number gives no row (no override)."""
    df = responses.withColumn("__p", parsed_object(F.col(json_col), SLM_FIELDS))
    confidence, failed = number(F.col("__p.confidence"), 0.0)
    return df.where(F.col("__p").isNotNull() & ~F.coalesce(failed, F.lit(False))).select(
        "session_id",
        F.coalesce(F.col("__p.intent"), F.lit("BROWSING")).alias("ext_intent"),
        confidence.alias("ext_confidence"),
        F.coalesce(F.col("__p.reasoning"), F.lit("")).alias("ext_reasoning"),
    )
