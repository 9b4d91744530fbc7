"""Intent classification: weighted rules, argmax with tie-break, calibration,
optional model fallback, external override, and the intent histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoptide.schema import CALIBRATION_A, CALIBRATION_B, INTENTS, RULE_CONFIDENCE_THRESHOLD


def _c(name: str) -> Column:
    return F.col(name)


def _add(cond: Column, points: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(points)).otherwise(F.lit(0))


def rule_score_columns() -> dict[str, Column]:
    """Score per intent: two additive rules each (fixed weights and thresholds)."""
    no_adds = _c("cart_adds") == 0
    return {
        "BROWSE": _add((_c("page_views") > 5) & no_adds, 3) + _add(_c("exploration_ratio") > 0.5, 2),
        "COMPARE": _add((_c("categories_viewed") > 3) & no_adds, 3)
        + _add(_c("page_views") > _c("cart_adds") * 3, 2),
        "CART_BUILDER": _add((_c("cart_adds") > _c("cart_removes")) & (_c("total_cart_value") > 50), 3)
        + _add(_c("cart_conversion_rate") > 0.3, 2),
        "CHECKOUT_INTENT": _add(_c("checkouts") > 0, 4)
        + _add((_c("total_cart_value") > 100) & (_c("exploration_ratio") < 0.3), 2),
        "PRICE_SENSITIVE": _add(_c("searches") > 3, 3) + _add(_c("cart_abandon_rate") > 0.5, 2),
        "CHURN_RISK": _add((_c("session_duration_sec") > 600) & no_adds, 2)
        + _add(_c("days_since_last_purchase") > 30, 3),
        "LOYAL_RETURNER": _add(_c("repeat_customer"), 3)
        + _add((_c("avg_inter_event_time") < 30) & (_c("total_cart_value") > 100), 2),
    }


def score_col(intent: str) -> str:
    return f"score_{intent.lower()}"


def rule_scores(features: DataFrame) -> DataFrame:
    """Add ``score_<intent>`` for the seven intents."""
    cols = rule_score_columns()
    return features.select("*", *[cols[i].alias(score_col(i)) for i in INTENTS])


def rule_intent(features: DataFrame) -> DataFrame:
    """Add ``rule_intent`` and ``rule_confidence`` (best / total, capped at 1).

    Argmax over (score, name): on equal scores the lexicographically greatest
    name wins. All-zero scores give (BROWSE, 0.0).
    """
    scored = features if score_col(INTENTS[0]) in features.columns else rule_scores(features)
    pairs = F.array(*[F.struct(F.col(score_col(i)).alias("s"), F.lit(i).alias("n")) for i in INTENTS])
    best = F.array_max(pairs)
    total = sum((F.col(score_col(i)) for i in INTENTS), F.lit(0))
    tmp = scored.select("*", best.alias("__best"), total.alias("__total"))
    zero = F.col("__total") == 0
    out = tmp.select(
        "*",
        F.when(zero, F.lit("BROWSE")).otherwise(F.col("__best.n")).alias("rule_intent"),
        F.when(zero, F.lit(0.0)).otherwise(
            F.least(F.col("__best.s").cast("double") / F.col("__total").cast("double"), F.lit(1.0))
        ).alias("rule_confidence"),
    )
    return out.drop("__best", "__total")


def calibrate(raw: Column, a: float = CALIBRATION_A, b: float = CALIBRATION_B) -> Column:
    """Platt sigmoid 1 / (1 + exp(-(a*x + b)))."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * raw + F.lit(b))))


def calibrated_intent(features: DataFrame) -> DataFrame:
    """Add ``calibrated_confidence`` to the rule result."""
    df = features if "rule_intent" in features.columns else rule_intent(features)
    return df.withColumn("calibrated_confidence", calibrate(F.col("rule_confidence")))


def final_intent(
    features: DataFrame,
    model=None,
    threshold: float = RULE_CONFIDENCE_THRESHOLD,
) -> DataFrame:
    """Choose rule or model: calibrated >= threshold keeps the rule result
    (method ``rule_based``); otherwise the model's most probable class with its
    probability (``ml_ensemble``). Without a model the rule result stands.

    ``model`` is a fitted ``pyspark.ml`` PipelineModel from :mod:`shoptide.operators.ml`
    (adds ``probability``/``prediction`` and a label array ``labels``).
    """
    df = calibrated_intent(features)
    conf = F.col("calibrated_confidence")
    if model is None:
        return df.select("*", F.col("rule_intent").alias("intent"), conf.alias("confidence"),
                         F.lit("rule_based").alias("method"))
    from shoptide.operators.ml import predict_intent

    scored = predict_intent(model, df)
    use_rule = conf >= threshold
    return (
        scored.withColumn("intent", F.when(use_rule, F.col("rule_intent")).otherwise(F.col("ml_intent")))
        .withColumn("confidence", F.when(use_rule, conf).otherwise(F.col("ml_confidence")))
        .withColumn("method", F.when(use_rule, F.lit("rule_based")).otherwise(F.lit("ml_ensemble")))
    )


def intent_override(pred: DataFrame, external: DataFrame) -> DataFrame:
    """An external (intent, confidence) per session replaces the prediction when
    its confidence is strictly greater. ``external`` has session_id,
    ext_intent, ext_confidence; at most one row per session (dedup first)."""
    j = pred.join(external, on="session_id", how="left")
    take = F.coalesce(F.col("ext_confidence") > F.col("confidence"), F.lit(False))
    rest = [c for c in j.columns if c not in ("intent", "confidence", "ext_intent", "ext_confidence")]
    return j.select(
        *rest,
        F.when(take, F.col("ext_intent")).otherwise(F.col("intent")).alias("intent"),
        F.when(take, F.col("ext_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        take.alias("overridden"),
    )


def intent_distribution(spark: SparkSession, pred: DataFrame, intent_col: str = "intent") -> DataFrame:
    """Histogram over the seven intents, zero-filled, plus a TOTAL row.

    The partial aggregate keeps at most one row per intent per task before the
    shuffle; the class list is a seven-row literal.
    """
    counts = pred.groupBy(F.col(intent_col).alias("intent")).agg(F.count(F.lit(1)).alias("n"))
    classes = spark.createDataFrame([(i,) for i in INTENTS], "intent string")
    per = classes.join(F.broadcast(counts), on="intent", how="left").select(
        "intent", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")
    )
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).select(
        F.lit("TOTAL").alias("intent"), "n"
    )
    return per.unionByName(total)
