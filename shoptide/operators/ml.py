"""Model training and scoring with pyspark.ml: training set, stratified split,
RandomForest, per-class report."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoptide.schema import FEATURE_ORDER

FOREST_PARTS = 24  # tasks of a pass over the training rows, at least
FOREST_ROWS = 250_000  # training rows a task
#: Rows that take the same way through the trees stand together, so that a task counts into few nodes at a time.
FOREST_ORDER = ["label", "total_actions", "page_views", "cart_adds", "cart_removes", "checkouts", "searches", "total_cart_value", "session_id"]


def training_set(features: DataFrame, labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Session features with a label per session (``labels``: session_id, label)."""
    return features.join(labels.select("session_id", F.col(label_col).alias("label")), "session_id", "inner")


def stratified_split(df: DataFrame, train_fraction: float = 0.8, label_col: str = "label") -> DataFrame:
    """Deterministic stratified split: within each class, sessions ordered by
    md5(session_id); the first ceil(fraction * class size) are ``train``.

    A count per (label, first three md5 digits) says for each such chunk whether it
    lies before or after the class's limit; only the rows of the one chunk per class
    that holds the limit (1 in 4,096) are ranked, the others are not shuffled. The
    counts, at most 4,096 a class, are broadcast. ``df`` is read three times: hand
    over a written table if it is costly."""
    d = df.withColumn("__h", F.md5(F.col("session_id")))
    # One struct, which is never null: rows without a label are a class like the others.
    d = d.withColumn("__k", F.struct(F.col(label_col).alias("label"), F.substring("__h", 1, 3).alias("chunk")))
    w_label = Window.partitionBy("__k.label")
    w_upto = w_label.orderBy("__k.chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = d.groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).select(
        "__k", "__n", F.sum("__n").over(w_upto).alias("__upto"),
        F.ceil(F.sum("__n").over(w_label) * F.lit(train_fraction)).alias("__limit"))
    placed = d.join(F.broadcast(sizes), "__k")
    before = F.col("__upto") - F.col("__n")
    cut = (before < F.col("__limit")) & (F.col("__upto") > F.col("__limit"))
    rank = before + F.row_number().over(Window.partitionBy("__k").orderBy("__h", "session_id"))
    last = placed.where(~cut).withColumn("__last", F.col("__upto"))
    last = last.unionByName(placed.where(cut).withColumn("__last", rank))
    return last.withColumn("split", F.when(F.col("__last") <= F.col("__limit"), F.lit("train")).otherwise(F.lit("test"))).drop(
        "__h", "__k", "__n", "__upto", "__limit", "__last")


def fit_forest(train: DataFrame, num_trees: int = 100, max_depth: int = 12, seed: int = 42):
    """StringIndexer(label) -> VectorAssembler(18 features) -> RandomForest.

    The forest draws its bags by partition and row number, so the rows are dealt by
    session and sorted first: the model depends on the rows, not on how they are
    stored. They are held while the forest reads them, and no task has more of
    them than about ``FOREST_ROWS``. The node that a row has reached in each tree is
    held from level to level too (the same trees, without walking them anew in each
    pass); these ids are not checkpointed, as they can be made again."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    idx = StringIndexer(inputCol="label", outputCol="label_idx", handleInvalid="keep")
    vec = VectorAssembler(inputCols=FEATURE_ORDER, outputCol="features_vec", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="features_vec", labelCol="label_idx", numTrees=num_trees,
                                maxDepth=max_depth, seed=seed, cacheNodeIds=True, checkpointInterval=-1)
    rows = train.select("session_id", "label", *[F.col(c).cast("double") for c in FEATURE_ORDER])
    parts = max(FOREST_PARTS, -(-rows.count() // FOREST_ROWS))
    rows = rows.repartition(parts, "session_id").sortWithinPartitions(*FOREST_ORDER).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=[idx, vec, rf]).fit(rows)
    finally:
        rows.unpersist()


def predict_intent(model, df: DataFrame) -> DataFrame:
    """Add ``ml_intent`` (most probable class) and ``ml_confidence`` (its probability)."""
    from pyspark.ml.functions import vector_to_array

    labels = model.stages[0].labels
    cast = df.select("*", *[F.col(c).cast("double").alias(f"__f_{c}") for c in FEATURE_ORDER])
    vec_stage = model.stages[1]
    scored = model.stages[2].transform(
        vec_stage.copy({vec_stage.inputCols: [f"__f_{c}" for c in FEATURE_ORDER]}).transform(cast))
    scored = scored.withColumn("__proba", vector_to_array(F.col("probability")))
    lab = F.array(*[F.lit(x) for x in labels])
    top = F.array_max("__proba")  # of equal probabilities the first class
    out = scored.withColumn("ml_confidence", top).withColumn(
        "ml_intent", F.element_at(lab, F.array_position(F.col("__proba"), top).cast("int")))
    return out.drop("features_vec", "rawPrediction", "probability", "prediction", "__proba",
                    *[f"__f_{c}" for c in FEATURE_ORDER])


def classification_report(pred: DataFrame, label_col: str = "label", pred_col: str = "prediction") -> DataFrame:
    """Per class: precision, recall, F1 and support, from (label, prediction) counts."""
    pairs = pred.groupBy(F.col(label_col).alias("l"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tp = pairs.where(F.col("l") == F.col("p")).select(F.col("l").alias("cls"), F.col("n").alias("tp"))
    sup = pairs.groupBy(F.col("l").alias("cls")).agg(F.sum("n").alias("support"))
    prd = pairs.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("predicted"))
    classes = sup.select("cls").union(prd.select("cls")).distinct()
    r = classes.join(tp, "cls", "left").join(sup, "cls", "left").join(prd, "cls", "left").fillna(0, ["tp", "support", "predicted"])
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    r = r.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return r.withColumn("f1", f1).select(F.col("cls").alias("class"), "precision", "recall", "f1",
                                         F.col("support").cast("long").alias("support"))
