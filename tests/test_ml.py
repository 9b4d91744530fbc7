"""Split, forest and scoring: every row is split, the model is a function of the rows, the forest runs once a row."""

import math

from pyspark.sql import functions as F

from shoptide.operators.intent import final_intent
from shoptide.operators.ml import fit_forest, predict_intent, stratified_split


def rows_of(features, n):
    return features(*[dict(session_id=f"s{i}", page_views=i % 7, cart_adds=i % 3, checkouts=i % 2, searches=i % 5,
                           total_cart_value=float(i * 10 % 170)) for i in range(n)])


def test_split_is_the_plain_ranking_and_keeps_rows_without_label(spark):
    labels = [None, "a", "b", "b", "b", "b", "c", "c"]
    rows = [(f"s{i}", labels[i % 8] if i != 5 else "alone") for i in range(6000)]
    df = spark.createDataFrame(rows, "session_id string, label string").repartition(5)
    got = {r.session_id: (r.label, r.split) for r in stratified_split(df, 0.7).collect()}
    import hashlib
    want = {}
    for lab in {label for _, label in rows}:
        ids = sorted((s for s, label in rows if label == lab), key=lambda s: hashlib.md5(s.encode()).hexdigest())
        limit = math.ceil(len(ids) * 0.7)
        want.update({s: (lab, "train" if k < limit else "test") for k, s in enumerate(ids)})
    assert got == want


def test_split_counts_equal_sessions_by_row(spark):
    df = spark.createDataFrame([("s1", "a", i) for i in range(10)], "session_id string, label string, i int")
    out = stratified_split(df)
    assert out.columns == ["session_id", "label", "i", "split"]
    assert sorted(r.split for r in out.collect()) == ["test"] * 2 + ["train"] * 8


def test_forest_does_not_depend_on_how_rows_are_stored(features):
    train = final_intent(rows_of(features, 400)).withColumn("label", F.col("rule_intent"))
    probe = rows_of(features, 60)

    def scores(layout):
        model = fit_forest(layout, num_trees=7, max_depth=4)
        return {r.session_id: (r.ml_intent, r.ml_confidence) for r in predict_intent(model, probe).collect()}

    assert scores(train.repartition(3, "page_views")) == scores(train.coalesce(1).orderBy(F.desc("total_cart_value")))
    assert not train.sparkSession.sparkContext._jsc.getPersistentRDDs()


def test_scores_are_the_first_class_of_the_highest_probability(features):
    from pyspark.ml.functions import vector_to_array

    feats = rows_of(features, 300)
    model = fit_forest(final_intent(feats).withColumn("label", F.col("rule_intent")), num_trees=4, max_depth=3)
    assert model.stages[2].getOrDefault("cacheNodeIds") and model.stages[2].getMaxDepth() == 3
    out = predict_intent(model, feats)
    proba = model.stages[2].transform(model.stages[1].transform(feats)).select("session_id", vector_to_array("probability").alias("p"))
    names = model.stages[0].labels
    want = {r.session_id: (names[r.p.index(max(r.p))], max(r.p)) for r in proba.collect()}
    assert {r.session_id: (r.ml_intent, r.ml_confidence) for r in out.collect()} == want
    # the vector is made into an array once, and no function is interpreted over its elements
    assert "transform(" not in out._jdf.queryExecution().optimizedPlan().toString()
