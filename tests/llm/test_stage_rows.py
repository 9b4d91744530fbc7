"""Stages that return whole rows: any column names, repeated rows, long texts, reopened indexes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shoptide.llm import exact_dedup, length_packing, ngram_jaccard_join, quality_classifier, quality_rules

from .conftest import SCHEMA, prose
from .test_models import corpus

NAMES = ["__id", "__key", "__cut", "__host", "__digest", "__text", "__copy", "row", "a.b", "c`d", "words", "id"]


@pytest.fixture
def oddly_named(docs):
    def make(rows):
        df = docs(rows)
        for name in NAMES:
            df = df.withColumns({name: F.concat(F.lit(name), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))})
        return df

    return make


def kept(out, df):
    assert out.columns == df.columns
    rows = out.collect()
    for r in rows:
        held = dict(zip(out.columns, r))
        assert all(held[n] == f"{n}{'-' if held['doc_id'] is None else held['doc_id']}" for n in NAMES)
    return sorted((r["doc_id"] or 0) for r in rows)


def test_any_column_names_pass_through_the_stages(spark, oddly_named):
    rng = random.Random(2)
    base = prose(rng, 40)
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join([*base, "more"])), (4, " ".join(prose(rng, 40))), (5, "few"), (6, None)]
    df = oddly_named(rows)
    assert kept(quality_rules.cleaned(df), df) == [1, 2, 3, 4]
    assert kept(exact_dedup.kept_rows(df), df) == [2, 3, 4, 5, 6]
    assert kept(ngram_jaccard_join.one_per_component(df), df) == [1, 4, 5, 6]
    texts, labels = corpus("quality", 60)
    df = oddly_named(texts)
    out = quality_classifier.accepted(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 0 < len(kept(out, df)) <= len(texts)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.scored(empty, labels).collect() == []
    assert quality_classifier.accepted(empty, labels).collect() == []


def test_an_index_keeps_its_number_of_buckets(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    texts = [(i, f"text {i}") for i in range(200)]
    exact_dedup.deduplicate(docs(texts), index).count()
    index.close()
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path=index.path, buckets=16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        again = exact_dedup.DigestIndex(spark, path=index.path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert again.buckets == 4
    assert not any(r["kept"] for r in exact_dedup.deduplicate(docs([(1000 + i, t) for i, t in texts]), again).collect())


def test_a_compacted_index_has_a_sorted_file_per_bucket(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    for k in range(3):
        exact_dedup.deduplicate(docs([(i, f"text {i}") for i in range(k * 50, k * 50 + 60)]), index).count()
    held = {r["digest"] for r in index.rows().collect()}
    index.compact()
    assert {r["digest"] for r in index.rows().collect()} == held and len(held) == 160
    assert index.rows().select(F.input_file_name()).distinct().count() == 4
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        new = spark.createDataFrame([(bytearray(b"x"),)], "digest binary")
        plan = new.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    assert plan.count("Sort [") == 1
    second = exact_dedup.DigestIndex(spark, path=index.path)
    assert second.version == 1 and second.rows().count() == 160
    assert not any(r["kept"] for r in exact_dedup.deduplicate(docs([(9, "text 3")]), second).collect())


def test_repeated_rows_of_near_texts_are_one_set(docs):
    rng = random.Random(4)
    base = prose(rng, 60)
    rows = [(1, " ".join(base)), (2, " ".join([*base, "end"]))]
    start = time.time()
    few = {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join.link_components(docs(rows * 3)).collect()}
    once = time.time() - start
    start = time.time()
    out = ngram_jaccard_join.link_components(docs(rows * 3000)).collect()
    assert len(out) == 6000 and {(r["doc_id"], r["component_id"]) for r in out} == set(few.items()) == {(1, 1), (2, 1)}
    assert time.time() - start < 3 * once + 20


def test_equal_sequences_are_dealt_in_blocks(spark):
    n = 3 * length_packing.COPIES + 17
    lengths = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(42).cast("long").alias("text_key"), F.lit(100).cast("long").alias("n_tokens"))
    out = length_packing.packed(lengths).select("batch", "slot").collect()
    capacity = length_packing.BUDGET // 100
    assert sorted(map(tuple, out)) == [divmod(k, capacity) for k in range(n)]
