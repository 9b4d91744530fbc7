"""A training corpus from raw documents: rules, classifier, exact dedup, near dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; every result is written as Parquet and read again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoptide.llm import exact_dedup, length_packing, ngram_jaccard_join, quality_classifier, quality_rules, token_records
from shoptide.llm.common import table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines that too many documents of a source share are cut from the others."""
    return quality_rules.cleaned(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.7 go; the model is trained on labelled rows of the raw documents."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"), training=table(spark, sf_dir, "documents"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact_dedup.kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links of similarity 0.8 or more, the one with the smallest doc_id stays."""
    return ngram_jaccard_join.one_per_component(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document that is left, measured in token ids."""
    return length_packing.packed(length_packing.sequence_lengths(docs, token_records.default_tokenizer()))


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("packing", packing)]

#: The classifier and the packing are beyond SQL; tests/llm/test_pipeline.py holds the pipeline against a plain rebuild.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
