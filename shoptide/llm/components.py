"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the large-star / small-star method (Kiveris et al., 2014).

    Every node is pointed at its smallest neighbour: in the large step for the
    larger neighbours, in the small step for the smaller ones.
    """
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = written(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    moved = near.join(least, "a")
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node of its component.

    Rounds grow with the logarithm of the largest component; each is written in
    the shared folder. The driver reads one count and one checksum per round.
    """
    edges = written(edges.select("a", "b").where("a != b").distinct(), "edges")
    before = None
    while True:
        edges = written(_stars(_stars(edges, large=True), large=False), "edges")
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
