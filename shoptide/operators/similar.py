"""Persistent approximate index for similar decisions, and vectors for decision texts.

``build_index`` assigns every vector to the nearest of at most ``MAX_CELLS``
coarse centroids and writes the vectors clustered by cell. ``search`` sends a
query only to the cells nearest to it, computes exact cosines there and keeps
the k best. The number of cells a query visits is not fixed: it is the smallest
one that reaches ``recall`` on the half of the sample that the centroids have
not seen, so clustered vectors need few cells and evenly spread ones many.

* The centroids come from a sample of at most ``SAMPLE_ROWS`` vectors (chosen by
  a hash of the id); it and the centroids are the only rows that reach the
  driver. Every vector is indexed.
* Cells of any size: corpus rows of a cell are dealt into blocks by a hash of
  the id, and so are its queries, so a cell with a third of all rows is many
  tasks of bounded memory.
* Vectors that have no direction or another length than the index (null, empty,
  all zero, not finite, other dimension) are kept in cell ``NO_CELL``: they are
  nobody's neighbour and have none. Rows without an id are left out. Of rows
  with one id the one with the largest vector stays. An empty table gives an
  index without cells, and searches give no rows.
* Equal scores are ordered by id (scores are rounded to 12 digits first, so the
  order does not depend on how rows were dealt).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoptide.session import materialize

SAMPLE_ROWS = 8192
MAX_CELLS = 256
NO_CELL = -1
BLOCK_ROWS = 4096
QUERY_ROWS = 512  # similarities are worked out so many queries at a time: 16 MB beside a block of rows
VECTOR_DIM = 384
VECTOR_SEED = "decision"

# Ship this module's functions by value to the Python workers, so they do not
# need the package on their import path.
try:  # pragma: no cover - depends on the installed pyspark
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass


# --- vectors of decision texts ---------------------------------------------------
def text_vector(text: Column, dim: int = VECTOR_DIM, seed: str = VECTOR_SEED) -> Column:
    """Signed hashed counts of the words and word pairs of ``text`` (null: of no words).

    A feature's 32-bit keyed hash gives its place (remainder by ``dim``) and its
    sign (parity of the quotient), so the vector depends on nothing but the text.
    """
    def once(value: Column, then) -> Column:
        """``then(value)`` with value worked out once, however often it is read."""
        return F.transform(F.array(value), then)[0]

    def pairs(words: Column) -> Column:
        return F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                           lambda w, i: F.concat(F.element_at(words, i + 1), F.lit(" "), w))

    def mark(feature: Column) -> Column:
        keyed = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), feature).cast("binary")), 1, 8), 16, 10).cast("long")
        return once(keyed, lambda h: F.struct((h % dim).cast("int").alias("at"),
                                              F.when(F.floor(h / dim) % 2 == 0, 1.0).otherwise(-1.0).alias("sign")))

    def place_sums(marks: Column) -> Column:
        return F.map_from_entries(F.transform(F.array_distinct(marks["at"]), lambda d: F.struct(d, F.aggregate(
            F.filter(marks, lambda m: m["at"] == d), F.lit(0.0), lambda a, m: a + m["sign"]))))

    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]+)"), 1)
    marks = once(words, lambda w: F.transform(F.concat(w, pairs(w)), mark))
    return once(once(marks, place_sums), lambda sums: F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.coalesce(F.element_at(sums, d.cast("int")), F.lit(0.0))))


def trace_vectors(traces: DataFrame, dim: int = VECTOR_DIM) -> DataFrame:
    """Decision traces with the vector of their summary."""
    return traces.withColumn("vector", text_vector(F.col("summary"), dim))


# --- centroids ---------------------------------------------------------------------
def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _centroids(rows: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from the first distinct rows; a cell that empties keeps its place."""
    c = np.unique(rows, axis=0, return_index=True)[1]
    c = rows[np.sort(c)[:cells]].copy()
    for _ in range(rounds):
        near = (rows @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, rows)
        norms = np.linalg.norm(sums, axis=1)
        c[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return c


def _probes(centroids: np.ndarray, rows: np.ndarray, k: int, recall: float, queries: int = 512) -> int:
    """The fewest cells that hold ``recall`` of the k nearest rows, over ``rows`` searched by themselves."""
    if len(rows) < 2:
        return len(centroids)
    q = rows[:queries]
    cell = (rows @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)[:, cell]
    score = np.round(q @ rows.T, 12)
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.lexsort((place, -score), axis=1)[:, :min(k, len(rows) - 1)]
    needed = np.sort(np.take_along_axis(place, best, axis=1).ravel())
    return int(needed[math.ceil(recall * len(needed)) - 1]) + 1


def _usable(vec: Column, dim: int | None = None) -> Column:
    v = vec.cast("array<double>")
    norm = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    ok = (norm > 0) & (norm < float("inf"))  # null parts make the sum null
    return F.coalesce(ok if dim is None else ok & (F.size(v) == dim), F.lit(False))


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    named = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    return named.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("vec").alias("vec"))


# --- index ---------------------------------------------------------------------------
def build_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
                recall: float = 0.96, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
    """Write the index of ``vectors`` under ``path`` (``model`` and ``cells``).

    ``recall`` is what the held-out half of the sample must reach; the number of
    cells follows from the rows (root of their number, at most ``MAX_CELLS`` and
    an eighth of the sample's fitted half).
    """
    spark = vectors.sparkSession
    rows = materialize(_rows(vectors, id_col, vec_col), "index_rows")
    usable = rows.where(_usable(F.col("vec")))
    n = usable.count()
    share = min(1.0, 2.0 * sample_rows / max(n, 1))  # keeps the rows that reach the sort bounded
    drawn = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = drawn.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample_rows).select("vec").collect()
    model, probes, dim = [], 0, 0
    if picked:
        sizes = np.bincount([len(r.vec) for r in picked])
        dim = int(sizes.argmax())
        sample = _unit(np.array([r.vec for r in picked if len(r.vec) == dim]))
        half = max(1, (len(sample) + 1) // 2)
        fitted = cells or min(MAX_CELLS, math.ceil(math.sqrt(n)), max(1, half // 8))
        model = _centroids(sample[:half], min(fitted, MAX_CELLS))
        probes = _probes(model, sample[half:], k, recall)
    spark.createDataFrame([(i, c.tolist(), probes, dim) for i, c in enumerate(model)],
                          "cell int, centroid array<double>, probes int, dim int"
                          ).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    _with_cell(rows, _Model(spark, path)).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(
        f"{path}/cells")


class _Model:
    """Centroids of an index: at most MAX_CELLS rows."""

    def __init__(self, spark: SparkSession, path: str):
        rows = spark.read.parquet(f"{path}/model").orderBy("cell").collect()
        self.centroids = np.array([r.centroid for r in rows])
        self.probes, self.dim = (rows[0].probes, rows[0].dim) if rows else (0, 0)


def _nearest(vec: Column, model: _Model, count: int) -> Column:
    """The ``count`` nearest cells of each vector, nearest first."""
    shared = SparkSession.active().sparkContext.broadcast(model.centroids)

    @F.pandas_udf("array<int>")
    def cells(batch: pd.Series) -> pd.Series:
        near = np.argsort(-(_unit(np.stack(batch.to_numpy())) @ shared.value.T), axis=1, kind="stable")
        return pd.Series(list(near[:, :count].astype(np.int32)))

    return cells(vec)


def _with_cell(rows: DataFrame, model: _Model) -> DataFrame:
    """Rows with their cell; rows without a direction in NO_CELL."""
    if not len(model.centroids):
        return rows.withColumn("cell", F.lit(NO_CELL))
    ok = _usable(F.col("vec"), model.dim)
    stand_in = F.array(*[F.lit(float(x)) for x in model.centroids[0]])  # keeps every batch rectangular
    near = _nearest(F.when(ok, F.col("vec")).otherwise(stand_in), model, 1)
    return rows.withColumn("cell", F.when(ok, near[0]).otherwise(F.lit(NO_CELL)))


def _stored(spark: SparkSession, path: str, id_type: str) -> DataFrame:
    return spark.read.schema(f"id {id_type}, vec array<double>, cell int").parquet(f"{path}/cells")


def append_index(vectors: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """Add the vectors whose ids the index lacks; the centroids stay. Appending again changes nothing."""
    spark = vectors.sparkSession
    rows = _rows(vectors, id_col, vec_col)
    held = _stored(spark, path, rows.schema["id"].dataType.simpleString()).select("id")
    new = materialize(_with_cell(rows.join(held, "id", "left_anti"), _Model(spark, path)), "index_new")
    new.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{path}/cells")


def _best(k: int, exclude_self: bool):
    def block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "cid": [], "score": []}
        if len(q) and len(c):
            c = c.sort_values("id")
            cid = c["id"].to_numpy()
            ids, unit_q, unit_c = q["id"].to_numpy(), _unit(np.stack(q["vec"].to_numpy())), _unit(np.stack(c["vec"].to_numpy()))
            for i, qid in enumerate(ids):
                if i % QUERY_ROWS == 0:
                    s = np.round(unit_q[i:i + QUERY_ROWS] @ unit_c.T, 12)
                row = s[i % QUERY_ROWS]
                if exclude_self:
                    row[cid == qid] = -np.inf
                kth = np.partition(row, -min(k, len(row)))[-min(k, len(row))]
                at = np.nonzero((row >= kth) & np.isfinite(row))[0]
                at = at[np.argsort(-row[at], kind="stable")][:k]
                out["qid"] += [qid] * len(at)
                out["cid"] += list(cid[at])
                out["score"] += list(row[at])
        return pd.DataFrame(out)
    return block


def search(queries: DataFrame, path: str, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           exclude_self: bool = True, probes: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(qid, cid, score, rank): the k indexed vectors most similar to each query
    among the cells it visits. ``exclude_self`` leaves out the row with the query's own id."""
    spark = queries.sparkSession
    model = _Model(spark, path)
    q = _rows(queries, id_col, vec_col)
    id_type = q.schema["id"].dataType.simpleString()
    schema = f"qid {id_type}, cid {id_type}, score double, rank int"
    if not len(model.centroids):
        return spark.createDataFrame([], schema)
    q = q.where(_usable(F.col("vec"), model.dim))
    q = materialize(q.withColumn("cells", _nearest(F.col("vec"), model, probes or model.probes)), "index_queries")
    visits = q.select("id", "vec", F.explode("cells").alias("cell"))
    corpus = _stored(spark, path, id_type)
    # At most MAX_CELLS rows: how many blocks the queries and the rows of a visited cell make.
    blocks = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("nq")).join(
        corpus.groupBy("cell").agg(F.count(F.lit(1)).alias("nc")), "cell")
    blocks = blocks.select("cell", *[F.ceil(F.col(c) / block_rows).cast("int").alias(c) for c in ("nq", "nc")]).collect()
    small = F.broadcast(spark.createDataFrame([tuple(b) for b in blocks], "cell int, nq int, nc int"))
    # Visited cells as a literal list: the scan reads only their folders.
    corpus = corpus.where(F.col("cell").isin([b.cell for b in blocks]))

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        return rows.join(small, "cell").select(
            "id", "vec", "cell", F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own[1] + "b"),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other[1] + "b"))

    found = dealt(visits, "nq", "nc").groupBy("cell", "qb", "cb").cogroup(
        dealt(corpus, "nc", "nq").groupBy("cell", "qb", "cb")).applyInPandas(
            _best(k, exclude_self), f"qid {id_type}, cid {id_type}, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "cid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
