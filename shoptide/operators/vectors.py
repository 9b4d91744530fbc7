"""Decision traces and exact cosine top-k search over vectors.

Exact k-nearest-neighbour search must compare every query with every corpus
vector. The comparison is blocked: queries and corpus are hashed into blocks
sized from their counts, each (query block, corpus block) pair meets in one
task through a cogroup, and numpy computes the block's similarity matrix and
keeps only the k best per query. Only k rows per query and block leave a task;
no pair is ever a row. A final partial top-k (``row_number <= k``) merges the
blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERY_ROWS = 512  # a block's similarities are worked out so many queries at a time: 16 MB beside 4,096 corpus rows
TOPK_SCHEMA = "qid long, cid long, score double"

# Ship this module's functions by value to the Python workers, so they do not
# need the package on their import path.
try:  # pragma: no cover - depends on the installed pyspark
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass


def _block_topk(k: int, exclude_self: bool):
    def fn(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or cpdf.empty:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "cid": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        q = np.vstack(qpdf["vec"].to_numpy()).astype(np.float64)
        c = np.vstack(cpdf["vec"].to_numpy()).astype(np.float64)
        qn = np.linalg.norm(q, axis=1)
        cn = np.linalg.norm(c, axis=1)
        all_qid = qpdf["qid"].to_numpy()
        cid = cpdf["cid"].to_numpy()
        kk = min(k, len(c))
        out_q, out_c, out_s = [], [], []
        for lo in range(0, len(q), QUERY_ROWS):
            qid = all_qid[lo:lo + QUERY_ROWS]
            s = q[lo:lo + QUERY_ROWS] @ c.T
            s /= np.outer(qn[lo:lo + QUERY_ROWS], cn)
            if exclude_self:
                s[qid[:, None] == cid[None, :]] = -np.inf
            if kk > 0:
                thr = np.partition(s, s.shape[1] - kk, axis=1)[:, s.shape[1] - kk]
                for i in range(s.shape[0]):
                    idx = np.nonzero(s[i] >= thr[i])[0]
                    idx = idx[np.isfinite(s[i, idx])]
                    order = np.lexsort((cid[idx], -s[i, idx]))[:kk]
                    sel = idx[order]
                    out_q.append(np.full(len(sel), qid[i]))
                    out_c.append(cid[sel])
                    out_s.append(s[i, sel])
        if not out_q:
            return pd.DataFrame({"qid": pd.Series([], dtype="int64"), "cid": pd.Series([], dtype="int64"),
                                 "score": pd.Series([], dtype="float64")})
        return pd.DataFrame({"qid": np.concatenate(out_q).astype("int64"), "cid": np.concatenate(out_c).astype("int64"),
                             "score": np.concatenate(out_s)})
    return fn


def cosine_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    exclude_self: bool = True,
    block_rows: int = 4096,
) -> DataFrame:
    """(qid, cid, score, rank): the k corpus vectors most cosine-similar to each
    query (ties: smaller id first). Block counts come from two row counts. Block
    numbers have one type on both sides: an int and a long hash to different partitions."""
    nq = max(1, math.ceil(queries.count() / block_rows))
    nc = max(1, math.ceil(corpus.count() / block_rows))
    q = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vec_col).alias("vec"))
    c = corpus.select(F.col(id_col).cast("long").alias("cid"), F.col(vec_col).alias("vec"))
    q = q.select("*", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int").alias("qb"),
                 F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    c = c.select("*", F.pmod(F.xxhash64("cid"), F.lit(nc)).cast("int").alias("cb"),
                 F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    part = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(
        _block_topk(k, exclude_self), schema=TOPK_SCHEMA)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("cid"))
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- decision trace -----------------------------------------------------------------
def decision_summary(df: DataFrame, intent: str = "intent", action: str = "proposed_action",
                     verdict: str = "opa_verdict") -> DataFrame:
    """'User exhibited {intent} intent. SLM proposed {action}. OPA verdict: {verdict}.'"""
    return df.withColumn("summary", F.format_string("User exhibited %s intent. SLM proposed %s. OPA verdict: %s.",
                                                    F.col(intent), F.col(action), F.col(verdict)))


def closed_loop(decisions: DataFrame) -> DataFrame:
    """Allowed -> 'EXECUTED:<action>'; denied ->
    'DENIED:<proposed action>' and a decision trace row (summary, id from a hash
    of session, action and verdict)."""
    verdict = F.when(F.col("allowed"), F.lit("ALLOWED")).otherwise(F.lit("DENIED"))
    df = decisions.withColumn("opa_verdict", verdict)
    df = df.withColumn("result", F.when(F.col("allowed"), F.concat(F.lit("EXECUTED:"), F.col("action")))
                       .otherwise(F.concat(F.lit("DENIED:"), F.col("proposed_action"))))
    return decision_summary(df)


def decision_traces(closed: DataFrame) -> DataFrame:
    """Trace rows for denied decisions (the episodic memory)."""
    t = closed.where(F.col("opa_verdict") == "DENIED")
    tid = F.substring(F.sha2(F.concat_ws(":", "session_id", "proposed_action", "opa_verdict"), 256), 1, 16)
    return t.select(tid.alias("trace_id"), "session_id", "intent", "proposed_action", "opa_verdict", "summary")
