"""Chunked prefix scans: running aggregates over an ordered key without one hot task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one
task. When one key (a session, a user) holds a large share of all rows that task
is the whole job. Here each key is cut into *chunks* (for event data: time
buckets), the window runs per ``(key, chunk)``, and a small per-chunk summary
carries totals from earlier chunks forward:

    running(x) at row r = combine(carry(chunks before r's chunk), local_running(x) at r)

This is exact for decomposable aggregates (sum, max, min), for the value of the
previous row (``lag``) and for sums of a predicate over consecutive rows
(``pairsum``: e.g. "category differs from the previous row"), whose term at a
chunk's first row is settled in the summary from the previous chunk's last value.

Only a key with more than ``HOT_ROWS`` rows is cut: one pass counts the rows per
key (partial counts before the shuffle), and a key with fewer is one chunk, whose
window needs no summary. The keys above it, at most the row count over
``HOT_ROWS``, are broadcast.

Plan shape: the count, then one hash exchange of all rows on ``(key, chunk)`` and
the windows on it. The summary comes from a branch of its own that holds the rows
of the large keys alone; it has one row per non-empty chunk of those, so its size
is bounded by a key's time span over the chunk width, not by its row count. Without
large keys AQE finds that branch empty and leaves it and its join out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KINDS = ("sum", "max", "min")
HOT_ROWS = 20_000  # rows of a key that one task may scan; a larger key is cut into chunks

PairFn = Callable[[Column, Column], Column]


def time_chunk(ts: Column | str, seconds: int) -> Column:
    """Chunk id of a timestamp (NTZ or LTZ): floor(epoch seconds / width)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(col.cast("timestamp")) / F.lit(seconds * 1_000_000))


def running_scan(
    df: DataFrame,
    by: Sequence[str],
    chunk: str,
    order: Sequence[str | Column],
    aggs: dict[str, tuple[str, Column]] | None = None,
    prev: dict[str, Column] | None = None,
    pairsums: dict[str, tuple[Column, PairFn]] | None = None,
    distincts: dict[str, Column] | None = None,
    gapsums: dict[str, tuple[Column, PairFn]] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add running aggregates per ``by`` key in ``order``.

    ``chunk`` must be a column of ``df`` that is non-decreasing in ``order``
    within each key (e.g. a time bucket of the order timestamp). Rows with a null
    key form one key, rows with a null chunk (no time) come first in theirs: every
    row comes out.

    aggs:     ``name -> (kind, expr)``, kind in sum/max/min, frame = all rows up
              to and including the current one.
    prev:     ``name -> expr``: ``expr`` on the previous row (null on the key's first row).
    pairsums: ``name -> (expr, f)``: running sum of ``f(expr, previous expr)``
              (numeric, null counts 0) over consecutive rows; the key's first
              row contributes nothing.
    distincts: ``name -> expr``: running count of distinct non-null values of
              ``expr``. Meant for low-cardinality values (categories): each
              chunk summary carries the set of values it contains, and of
              those the ones that no earlier chunk has.
    gapsums:  ``name -> (expr, f)``: as pairsums over the rows whose ``expr`` is
              not null alone; other rows have the sum of the rows before them.
    hot_rows: a key with more rows is cut into chunks.
    """
    aggs = aggs or {}
    prev = prev or {}
    pairsums = pairsums or {}
    distincts = distincts or {}
    gapsums = gapsums or {}
    for name, (kind, _) in aggs.items():
        if kind not in _KINDS:
            raise ValueError(f"unsupported running kind {kind!r} for {name}")
    keys = [*by, chunk]
    order_cols = [F.col(chunk), *[c if isinstance(c, Column) else F.col(c) for c in order]]  # rows with a null chunk first
    order_key = F.struct(*order_cols)
    w_local = Window.partitionBy("_rs_k").orderBy(*order_cols)
    w_run = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_past = w_local.rowsBetween(Window.unboundedPreceding, -1)
    agg_fn = {"sum": F.sum, "max": F.max, "min": F.min}
    inputs = {f"_rs_x_{n}": e for n, (_, e) in aggs.items()}
    inputs.update({f"_rs_v_{n}": e for n, e in prev.items()})
    inputs.update({f"_rs_y_{n}": e for n, (e, _) in {**pairsums, **gapsums}.items()})
    inputs.update({f"_rs_d_{n}": e for n, e in distincts.items()})

    # The keys as one struct, which is never null: null keys meet each other in a plain equi-join, and the exchange of the
    # rows serves the windows and the join (a null-safe join on the keys themselves would shuffle the rows anew).
    def keyed(cut: Column) -> Column:
        return F.struct(*[F.col(k) for k in by], F.when(cut, F.col(chunk)).alias(chunk)).alias("_rs_k")

    if by:
        who = F.struct(*[F.col(k) for k in by]).alias("_rs_b")
        hot = df.groupBy(who).agg(F.count(F.lit(1)).alias("_rs_n")).where(F.col("_rs_n") > hot_rows).select("_rs_b", F.lit(True).alias("_rs_hot"))
        named = df.select("*", who)
        rows = named.join(F.broadcast(hot), "_rs_b", "left").select(*df.columns, keyed(F.col("_rs_hot").isNotNull()))
        hot_part = named.join(F.broadcast(hot), "_rs_b", "left_semi").select(*df.columns, keyed(F.lit(True)))
    else:
        rows = hot_part = df.select("*", keyed(F.lit(True)))

    def windowed(part: DataFrame) -> DataFrame:
        """The rows with what their own chunk gives; the inputs of the scan are made behind the exchange."""
        local = part.repartition("_rs_k").select("*", *[e.alias(n) for n, e in inputs.items()])
        for name in distincts:
            # first row of this value within the chunk (same partitioning: no new exchange)
            w_val = Window.partitionBy("_rs_k", f"_rs_d_{name}").orderBy(*order_cols)
            local = local.withColumn(f"_rs_f_{name}", F.col(f"_rs_d_{name}").isNotNull() & (F.row_number().over(w_val) == 1))
        win = [agg_fn[kind](f"_rs_x_{name}").over(w_run).alias(f"_rs_l_{name}") for name, (kind, _) in aggs.items()]
        win += [F.lag(f"_rs_v_{name}").over(w_local).alias(f"_rs_p_{name}") for name in prev]
        win += [F.lag(f"_rs_y_{name}").over(w_local).alias(f"_rs_py_{name}") for name in pairsums]
        win += [F.last(f"_rs_y_{name}", ignorenulls=True).over(w_past).alias(f"_rs_py_{name}") for name in gapsums]
        local = local.select("*", *win, (F.row_number().over(w_local) == 1).alias("_rs_first"))
        for name, (_, fn) in pairsums.items():
            term = F.coalesce(fn(F.col(f"_rs_y_{name}"), F.col(f"_rs_py_{name}")), F.lit(0))
            local = local.withColumn(f"_rs_term_{name}", F.when(F.col("_rs_first"), F.lit(0)).otherwise(term))
        for name, (_, fn) in gapsums.items():
            cur, old = F.col(f"_rs_y_{name}"), F.col(f"_rs_py_{name}")
            term = F.when(cur.isNotNull() & old.isNotNull(), F.coalesce(fn(cur, old), F.lit(0))).otherwise(F.lit(0))
            local = local.withColumn(f"_rs_term_{name}", term)
        sums = [F.sum(f"_rs_term_{n}").over(w_run).alias(f"_rs_s_{n}") for n in [*pairsums, *gapsums]]
        return local.select("*", *sums) if sums else local

    # Per-chunk summary from the windowed rows of the large keys (already clustered by the keys).
    summary_aggs = [agg_fn[kind](f"_rs_x_{n}").alias(f"_rs_t_{n}") for n, (kind, _) in aggs.items()]
    summary_aggs += [F.max_by(f"_rs_v_{n}", order_key).alias(f"_rs_z_{n}") for n in prev]
    for n in [*pairsums, *gapsums]:
        at = order_key if n in pairsums else F.when(F.col(f"_rs_y_{n}").isNotNull(), order_key)
        summary_aggs += [
            F.min_by(f"_rs_y_{n}", at).alias(f"_rs_fy_{n}"),
            F.max_by(f"_rs_y_{n}", at).alias(f"_rs_ly_{n}"),
            F.sum(f"_rs_term_{n}").alias(f"_rs_ty_{n}"),
        ]
    summary_aggs += [F.collect_set(f"_rs_d_{n}").alias(f"_rs_set_{n}") for n in distincts]
    held_keys = [F.col(f"_rs_k.`{k}`").alias(k) for k in keys]
    summary = windowed(hot_part).groupBy("_rs_k").agg(*summary_aggs).select("*", *held_keys)
    # One row per chunk; with no key (a global order) this window holds only the
    # chunk summaries, bounded by the time span over the chunk width.
    w_chunks = (Window.partitionBy(*by) if by else Window).orderBy(chunk)
    w_before = w_chunks.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [agg_fn[kind](f"_rs_t_{n}").over(w_before).alias(f"_rs_c_{n}") for n, (kind, _) in aggs.items()]
    carry_cols += [F.lag(f"_rs_z_{n}").over(w_chunks).alias(f"_rs_q_{n}") for n in prev]
    for n, (_, fn) in {**pairsums, **gapsums}.items():
        first, before = F.col(f"_rs_fy_{n}"), F.lag(f"_rs_ly_{n}").over(w_chunks)
        if n in gapsums:
            before = F.last(f"_rs_ly_{n}", ignorenulls=True).over(w_before)
        bnd = F.coalesce(fn(first, before), F.lit(0))
        if n in gapsums:
            bnd = F.when(first.isNotNull() & before.isNotNull(), bnd).otherwise(F.lit(0))
        carry_cols.append(bnd.alias(f"_rs_b_{n}"))
    for n in distincts:
        # A value is new in the first chunk that has it: one row per (key, value, chunk), never a list of earlier chunks.
        held = summary.select(*keys, F.explode(f"_rs_set_{n}").alias("_rs_value"))
        firsts = held.groupBy(*by, "_rs_value").agg(F.min(chunk).alias(chunk), F.count_if(F.col(chunk).isNull()).alias("_rs_none"))
        firsts = firsts.withColumn(chunk, F.when(F.col("_rs_none") > 0, F.lit(None)).otherwise(F.col(chunk)))
        news = firsts.groupBy(F.struct(*[F.col(k) for k in keys]).alias("_rs_k")).agg(F.collect_set("_rs_value").alias(f"_rs_new_{n}"))
        summary = summary.join(news, "_rs_k", "left")
        carry_cols += [F.col(f"_rs_new_{n}"), F.coalesce(F.sum(F.size(F.coalesce(f"_rs_new_{n}", F.array()))).over(w_before), F.lit(0)).alias(f"_rs_seen_{n}")]
    carry = summary.select("_rs_k", *keys, *carry_cols, *[f"_rs_ty_{n}" for n in [*pairsums, *gapsums]])
    if pairsums or gapsums:
        carry = carry.select(
            "*",
            *[F.coalesce(F.sum(F.col(f"_rs_ty_{n}") + F.col(f"_rs_b_{n}")).over(w_before), F.lit(0)).alias(f"_rs_cs_{n}")
              for n in [*pairsums, *gapsums]],
        )

    # A key of one chunk has no carry: nothing comes before it, and each of its values is new.
    out = windowed(rows).join(carry.drop(*keys).withColumn("_rs_carried", F.lit(True)), "_rs_k", "left")
    if distincts:
        new = {n: F.col(f"_rs_f_{n}") & (F.col("_rs_carried").isNull() | F.coalesce(F.array_contains(f"_rs_new_{n}", F.col(f"_rs_d_{n}")), F.lit(False)))
               for n in distincts}
        out = out.select("*", *[F.sum(F.when(c, 1).otherwise(0)).over(w_run).alias(f"_rs_nl_{n}") for n, c in new.items()])
    final = []
    for name, (kind, _) in aggs.items():
        c, l = F.col(f"_rs_c_{name}"), F.col(f"_rs_l_{name}")
        if kind == "sum":
            val = F.when(c.isNull(), l).otherwise(c + F.coalesce(l, F.lit(0)))
        elif kind == "max":
            val = F.greatest(c, l)
        else:
            val = F.least(c, l)
        final.append(val.alias(name))
    for name in prev:
        final.append(F.when(F.col("_rs_first"), F.col(f"_rs_q_{name}")).otherwise(F.col(f"_rs_p_{name}")).alias(name))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    for name in pairsums:
        final.append((zero(f"_rs_cs_{name}") + zero(f"_rs_b_{name}") + F.col(f"_rs_s_{name}")).alias(name))
    for name in gapsums:
        begun = F.col(f"_rs_y_{name}").isNotNull() | F.col(f"_rs_py_{name}").isNotNull()
        final.append((zero(f"_rs_cs_{name}") + F.when(begun, zero(f"_rs_b_{name}")).otherwise(F.lit(0)) + F.col(f"_rs_s_{name}")).alias(name))
    for name in distincts:
        final.append((zero(f"_rs_seen_{name}") + F.col(f"_rs_nl_{name}")).cast("long").alias(name))
    made = {*aggs, *prev, *pairsums, *gapsums, *distincts}
    return out.select(*[c for c in df.columns if c not in made], *final)
