"""Operator 11, Merkle manifest of a dataset: digests, proofs and their check, by nested-struct rollup.

A row's leaf is the SHA-256 of its fields; 16 consecutive nodes become one, per
source up to its subroot, then over the sources up to the root. Each row gets the
siblings along its way (its proof) and the root that folding them gives.

Rows get their rank within their source from one range partitioning: an index
within the partition plus the counts of earlier partitions, so a source with a
third of all rows is spread like any other. The last two hexadecimal digits of a
rank are then grouped away one after the other inside blocks of 256 nodes: 16
nodes with the same higher digits become an array of structs inside their
parent's struct, 16 parents an array inside their block's. A block is a row with
its whole small tree; the blocks' digests are the nodes of the next tier, until
each source has one. On the way back a block gets the path above it by a union
and a grouping, and one ``transform`` and ``explode`` hands it, with the siblings
inside the block, to each of its nodes. No node is joined with its siblings, and
no row is larger than 256 nodes and their paths.

A source with n nodes has a level of runs only while more than one node is left,
so each block carries n and passes a lone node through unchanged.

Defined results: a null field is hashed as ``-`` and an empty text as ``0:``;
rows without doc_id come first in their source, rows without a source form the
first source; rows with one doc_id are ordered by their leaf; repeated rows are
leaves of their own, with equal leaves and proofs of their own; a row without
doc_id is never tampered with; a table of one row has its leaf as root and the
digest of nothing as proof; an empty table gives an empty result. Extra columns
are ignored. Texts of any length are hashed whole, inside one expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import picked, table, written

FIELDS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
PATH = "array<struct<left:string,right:string>>"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_of(**fields: Column) -> Column:
    """SHA-256 of the fields in the order given: ``-`` if null, else its bytes' number, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields.values()]
    return _hash(F.concat(*parts))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank`` (0, 1, ...) of each row within its ``key`` in ``order`` and the key's number of rows ``n``."""
    columns = rows.columns
    rows = written(rows, "unranked").withColumn("salt", F.monotonically_increasing_id())
    by = ["key", *order, "salt"]  # the salt lets equal rows lie in several partitions
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(*columns, F.monotonically_increasing_id().alias("at"))
    placed = written(placed, "placed").withColumn("task", F.shiftright("at", 33))
    runs = placed.groupBy("key", "task").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    earlier = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition the key lies in
    runs = runs.select(
        F.col("key").alias("run_key"), F.col("task").alias("run_task"), F.sum("held").over(Window.partitionBy("key")).alias("n"),
        (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    met = placed.join(runs, (placed["key"] == runs["run_key"]) & (placed["task"] == runs["run_task"]))
    return met.select(*columns, (F.col("at") + F.col("shift")).alias("rank"), "n")


def _parent(n: Column, least: int, digests: Column) -> Column:
    """The digest of a run; where the level has one node only, that node."""
    return F.when(n > least, _hash(F.concat_ws("", digests))).otherwise(digests[0])


def rolled(nodes: DataFrame) -> DataFrame:
    """Blocks of up to 256 nodes (key, n, rank, digest, held): key, n, block, digest, and the nodes as nested structs in ``tree``."""
    n = F.col("n")
    rows = nodes.select("key", "n", F.shiftright("rank", 8).alias("block"), F.shiftright("rank", 4).bitwiseAND(15).alias("digit1"),
                        F.col("rank").bitwiseAND(15).alias("digit0"), "digest", "held").repartition("key", "block")
    runs = rows.groupBy("key", "n", "block", "digit1").agg(F.sort_array(F.collect_list(F.struct("digit0", "digest", "held"))).alias("nodes"))
    runs = runs.withColumn("digest", _parent(n, 1, F.col("nodes.digest")))
    blocks = runs.groupBy("key", "n", "block").agg(F.sort_array(F.collect_list(F.struct("digit1", "digest", "nodes"))).alias("tree"))
    return blocks.select("key", "n", "block", _parent(n, 16, F.col("tree.digest")).alias("digest"), "tree")


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """Written tables of blocks, each rolled up from the one before, until every key has one block."""
    out = []
    while True:
        blocks = written(rolled(nodes), "merkle-blocks")
        out.append(blocks)
        if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
            return out
        nodes = blocks.select("key", F.ceil(F.col("n") / 256).alias("n"), F.col("block").alias("rank"), "digest", F.lit(None).cast("string").alias("held"))


def _beside(digests: Column, i: Column) -> Column:
    """The siblings of node ``i`` of a run, as hex text."""
    return F.struct(F.concat_ws("", F.slice(digests, F.lit(1), i)).alias("left"),
                    F.concat_ws("", F.slice(digests, i + 2, F.lit(16))).alias("right"))


def _one_more(n: Column, least: int, step: Column, path: Column) -> Column:
    return F.when(n > least, F.concat(F.array(step), path)).otherwise(path)


def with_paths(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(key, rank, digest, held, path, top) of each node in the blocks; ``above``: (key, block, path, top) of each block."""
    both = blocks.select("key", "block", "n", "tree", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast(above.schema["top"].dataType).alias("top"))
    both = both.unionByName(above.select("key", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(blocks.schema["tree"].dataType).alias("tree"), "path", "top"))
    met = both.groupBy("key", "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "path", "top")])
    n, path = F.col("n"), F.col("path")
    upper = F.transform("tree", lambda run, i: F.struct(
        run["nodes"].alias("nodes"), i.alias("digit1"), _one_more(n, 16, _beside(F.col("tree.digest"), i), path).alias("path")))
    runs = met.select("key", "block", "n", "top", F.explode(upper).alias("run"))
    lower = F.transform("run.nodes", lambda node, j: F.struct(
        (F.col("block") * 256 + F.col("run.digit1") * 16 + j).alias("rank"), node["digest"].alias("digest"), node["held"].alias("held"),
        _one_more(n, 1, _beside(F.col("run.nodes.digest"), j), F.col("run.path")).alias("path")))
    return runs.select("key", "top", F.explode(lower).alias("node")).select("key", "node.*", "top")


def descended(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes of the lowest tier with their paths, from ``top``: (key, path, top) of each key."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for blocks in levels[:0:-1]:
        above = with_paths(blocks, above).select("key", F.col("rank").alias("block"), "path", "top")
    return with_paths(levels[0], above)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    The root is folded from the leaf of the row after tampering: where 5 divides
    crc32 of the decimal doc_id, the text's A-Z are lower-cased.
    """
    rows = picked(docs, **FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    fields = {c: F.col(c) for c in FIELDS}
    other = leaf_of(**{**fields, "text": F.translate("text", A_TO_Z, A_TO_Z.lower())})
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("+"), F.col("source")), F.lit("")).alias("key"),  # in order of the sources, null first
        "doc_id", leaf_of(**fields).alias("digest"), F.when(tampered, other).alias("after"))
    leaves = ranked(leaves, ["doc_id", "digest"]).select("key", "n", "rank", "digest", F.struct("doc_id", "after").alias("held"))
    per_source = tiers(leaves)
    subroots = per_source[-1].select(F.lit("").alias("key"), F.col("key").alias("held"), "digest")
    over_sources = tiers(ranked(subroots, ["held"]))
    nothing = F.array().cast(PATH)
    top = over_sources[-1].select("key", nothing.alias("path"), F.col("digest").alias("top"))
    sources = descended(over_sources, top).select(
        F.col("held").alias("key"), "path", F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"))
    found = descended(per_source, sources)
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    folded = F.aggregate("path", F.coalesce("held.after", "digest"), lambda below, s: _hash(F.concat(s["left"], below, s["right"])))
    out = found.select(F.col("held.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "top.subroot", "top.root",
                       _hash(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and its check for every row of ``documents``."""
    return manifest(table(spark, sf_dir, "documents"))


def _sql(levels: int = 6) -> str:
    """The tree level by level, for up to 16 ** levels rows a source and as many sources."""
    crc = ("xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT), lambda a, b: "
           "list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295), 4294967295)")
    leaf = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in FIELDS) + ")"
    other = leaf.replace("CAST(text AS VARCHAR)", f"translate(text, '{A_TO_Z}', '{A_TO_Z.lower()}')")
    parts = [f"""leaves AS (SELECT coalesce('+' || source, '') AS key, doc_id, {leaf} AS digest, CASE WHEN {crc} % 5 = 0 THEN {other} END AS after FROM documents)""",
             """numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, digest) - 1 AS rank, count(*) OVER (PARTITION BY key) AS n FROM leaves)""",
             "d0 AS (SELECT key, n, rank, digest FROM numbered)"]
    beside = """SELECT key, rank, coalesce(string_agg(digest, '') OVER (PARTITION BY key, rank // 16 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        coalesce(string_agg(digest, '') OVER (PARTITION BY key, rank // 16 ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t} WHERE n > {least}"""
    up = "SELECT key, max(n) AS n, rank // 16 AS rank, CASE WHEN max(n) > {least} THEN sha256(string_agg(digest, '' ORDER BY rank)) ELSE min(digest) END AS digest FROM {t} GROUP BY key, rank // 16"
    for t in ("d", "s"):
        if t == "s":
            parts.append(f"s0 AS (SELECT '' AS key, count(*) OVER () AS n, row_number() OVER (ORDER BY key) - 1 AS rank, digest, key AS held FROM d{levels})")
        for k in range(levels):
            parts += [f"{t}b{k} AS ({beside.format(t=f'{t}{k}', least=16 ** k)})", f"{t}{k + 1} AS ({up.format(t=f'{t}{k}', least=16 ** k)})"]
    steps = [f"{t}b{k}" for t in "ds" for k in range(levels)]
    joins = " ".join([f"LEFT JOIN db{k} ON db{k}.key = numbered.key AND db{k}.rank = numbered.rank // {16 ** k}" for k in range(levels)]
                     + ["JOIN s0 ON s0.held = numbered.key"] + [f"LEFT JOIN sb{k} ON sb{k}.rank = s0.rank // {16 ** k}" for k in range(levels)])
    parts.append("ways AS (SELECT numbered.doc_id, numbered.digest AS leaf, s0.digest AS subroot, coalesce(numbered.after, numbered.digest) AS f0, "
                 + ", ".join(f"{s}.l AS l{i}, {s}.r AS r{i}" for i, s in enumerate(steps)) + f" FROM numbered {joins})")
    for i in range(len(steps)):
        source = "ways" if i == 0 else f"fold{i - 1}"
        parts.append(f"fold{i} AS (SELECT *, CASE WHEN l{i} IS NULL THEN f{i} ELSE sha256(l{i} || f{i} || r{i}) END AS f{i + 1} FROM {source})")
    last = len(steps) - 1
    proof = " || ".join(f"coalesce(l{i} || r{i}, '')" for i in range(len(steps)))
    return (f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, s{levels}.digest AS root, sha256({proof}) AS proof_sha256, f{last + 1} AS folded_root, "
            f"f{last + 1} = s{levels}.digest AS verified FROM fold{last}, s{levels}")


ORACLE_SQL = {"op11_merkle_manifest": _sql()}
