"""Operator 9, n-gram Jaccard join: signatures of PartEnum's partitions.

Documents whose sets of five-word shingles have a Jaccard similarity of at least
0.8 are linked; every link between different sets counts, none is missed.

**Signatures** (after PartEnum, Arasu, Ganti and Kaushik, 2006, without its second
level: the subsets enumerated are those of one part). Set sizes are cut into
bands whose ends differ by the factor 1/0.8, so a linked pair lies in one band
or in two neighbouring ones. For a pair whose smaller set lies in a band ending
at ``r``, at most ``k = r // 4`` shingles are in one set only. The shingle domain
is partitioned into ``n1 = k + 1 + e`` parts by hash; such a pair differs in at
most ``k`` parts, so it agrees in at least ``e + 1`` of them, and each non-empty
part of a set is one signature. As parts can be empty, ``e`` leaves room for the
empty parts that are to be expected; a set with more of them also signs under
further partitionings, and under one common key at last, so that no link is
lost. Signatures travel in packed blocks, one row per text chunk and reducer.

**Candidates.** Sets with a signature in common form buckets. In a bucket of a
few sets (``SMALL``) all pairs are candidates. Larger buckets are put together
in groups around the set that has most company. A group of bounded size (up to
``GROUP_SETS`` sets and ``GROUP_SHINGLES`` shingles, each set shipped once) is
settled in one task: sets close to the group's core, the shingles that most of
the group hold, are linked for certain through the closest one, and only the
others are held against the rest, so that a group gives at most one link per
set. A group beyond the bound is divided first: two sets differ exactly where
their differences from the core differ, so linked sets which are not both close
to the core share an element in short prefixes of the two differences (in one
order, shingles outside the core first). These shared elements are the buckets
of the next round; they hold about half of a group at most, as an element in
more sets belongs to the core. After ``MERGED_ROUNDS`` rounds each bucket is a
group of its own, so that groups shrink to the end. A round is linear in its
bucket rows, and a passage that many documents share vanishes from the
differences. The core of a divided group comes from a small sample, which steers
only the work, never the result.

**Verification** compares whole sets of 64-bit shingle hashes, with the members
of large groups dealt over several tasks. Pairs go without their texts first: a
sketch of ``CELLS`` element counts bounds the difference of two sets from below,
and only pairs that it allows are fetched. Equal sets are one node from the
start, so exact copies never meet.

Defined results: a null or empty text, or one without words, has no shingles and
is linked with nothing; a text of one to four words is one shingle; repeated
rows each get a row; a null doc_id takes part, but does not name a component
(a component of null ids only has a null id). Extra columns are ignored by
:func:`link_components` and kept by :func:`one_per_component`. Nodes are 64-bit
set digests: among n distinct sets, n**2 / 2**65 pairs of different sets are
expected to share one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, picked, table, written
from .components import components
from .textbatch import TextBatch, as_large, chunks, mix64, shingle_sets

SMALL = (8, 64)  # largest bucket whose pairs are all compared: in the first round, and in later ones
SEEDS = 4
HUB_ROWS = 256
SHINGLES_PER_PART = 3_000_000
SAMPLE = 64
MERGED_ROUNDS = 1
CELLS = 128
GROUP_SETS, GROUP_SHINGLES = 4096, 3_000_000  # a group of up to so many is settled in one task


def _bands(largest: int) -> list[int]:
    """Ends of the size bands; sets below 4 shingles link only with equal sets."""
    ends = [3]
    while ends[-1] < largest:
        ends.append((ends[-1] + 1) * 5 // 4)
    return ends


BAND_ENDS = np.array(_bands(1 << 40), np.int64)


def _scheme(band: int) -> tuple[int, int]:
    """(parts, empty parts allowed) for pairs whose smaller set lies in ``band``."""
    low, k = int(BAND_ENDS[band - 1]) + 1, int(BAND_ENDS[band]) // 4
    room = 0
    while True:
        parts = k + 1 + room
        load = low / parts
        empty = parts * math.exp(-load)
        spread = empty * (1 - (1 + load) * math.exp(-load))
        if empty + 2 * math.sqrt(max(spread, 0.0)) <= room:
            return parts, room
        room += 1 + room // 16


_SCHEMES: dict[int, tuple[int, int]] = {}


def _schemes(bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds, inverse = np.unique(bands, return_inverse=True)
    for b in kinds:
        if int(b) not in _SCHEMES:
            _SCHEMES[int(b)] = _scheme(int(b))
    both = np.array([_SCHEMES[int(b)] for b in kinds], np.int64).reshape(-1, 2)[inverse]
    return both[:, 0], both[:, 1]


def signatures(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature keys of many sets: (key, set index). ``h`` holds the sets' hashes one after another."""
    own = np.searchsorted(BAND_ENDS, sizes)
    keys, sets = [], []
    for shift in (0, 1):
        band = own - shift
        at = np.flatnonzero((own > 0) & (band > 0) & ((shift == 0) | (4 * sizes <= 5 * BAND_ENDS[np.maximum(band, 0)])))
        seed = 0
        while len(at):
            parts, room = _schemes(band[at])
            if seed == SEEDS:
                keys.append(mix64(band[at].astype(np.uint64) ^ np.uint64(0xABCDEF0123456789)))
                sets.append(at)
                break
            rows = _rows_of(at, sizes)
            x = mix64(h[rows] ^ np.uint64(0x5851F42D4C957F2D * (seed + 1) & 0xFFFFFFFFFFFFFFFF))
            of = np.repeat(np.arange(len(at)), sizes[at])
            base = np.concatenate(([0], np.cumsum(parts)))
            cell = base[of] + (((x >> np.uint64(32)) * parts[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            total = int(base[-1])
            low = np.bincount(cell, (x & np.uint64(0xFFFFFFFF)).astype(np.float64), total)
            high = np.bincount(cell, (x >> np.uint64(32)).astype(np.float64), total)
            full = np.flatnonzero(high + low > 0)
            owner = np.repeat(np.arange(len(at)), parts)[full]
            place = (full - base[owner]).astype(np.uint64)
            key = mix64(low[full].astype(np.uint64) ^ (high[full].astype(np.uint64) << np.uint64(20)))
            keys.append(mix64(key ^ (place * np.uint64(8191) + band[at][owner].astype(np.uint64) * np.uint64(0x1000003) + np.uint64(seed))))
            sets.append(at[owner])
            empty = parts - np.bincount(owner, minlength=len(at))
            at = at[empty > room]
            seed += 1
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(sets)


def _rows_of(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    start = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    n = sizes[sets]
    return np.repeat(start[sets] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(int(n.sum()))


def _digests(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit number per set (0 for an empty one): an order-free hash of its elements."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = mix64(np.add.reduceat(mix64(h), np.cumsum(sizes[full]) - sizes[full]) + sizes[full].astype(np.uint64))
    return out


def _sets(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for part in parts:
        texts = as_large(part.column("text"))
        for lo, hi in chunks(texts):
            doc, h = shingle_sets(TextBatch(texts, lo, hi))
            sizes = np.bincount(doc, minlength=hi - lo)
            yield part.slice(lo, hi - lo), h, sizes, _digests(h, sizes)


def _nodes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, sizes, digests in _sets(parts):
        node = pa.array(digests.view(np.int64), mask=sizes == 0)
        yield pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in ("doc_id", "rid", "text_key")), pa.array(sizes), node], ["doc_id", "rid", "text_key", "n_shingles", "node"])


def _blocks(n_parts: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, h, sizes, digests in _sets(parts):
            _, once = np.unique(digests, return_index=True)  # equal sets of the chunk sign once
            if len(once) < len(sizes):
                once.sort()
                h = h[_rows_of(once, sizes)]
                sizes, digests = sizes[once], digests[once]
            key, owner = signatures(h, sizes)
            part = ((key >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)
            order = np.argsort(part.astype(np.uint32), kind="stable")
            key, node, part = key[order], digests[owner[order]], part[order]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
            ends = np.r_[cut[1:], len(part)]
            if len(cut):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut].astype(np.int32)), pa.array([key[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                     pa.array([node[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], ["part", "keys", "nodes"])

    return run


def _buckets(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by part; one part at a time is held."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    at = None

    def out() -> Iterator[pa.RecordBatch]:
        key = np.concatenate([k for k, _ in held])
        node = np.concatenate([n for _, n in held])
        held.clear()
        order = np.argsort(key)
        key, node = key[order], node[order]
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        multi = same.copy()
        multi[:-1] |= same[1:]
        key, node = key[multi], node[multi]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][:len(key)]
        key, node = key[new], node[new]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:len(key)])
        n = np.diff(np.r_[first, len(key)])
        size = np.repeat(n, n)
        keep = size > 1
        if keep.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (key[keep].view(np.int64), node[keep].view(np.int64), size[keep])], ["key", "node", "size"])

    for block in blocks:
        for part, keys, nodes in zip(block.column("part").to_pylist(), block.column("keys"), block.column("nodes")):
            if held and part != at:
                yield from out()
            at = part
            held.append((np.frombuffer(keys.as_buffer(), np.uint64), np.frombuffer(nodes.as_buffer(), np.uint64)))
    if held:
        yield from out()


def _sketches(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Elements of each set by hash cell, cut at 255. Two sets differ in at least the sum of the cells' differences."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    cell = of * CELLS + (h >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=len(sizes) * CELLS), 255).astype(np.uint8).reshape(len(sizes), CELLS)


def _with_sketches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, text, n, sketch); a row whose text is not the node's goes (a doc_id that several texts have)."""
    for rows, h, sizes, digests in _sets(parts):
        sketch = _sketches(h, sizes)
        out = pa.RecordBatch.from_arrays(
            [rows.column("node"), rows.column("text"), pa.array(sizes), pa.array([x.tobytes() for x in sketch], pa.binary())], ["node", "text", "n", "sketch"])
        yield out.filter(pa.array(digests.view(np.int64) == rows.column("node").to_numpy(zero_copy_only=False)))


def _may_link(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a similarity of 0.8."""
    for part in parts:
        x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, CELLS).astype(np.int16) for c in ("x", "y"))
        apart = np.abs(x - y).sum(axis=1)
        total = part.column("nx").to_numpy() + part.column("ny").to_numpy()
        yield part.filter(pa.array(9 * apart <= total)).select(["node", "hub"])


def _settle(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (positions) that connect all sets which are connected by links; at most one per set.

    Sets near the core are linked for certain (see :func:`_refine`); any other
    set is held against all sets that are not connected with it yet, by sketch
    first and then as a whole.
    """
    a = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    elements, n = np.unique(flat, return_counts=True)
    core = elements[2 * n > len(sets)]
    inside = core[np.minimum(np.searchsorted(core, flat), len(core) - 1)] == flat if len(core) else np.zeros(len(flat), bool)
    slack = a - 9 * (a + len(core) - 2 * np.bincount(np.repeat(np.arange(len(a)), a), inside, len(a)).astype(np.int64))
    centre = int(np.argmax(slack))
    near = np.flatnonzero(slack + slack[centre] >= 0)
    links = [(int(i), centre) for i in near if i != centre]
    root = np.arange(len(a))
    root[near] = centre
    sketch = _sketches(flat, a).astype(np.int16)
    for i in np.setdiff1d(np.arange(len(a)), near):
        apart = np.abs(sketch - sketch[i]).sum(axis=1)
        for j in np.flatnonzero((9 * apart <= a + a[i]) & (root != root[i])):
            if root[i] == root[j]:
                continue
            x, y = sets[i], sets[j]
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * both >= 80 * (len(x) + len(y) - both):
                links.append((int(i), int(j)))
                root[root == root[i]] = root[j]
    return links


def _settled(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (label, node); one group of bounded size is held at a time."""
    at, nodes, held = None, [], []

    def out() -> pa.RecordBatch:
        links = _settle(held) if len(held) > 1 else []
        rows = pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], ["a", "b"])
        nodes.clear()
        held.clear()
        return rows

    for part in parts:
        texts = as_large(part.column("text"))
        for lo, hi in chunks(texts):
            doc, h = shingle_sets(TextBatch(texts, lo, hi))
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            rows = part.slice(lo, hi - lo).select(["label", "node"]).to_pydict()
            for i, (label, node) in enumerate(zip(rows["label"], rows["node"])):
                if held and label != at:
                    yield out()
                if not nodes or node != nodes[-1]:
                    nodes.append(node)
                    held.append(h[ends[i]:ends[i + 1]].copy())
                at = label
    if held:
        yield out()


def _compare(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (hub, salt), the hub's own row first; one result per member."""
    hub, hub_set = None, np.empty(0, np.uint64)
    for part in parts:
        texts = as_large(part.column("text"))
        for lo, hi in chunks(texts):
            doc, h = shingle_sets(TextBatch(texts, lo, hi))
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            rows = part.slice(lo, hi - lo).select(["hub", "node"]).to_pydict()
            out: list[tuple] = []
            for i, (own, node) in enumerate(zip(rows["hub"], rows["node"])):
                x = h[ends[i]:ends[i + 1]]
                if node is None:
                    hub, hub_set = own, x.copy()
                    continue
                assert own == hub, "a member came before its hub"
                both = int((hub_set[np.minimum(np.searchsorted(hub_set, x), len(hub_set) - 1)] == x).sum())
                out.append((node, own, 100 * both >= 80 * (len(x) + len(hub_set) - both)))
            if out:
                node, own, linked = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(own, pa.int64()), pa.array(linked)], ["node", "hub", "linked"])


def _cores(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that more than half of a group's sampled sets hold. Rows arrive sorted by group."""
    at, held = None, []

    def out() -> pa.RecordBatch:
        x, n = np.unique(np.concatenate(held), return_counts=True)
        core = x[2 * n > len(held)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([core.tobytes()], pa.binary())], ["label", "core"])

    for part in parts:
        texts = as_large(part.column("text"))
        for lo, hi in chunks(texts):
            doc, h = shingle_sets(TextBatch(texts, lo, hi))
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            for i, label in enumerate(part.column("label").slice(lo, hi - lo).to_pylist()):
                if held and label != at:
                    yield out()
                at = label
                held.append(h[ends[i]:ends[i + 1]].copy())
    if held:
        yield out()


def _residuals(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each member's difference from its group's core: its size, and a prefix of it (what the core lacks first)."""
    kind = pa.schema([("label", pa.int64()), ("node", pa.int64()), ("a", pa.int64()), ("h", pa.int64()), ("elements", pa.list_(pa.int64()))])
    core, of = np.empty(0, np.uint64), None
    for part in parts:
        texts = as_large(part.column("text"))
        for lo, hi in chunks(texts):
            doc, h = shingle_sets(TextBatch(texts, lo, hi))
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            rows = part.slice(lo, hi - lo).select(["label", "node", "core"]).to_pydict()
            out: list[tuple] = []
            for i, (label, node, found) in enumerate(zip(rows["label"], rows["node"], rows["core"])):
                if node is None:
                    core, of = np.frombuffer(found, np.uint64), label
                    continue
                assert label == of, "a member came before its core"
                x = h[ends[i]:ends[i + 1]]
                more, less = np.setdiff1d(x, core, assume_unique=True), np.setdiff1d(core, x, assume_unique=True)
                n = len(more) + len(less)
                ordered = np.concatenate([more[np.argsort(mix64(more))], less[np.argsort(mix64(less))]])
                out.append((label, node, len(x), n, ordered[:min(n, len(x) // 4 + 1)].view(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kind.types)], schema=kind)


def _dealt(members: DataFrame, sets: DataFrame, heads: DataFrame, by: str) -> DataFrame:
    """Members' texts behind the head row of their group; members of a large group are dealt over several tasks."""
    n = members.groupBy(by).agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts"))
    n = written(n, "group-sizes")
    rows = members.join(n, by).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    rows = rows.join(sets, "node").select(by, "salt", "node", "text", F.lit(None).cast("binary").alias("core"))
    own = heads.join(n, by).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    own = own.select(by, "salt", F.lit(None).cast("long").alias("node"), "text", "core")
    return rows.union(own).repartition(by, "salt").sortWithinPartitions(by, "salt", F.col("node").asc_nulls_first())


def _small_pairs(members: DataFrame, small: int) -> DataFrame:
    """Distinct (node, hub) to compare in buckets of up to ``small`` sets.

    Two near sets need no comparison (both are linked to one set already), nor
    two far ones of which one holds the element beyond its short prefix.
    """
    grouped = members.where(F.col("size") <= small).groupBy("key").agg(F.collect_list(F.struct("node", "near", "short")).alias("m"))
    each = grouped.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    needed = (F.col("x.node") < F.col("y.node")) & ~(F.col("x.near") & F.col("y.near")) & (
        F.col("x.near") | F.col("y.near") | (F.col("x.short") & F.col("y.short")))
    return each.where(needed).select(F.col("x.node").alias("node"), F.col("y.node").alias("hub")).distinct()


def _large_groups(members: DataFrame, small: int, merge: bool) -> DataFrame:
    """(label, node): the sets of large buckets. With ``merge``, buckets are put together when one set has most company in each of them."""
    large = members.where(F.col("size") > small)
    if not merge:
        return large.select(F.col("key").alias("label"), "node").distinct()
    weights = large.groupBy("node").agg(F.sum("size").alias("weight"))
    large = large.join(weights, "node").withColumn("salts", F.ceil(F.col("size") / 4096).cast("int"))
    hubs = large.groupBy("key", "salts").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    dealt = large.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    return dealt.join(hubs, ["key", "salt"]).select(F.col("hub").alias("label"), "node").distinct()


def _refine(groups: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certain links (a, b) in the groups, and the buckets in which all others are found.

    Let h be the size of a set's difference from the core and a the set's size.
    Two sets differ in at most h + h' shingles, so they are linked for certain
    when 9 (h + h') <= a + a'. The set with the largest a - 9 h of a group links
    so with all sets that are near. Any other linked pair has a far set, and its
    differences share (h + h' - (a + a') / 9) / 2 elements or more, one at least.
    """
    n = groups.groupBy("label").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 20)) < F.lit(SAMPLE << 20) / F.col("n")
    sample = groups.join(n, "label").where(draw).select("label", "node").join(sets, "node").select("label", "text")
    found = sample.repartition("label").sortWithinPartitions("label").mapInArrow(_cores, "label long, core binary")
    heads = groups.select("label").distinct().join(written(found, "cores"), "label", "left").select(
        "label", F.lit(None).cast("string").alias("text"), F.coalesce("core", F.lit(b"")).alias("core"))
    rest = _dealt(groups, sets, heads, "label").mapInArrow(_residuals, "label long, node long, a long, h long, elements array<long>")
    rest = written(rest.withColumn("slack", F.col("a") - 9 * F.col("h")), "residuals")

    best = rest.groupBy("label").agg(F.max(F.struct("slack", "node")).alias("best"), F.min("slack").alias("worst"))
    best = written(best.select("label", F.col("best.slack").alias("top"), F.col("best.node").alias("centre"), "worst"), "centres")
    rest = rest.join(best, "label").withColumn("near", F.col("slack") + F.col("top") >= 0)
    links = rest.where("near AND node != centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))

    short = F.floor((9 * F.col("h") + F.col("a") - F.col("top")) / 18) + 1
    rows = rest.where("worst + top < 0").withColumn("n_short", short).select(
        "label", "node", "near", "n_short", F.posexplode("elements").alias("pos", "element"))
    rows = rows.select(F.xxhash64("label", "element").alias("key"), "node", "near", (F.col("pos") < F.col("n_short")).alias("short"))
    rows = rows.where("short OR NOT near")
    totals = rows.groupBy("key").agg(F.count("*").alias("size"), F.expr("bool_or(short)").alias("any_short"), F.expr("bool_and(near)").alias("all_near"))
    useful = written(totals.where("size > 1 AND any_short AND NOT all_near").select("key", "size"), "useful")
    return links, written(rows.join(useful, "key"), "buckets")


def _linked(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, n_shingles, part (its component's node, null without shingles)."""
    spark = docs.sparkSession
    rows = picked(docs, doc_id="long", text="string")
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("rid", F.coalesce("doc_id", "text_key"))
    nodes = written(rows.mapInArrow(_nodes, "doc_id long, rid long, text_key long, n_shingles long, node long"), "nodes")
    total = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHINGLES_PER_PART))

    blocks = rows.mapInArrow(_blocks(n_parts), "part int, keys binary, nodes binary")
    members = blocks.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(_buckets, "key long, node long, size long")
    members = members.select("key", "node", F.lit(False).alias("near"), F.lit(True).alias("short"), "size")
    members = written(members, "buckets")

    ids = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("rid", "text_key")).alias("at")).select("node", "at.*")
    wanted = ids.join(members.select("node").distinct(), "node", "left_semi")
    # The wanted rows have no bound, so they are never broadcast, at any size.
    sets = rows.select("rid", "text_key", "text").join(written(wanted, "wanted").hint("merge"), ["rid", "text_key"])
    sets = sets.dropDuplicates(["rid", "text_key", "node"]).select("node", "text")  # repeated rows are one set; where they are, without a shuffle
    sets = written(sets.mapInArrow(_with_sketches, "node long, text string, n long, sketch binary"), "sets")

    links, round_no = [], 0
    sketches, texts = sets.select("node", "n", "sketch"), sets.select("node", "text")
    while not members.isEmpty():
        small = SMALL[min(round_no, 1)]
        pairs = _small_pairs(members, small)
        pairs = pairs.join(sketches.select("node", F.col("n").alias("nx"), F.col("sketch").alias("x")), "node")
        pairs = pairs.join(sketches.select(F.col("node").alias("hub"), F.col("n").alias("ny"), F.col("sketch").alias("y")), "hub")
        pairs = pairs.where("5 * nx >= 4 * ny AND 5 * ny >= 4 * nx").select("node", "hub", "nx", "ny", "x", "y")
        pairs = written(pairs.mapInArrow(_may_link, "node long, hub long"), "pairs")
        heads = pairs.select("hub").distinct().join(texts.withColumnRenamed("node", "hub"), "hub").withColumn("core", F.lit(None).cast("binary"))
        compared = _dealt(pairs, texts, heads, "hub").mapInArrow(_compare, "node long, hub long, linked boolean")
        links.append(written(compared.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b")), "links"))

        groups = _large_groups(members, small, merge=round_no < MERGED_ROUNDS).join(sketches.select("node", "n"), "node")
        groups = written(groups, "groups")
        sizes = groups.groupBy("label").agg(F.count("*").alias("n_sets"), F.sum("n").alias("n_shingles"))
        sizes = written(sizes.withColumn("fits", (F.col("n_sets") <= GROUP_SETS) & (F.col("n_shingles") <= GROUP_SHINGLES)).select("label", "fits"), "sizes")
        groups = groups.join(sizes, "label")
        settled = groups.where("fits").select("label", "node").join(texts, "node").repartition("label").sortWithinPartitions("label", "node")
        links.append(written(settled.mapInArrow(_settled, "a long, b long"), "links"))
        wide = written(groups.where("NOT fits").select("label", "node"), "wide-groups")
        if wide.isEmpty():
            break
        certain, members = _refine(wide, texts)
        links.append(certain)
        round_no += 1

    named = nodes.withColumn("part", F.col("node"))
    if links:
        roots = written(components(reduce(DataFrame.union, links)), "roots")
        named = nodes.join(roots, "node", "left").withColumn("part", F.coalesce("root", "node"))
    return named.select("doc_id", "text_key", "n_shingles", "part")


def link_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    named = _linked(docs)
    least = written(named.where("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("least")), "least")
    return named.join(least, "part", "left").select(
        "doc_id", "n_shingles", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that of the smallest doc_id.

    Rows without a doc_id come last, and rows of equal doc_id go by a hash of the
    text. Texts without words are linked with nothing, so each of their rows stays.
    """
    first = _linked(docs).where("part IS NOT NULL").groupBy("part").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first"))
    first = written(first.select(F.col("first.doc_id").alias("__id"), F.col("first.text_key").alias("__text")), "first")
    first = first.withColumn("__key", F.xxhash64("__id", "__text"))
    row = F.col("row")  # the original row as one struct, whatever its columns are named
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", row["doc_id"].cast("long").alias("row_id"), F.xxhash64(row["text"].cast("string")).alias("row_text"),
        F.coalesce(row["text"].cast("string").rlike(WORD_PATTERN), F.lit(False)).alias("words"))
    found = rows.where("words").withColumn("__key", F.xxhash64("row_id", "row_text")).join(first, "__key")
    found = found.where(F.col("row_id").eqNullSafe(F.col("__id")) & (F.col("row_text") == F.col("__text")))
    # Repeated rows with one doc_id and text pass the join together; one of them stays.
    found = found.withColumn("__copy", F.row_number().over(Window.partitionBy("__key").orderBy("__key"))).where("__copy = 1")
    return found.select("row").union(rows.where("NOT words").select("row")).select("row.*")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of five-word-shingle links at 0.8 over all of ``documents``."""
    return link_components(table(spark, sf_dir, "documents"))


#: Shingle sets of whole texts are beyond SQL's means at this size; the tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {}
