"""Operator 13, byte-level BPE: encoding with a segment tree over adjacent pair ranks, and decoding.

A text is cut into pieces as the tokenizer's file says (added tokens first, then
its byte-level pattern). For a piece of n bytes, the leaves of a segment tree hold
the merge rank of each adjacent pair together with its position; a node holds the
smaller of its children, so the root names the leftmost pair of the lowest rank.
A merge changes three leaves (the pair itself, the pair on either side) and the
nodes above them; it ends when the root holds no rank. A piece of n bytes takes
O(n log n), whatever it is, so a text without spaces costs no more than another.
The trees of many short pieces are rows of one array and take their steps
together (``merge_many``); a long piece has a tree of its own (``merge``).

A word with the space before it has the same ids wherever it stands. A worker
keeps the ids of the short stretches it met last, at most twice ``HELD``, and
encodes the others of about a million characters at a time; texts are cut at
stretches, so memory depends on that number and on a text's ids.

Defined results: a null text counts as empty; an empty text has no ids and decodes
to the empty text; bytes that are not whole characters decode to U+FFFD; every
row gives a row, repeated ones too; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import picked, table
from .token_records import default_tokenizer

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # fixed: the byte-level cut
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # fixed: Unicode's White_Space
STRETCH = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")  # whole pieces: a word with the space before it, or white space
SURE_START = re.compile(f"(?<=[^{SPACE}]) ")
GROUP_CHARS = 1_000_000
HELD = 1 << 17
SHORT = 64


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class PairTree:
    """A minimum tree over leaves 0..n-1; ``none`` stands for a leaf without value."""

    def __init__(self, leaves: list[int], none: int):
        self.size = size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.nodes = nodes = [none] * size + leaves + [none] * (size - len(leaves))
        for i in range(size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b

    def root(self) -> int:
        return self.nodes[1]

    def put(self, leaf: int, value: int) -> None:
        nodes, i = self.nodes, leaf + self.size
        nodes[i] = value
        while i > 1:
            other = nodes[i ^ 1]
            least = value if value < other else other
            i >>= 1
            if nodes[i] == least:
                return
            nodes[i] = value = least


class SegmentTreeBpe:
    """Ids of texts and texts of ids by a byte-level tokenizer's file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, back = spec["model"], spec["pre_tokenizer"] or {}, spec["decoder"] or {}
        plain = {"unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout", "byte_fallback", "ignore_merges"}
        if (model["type"] != "BPE" or any(model.get(k) for k in plain) or spec["normalizer"] or cut.get("type") != "ByteLevel"
                or cut.get("add_prefix_space") or not cut.get("use_regex", True) or back.get("type") != "ByteLevel"):
            raise ValueError(f"{path}: not a byte-level BPE without normalizer, prefix space or fallback")
        ids = model["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [ids[c] for c in letters]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank_of = {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        added = {t["content"]: t for t in spec.get("added_tokens", [])}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added.values()):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        self.added = {c: t["id"] for c, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.added_cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        size = max([*ids.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in {**ids, **self.added}.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        keys = np.array([(a << 32) + b for a, b in self.rank_of], np.int64)
        order = np.argsort(keys)
        self.pairs, self.pair_ranks = keys[order], order
        self.first_ids, self.merged_ids = np.array(self.first, np.int64), np.array(self.merged, np.int64)
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was held before

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank_of, merged = self.rank_of, self.merged
        none = len(merged) * n  # a leaf is rank * n + position, so the smallest is the leftmost of the lowest rank
        tree = PairTree([r * n + i if (r := rank_of.get((ids[i], ids[i + 1]))) is not None else none for i in range(n - 1)], none)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree.root()) < none:
            rank, i = divmod(least, n)
            j = after[i]
            ids[i], ids[j] = merged[rank], -1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, none)
            if k < n:
                before[k] = i
                r = rank_of.get((ids[i], ids[k]))
                tree.put(i, none if r is None else r * n + i)
            else:
                tree.put(i, none)
            p = before[i]
            if p >= 0:
                r = rank_of.get((ids[p], ids[i]))
                tree.put(p, none if r is None else r * n + p)
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (uint32) of each piece: short ones together by the size of their trees."""
        out: list[bytes] = [b""] * len(pieces)
        of_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if len(piece) > SHORT:
                out[k] = np.array(self.merge(piece), np.uint32).tobytes()
            else:
                of_size.setdefault(1 << max(0, (len(piece) - 2).bit_length()), []).append(k)
        for size, some in of_size.items():
            flat, n = self._merge_together([pieces[k] for k in some], size)
            data, ends = flat.astype(np.uint32).tobytes(), (4 * np.cumsum(n)).tolist()
            for k, a, b in zip(some, [0, *ends], ends):
                out[k] = data[a:b]
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; the number of merges where there is none."""
        pair = (a << 32) + b
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], len(self.merged))

    def _merge_together(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of up to ``size`` + 1 bytes one after another, and how many each has.

        Symbols lie in columns 1 to n between columns of -1; the pair of columns s
        and s + 1 is leaf s - 1, at column size + s - 1 of the piece's tree.
        """
        rows, width, none = len(pieces), size + 3, len(self.merged) * size
        n = np.array([len(p) for p in pieces])
        ids = np.full((rows, width), -1, np.int64)
        column = np.arange(width)
        ids[(column >= 1) & (column <= n[:, None])] = self.first_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        tree = np.full((rows, 2 * size), none, np.int64)
        place = np.arange(size)
        rank = self._ranks(ids[:, 1:size + 1].ravel(), ids[:, 2:size + 2].ravel()).reshape(rows, size)
        tree[:, size:] = np.where(rank < len(self.merged), rank * size + place, none)
        half = size // 2
        while half:
            tree[:, half:2 * half] = np.minimum(tree[:, 2 * half:4 * half:2], tree[:, 2 * half + 1:4 * half:2])
            half //= 2
        after, before = np.tile(column + 1, (rows, 1)), np.tile(column - 1, (rows, 1))
        flat_ids, flat_after, flat_before, flat_tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        active = np.arange(rows)
        while True:
            root = tree[active, 1]
            going = root < none
            active, root = active[going], root[going]
            if not len(active):
                break
            least, i = root // size, root % size + 1
            line, last, top = active * width, n[active], active * (2 * size)
            j = flat_after[line + i]
            k = flat_after[line + j]
            merged = self.merged_ids[least]
            flat_ids[line + i], flat_ids[line + j] = merged, -1
            flat_after[line + i], flat_before[line + k] = k, i
            p = flat_before[line + i]
            rank = self._ranks(merged, flat_ids[line + k])
            right = np.where(rank < len(self.merged), rank * size + i - 1, none)
            rank = self._ranks(flat_ids[line + p], merged)
            left = np.where(rank < len(self.merged), rank * size + p - 1, none)
            # Where there is no pair on a side, the merged pair's own leaf is put again.
            for leaf, value in ((i, right), (np.where(j < last, j, i), np.where(j < last, none, right)), (np.where(p > 0, p, i), np.where(p > 0, left, right))):
                flat_tree[top + size + leaf - 1] = value
            for leaf in (i, np.where(j < last, j, i), np.where(p > 0, p, i)):
                node = (size + leaf - 1) >> 1
                for _ in range(size.bit_length() - 1):
                    two = top + 2 * node
                    flat_tree[top + node] = np.minimum(flat_tree[two], flat_tree[two + 1])
                    node >>= 1
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def _resolve(self, stretches: set[str]) -> dict[str, bytes]:
        """Sees to it that all these stretches are held; returns those that are too long to be."""
        wanted = []
        for s in stretches:
            if s not in self.held:
                ids = self.older.get(s)
                if ids is None:
                    wanted.append(s)
                else:
                    self.held[s] = ids
        pieces = [PATTERN.findall(s) for s in wanted]
        distinct = list({p for some in pieces for p in some})
        ids_of = dict(zip(distinct, self.merge_many([p.encode() for p in distinct])))
        long = {}
        for s, some in zip(wanted, pieces):
            (self.held if len(s) <= SHORT else long)[s] = b"".join([ids_of[p] for p in some])
        return long

    def _cut(self, text: str) -> Iterator[str | int]:
        """The text in parts of at most about a group's characters; an added token as its id."""
        for k, part in enumerate([text] if self.added_cut is None else self.added_cut.split(text)):
            if k % 2:
                yield self.added[part]
                continue
            at = 0
            while at < len(part):
                end = len(part)
                if at + GROUP_CHARS < end and (start := SURE_START.search(part, at + GROUP_CHARS)):
                    end = start.start()
                yield part[at:end]
                at = end

    def encode_many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each whole text; an added token's string is that token."""
        group: list[tuple[bool, list[str] | bytes]] = []  # (ends a text, stretches or ids)
        chars, done = 0, []

        def flush() -> Iterator[np.ndarray]:
            long = self._resolve({s for _, part in group if isinstance(part, list) for s in part})
            get = self.held.get
            for ends, part in group:
                done.append(b"".join([get(s) or long[s] for s in part]) if isinstance(part, list) else part)
                if ends:
                    yield np.frombuffer(b"".join(done), np.uint32)
                    done.clear()
            if len(self.held) > HELD:
                self.older, self.held = self.held, {}

        for text in texts:
            for part in self._cut(text):
                if isinstance(part, int):
                    group.append((False, np.uint32(part).tobytes()))
                else:
                    group.append((False, STRETCH.findall(part)))
                    chars += len(part)
                if chars >= GROUP_CHARS:
                    yield from flush()
                    group, chars = [], 0
            group.append((True, b""))
        yield from flush()

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_many([text]))

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids, those of added tokens too."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def bpe_of(path: str) -> SegmentTreeBpe:
    return SegmentTreeBpe(path)


def _encode(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bpe = bpe_of(path)
            found = list(bpe.encode_many(t.as_py() or "" for t in part.column("text")))
            ends = np.cumsum([0, *map(len, found)], dtype=np.int64)
            flat = np.concatenate([np.empty(0, np.uint32), *found]).astype(np.int32)
            ids = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bpe = bpe_of(path)
            ids = part.column("ids")
            flat, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            texts = pa.array([bpe.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, texts], ["doc_id", "ids", "text"])

    return run


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text)."""
    return picked(docs, doc_id="long", text="string").mapInArrow(_encode(tokenizer), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) of every row of (doc_id, ids)."""
    return picked(rows, doc_id="long", ids="array<int>").mapInArrow(_decode(tokenizer), "doc_id long, ids array<int>, text string")


def op13_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text of ``documents`` and the text they decode to, as digests."""
    tokenizer = default_tokenizer()
    rows = decoded(encoded(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


#: Merges are beyond SQL; the tests hold ids and texts against the library's own on whole texts.
ORACLE_SQL: dict[str, str] = {}
