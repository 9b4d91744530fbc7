"""Operator 4, SentencePiece encoding and decoding: seeded merge-dropout.

Texts are encoded with a merge-type (BPE) SentencePiece vocabulary. The agenda
always takes the best-scored adjacent pair of a text, the leftmost of equals;
but each candidate merge, known by its place in the text and the piece that it
would make, is skipped for good when a hash keyed by seed, document and
candidate falls below the dropout rate. The same seed gives the same pieces on
any cluster, another seed other ones, and rate 0 the library's own encoding
(tested). Every segmentation decodes to the same text: spaces are the mark
U+2581, one mark is put before a text, and a character without a piece, the
mark itself included, is spelled in byte pieces.

No piece of such a vocabulary holds the mark behind another character, so merges
never cross the beginning of a word, nor a character without a piece. The
stretches between are independent agendas; those of similar length run side by
side in numpy, one merge of each per step, and long ones on a heap.

Defined results: a null or empty text has no pieces and decodes to the empty
text; a null doc_id is keyed as 0; repeated rows get equal pieces; a text
without spaces is one agenda of any length; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import picked, table
from .textbatch import TextBatch, as_large, chunks, mix64

RATE = 0.1
SEED = 17
MARK = 0x2581
CLASSES = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 40, 64)
NONE = np.int32(2**31 - 1)


class Pieces:
    """Pieces and merges of a merge-type model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.n = size
        plain = {model.id_to_piece(i): i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.byte_id = np.zeros(256, np.int32)
        spelled: list[bytes] = [b""] * size
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_id[value], spelled[i] = i, bytes([value])
        for piece, i in plain.items():
            spelled[i] = piece.replace(chr(MARK), " ").encode()
            if chr(MARK) in piece.lstrip(chr(MARK)):
                raise ValueError(f"piece {piece!r} holds a space behind another character")
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.n_bytes = np.array([len(x) for x in spelled], np.int64)
        self.spelled_at = np.cumsum(self.n_bytes) - self.n_bytes
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in plain.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        self.mark = int(self.of_char[MARK])
        if self.mark < 0:
            raise ValueError("the model has no piece for a space")
        self.of_char[0x20], self.of_char[MARK] = self.mark, -1
        order = sorted(plain.values(), key=lambda i: (-model.get_score(i), i))
        self.rank = np.zeros(size, np.int32)
        self.rank[order] = np.arange(len(order))
        merges = {}
        for piece, i in plain.items():
            for cut in range(1, len(piece)):
                left, right = plain.get(piece[:cut]), plain.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left * size + right] = i
        keys = np.array(list(merges), np.int64)
        self.bits = max(8, int(4 * len(keys)).bit_length())
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        self.table_id = np.zeros(1 << self.bits, np.int32)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):  # open addressing: the first of those that want a free slot gets it
            free = left[self.table_key[at[left]] < 0]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.table_key[at[won]], self.table_id[at[won]] = keys[won], [merges[int(k)] for k in keys[won]]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = left.astype(np.int64) * self.n + right
        at = self._slot(key)
        seen = self.table_key[at]
        out = np.where(seen == key, self.table_id[at], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.table_key[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.table_id[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


def dropped(seed_of_text: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidate that would make ``piece`` at ``place`` is skipped."""
    x = mix64(seed_of_text ^ (place.astype(np.uint64) << np.uint64(20)) ^ piece.astype(np.uint64))
    return (x >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


class Encoder:
    def __init__(self, path: str, rate: float = RATE, seed: int = SEED):
        self.pieces, self.rate, self.seed = Pieces(path), rate, seed

    def _candidates(self, left, right, key, place) -> tuple[np.ndarray, np.ndarray]:
        made = self.pieces.merged(left, right)
        rank = np.where(made >= 0, self.pieces.rank[made], NONE)
        if self.rate > 0:
            some = np.flatnonzero(made >= 0)
            rank[some[dropped(key[some], place[some], made[some], self.rate)]] = NONE
        return rank, made

    def _side_by_side(self, symbols: np.ndarray, first: np.ndarray, n: np.ndarray, key: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """(width, stretches): the pieces of stretches of up to ``width`` symbols, -1 where there is none."""
        m = len(first)
        column = np.arange(width)[:, None]
        inside = column < n
        sym = np.where(inside, symbols[np.minimum(first + column, len(symbols) - 1)], -1).astype(np.int32)
        made = np.full((width, m), -1, np.int32)
        best = np.full((width, m), NONE, np.int32)
        pair = (column + 1 < n)[:-1]
        c, r = np.nonzero(pair)
        rank, piece = self._candidates(sym[c, r], sym[c + 1, r], key[r], place[r] + c)
        best[c, r] = np.where(rank < NONE, rank * np.int32(width) + c.astype(np.int32), NONE)
        made[c, r] = piece
        after = np.where(column + 1 < n, column + 1, width).astype(np.int16)
        before = np.broadcast_to(column - 1, (width, m)).astype(np.int16)
        live = np.arange(m)
        while len(live):
            least = best[:, live].min(axis=0)
            live, least = live[least < NONE], least[least < NONE]
            if not len(live):
                break
            j = least % width
            k = after[j, live]
            nxt = after[k, live]
            sym[j, live] = made[j, live]
            sym[k, live] = -1
            best[k, live] = best[j, live] = NONE
            after[j, live] = nxt
            more = np.flatnonzero(nxt < width)
            before[nxt[more], live[more]] = j[more]
            prev = before[j, live]
            back = np.flatnonzero(prev >= 0)
            left = np.concatenate([j[more], prev[back]])
            right = np.concatenate([nxt[more], j[back]])
            row = np.concatenate([live[more], live[back]])
            if len(row):
                rank, piece = self._candidates(sym[left, row], sym[right, row], key[row], place[row] + left)
                best[left, row] = np.where(rank < NONE, rank * np.int32(width) + left.astype(np.int32), NONE)
                made[left, row] = piece
        return sym

    def _on_a_heap(self, symbols: np.ndarray, key: np.uint64, place: int) -> list[int]:
        """One agenda of any length: a heap of (rank, place) candidates; stale ones are passed over."""
        sym = symbols.tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def candidates(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int, int, int]]:
            a, b = np.array([sym[i] for i in left]), np.array([sym[i] for i in right])
            rank, made = self._candidates(a, b, np.full(len(left), key), place + np.asarray(left))
            return [(int(q), int(i), int(x), int(y), int(p)) for q, i, x, y, p in zip(rank, left, a, b, made) if q < NONE]

        agenda = candidates(np.arange(n - 1), np.arange(1, n))
        heapq.heapify(agenda)
        while agenda:
            _, j, a, b, piece = heapq.heappop(agenda)
            k = after[j]
            if sym[j] != a or k >= n or sym[k] != b:
                continue
            sym[j], sym[k] = piece, -1
            after[j] = after[k]
            if after[j] < n:
                before[after[j]] = j
            pairs = [(x, y) for x, y in ((before[j], j), (j, after[j])) if x >= 0 and y < n]
            if pairs:
                for c in candidates(*map(np.array, zip(*pairs))):
                    heapq.heappush(agenda, c)
        return [s for s in sym if s >= 0]

    def encode(self, batch: TextBatch, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the batch one after another, and how many each has. ``keys`` tell the texts apart for the hash."""
        if not len(batch.bytes):
            return np.empty(0, np.int32), np.zeros(batch.n_docs, np.int64)
        chars = np.frombuffer(batch.bytes.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((batch.bytes & 0xC0) != 0x80)))
        char_at = lead[batch.doc_at]
        full = np.flatnonzero(np.diff(char_at))
        chars = np.insert(chars, char_at[full], 0x20)  # the mark before each text
        begin = char_at[full] + np.arange(len(full))
        symbols = self.pieces.of_char[chars]
        known = symbols >= 0
        marks = symbols == self.pieces.mark
        edge = np.empty(len(symbols), bool)
        edge[0] = True
        edge[1:] = ~known[1:] | ~known[:-1] | (marks[1:] & ~marks[:-1])
        edge[begin] = True
        first = np.flatnonzero(edge)
        n = np.diff(np.append(first, len(symbols)))
        doc = np.repeat(full, np.diff(np.append(begin, len(symbols))))[first]
        place = first - np.repeat(begin, np.diff(np.append(begin, len(symbols))))[first]
        key = mix64(keys.astype(np.uint64) ^ np.uint64(self.seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))[doc]

        # Pieces of each stretch, in the order in which the classes are done; put in place at the end.
        found, owner = [], []
        single = np.flatnonzero((n == 1) & known[first])
        found.append(symbols[first[single]])
        owner.append(single)
        strange = np.flatnonzero(~known[first])
        if len(strange):
            spelled = [chr(c).encode("utf-8") for c in chars[first[strange]]]
            found.append(self.pieces.byte_id[np.frombuffer(b"".join(spelled), np.uint8)])
            owner.append(np.repeat(strange, [len(x) for x in spelled]))
        low = 1
        for width in CLASSES:
            some = np.flatnonzero((n > low) & (n <= width))
            low = width
            if len(some):
                sym = self._side_by_side(symbols, first[some], n[some], key[some], place[some], width).T
                r, c = np.nonzero(sym >= 0)
                found.append(sym[r, c])
                owner.append(some[r])
        for u in np.flatnonzero(n > low):
            ids = self._on_a_heap(symbols[first[u]:first[u] + n[u]], key[u], int(place[u]))
            found.append(np.array(ids, np.int32))
            owner.append(np.full(len(ids), u))
        ids, owner = np.concatenate(found), np.concatenate(owner)
        per_unit = np.bincount(owner, minlength=len(first))
        unit_at = np.concatenate(([0], np.cumsum(per_unit)))
        out = np.empty(len(ids), np.int32)
        done = 0
        for part in found:  # inside one part the pieces of a stretch stand together, in order
            if len(part):
                own = owner[done:done + len(part)]
                head = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                size = np.diff(np.append(head, len(own)))
                out[np.repeat(unit_at[own[head]] - head, size) + np.arange(len(own))] = part
                done += len(part)
        return out, np.bincount(doc, per_unit, batch.n_docs).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts one after another, and how many each has."""
        n = self.pieces.n_bytes[ids]
        before = np.cumsum(n) - n
        data = self.pieces.spelled[np.repeat(self.pieces.spelled_at[ids] - before, n) + np.arange(int(n.sum()))]
        ends = np.concatenate(([0], np.cumsum(n)))[np.cumsum(counts)]
        size = np.diff(np.concatenate(([0], ends)))
        full = np.flatnonzero(size)
        keep = np.ones(len(data), bool)
        keep[(ends - size)[full]] = False  # the mark before each text
        size[full] -= 1
        return data[keep], size


def _run(path: str, rate: float, seed: int) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, rate, seed)
        for part in parts:
            texts = as_large(part.column("text"))
            for lo, hi in chunks(texts):
                batch = TextBatch(texts, lo, hi)
                keys = part.column("doc_id").slice(lo, hi - lo)
                ids, counts = encoder.encode(batch, np.asarray(keys.fill_null(0)).astype(np.int64))
                data, size = encoder.decode(ids, counts)
                same = size == np.diff(batch.doc_at)
                if same.all():
                    wrong = np.concatenate(([0], np.cumsum(data != batch.bytes)))
                    same &= np.diff(wrong[batch.doc_at]) == 0
                ends = np.cumsum(counts)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b].tobytes()) for a, b in zip(ends - counts, ends)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys, pa.array(counts), pa.array(crc, pa.int64()), pa.array(same), lists], ["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"])

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, model: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, lossless, ids) for every row of ``docs``; ``lossless`` compares the decoded text with the text."""
    rows = picked(docs, doc_id="long", text="string")
    return rows.mapInArrow(_run(model, rate, seed), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean, ids array<int>")


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` encoded with dropout 0.1 and decoded again."""
    return encoded(table(spark, sf_dir, "documents"), default_model()).drop("ids")


#: Merges are beyond SQL; the tests hold rate 0 against the library, dropout against a plain agenda, and every decoding against its text.
ORACLE_SQL: dict[str, str] = {}
