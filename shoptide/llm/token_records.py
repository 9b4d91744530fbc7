"""Operator 8, token-ID output: length-delimited binary records.

Each document's token ids, with an end id, form one record of a shard file:

    uint64 length | uint32 masked checksum of those 8 bytes | payload | uint32 masked checksum of the payload

all little-endian; the payload is the ids as unsigned 16-bit numbers (32-bit for
vocabularies above 65,536), a checksum c (CRC-32) is masked as
``rotate_right(c, 15) + 0xA282EAD8``. Beside ``shard-N.rec`` lies ``shard-N.idx``,
the offset index for shuffled reads: doc_id (int64), byte offset, number of ids
(uint64 each) per record, little-endian. Shards are ranges of ascending doc_id.

Texts are range-partitioned by doc_id, then encoded and written where they are,
so ids are never shuffled. A shard is written under a temporary name and moved,
so a task that runs twice leaves one whole file. Files go to the shared folder
through pyarrow's file systems.

The tokenizer cuts a text at white space before it merges, so a stretch that
ends with a word and begins with the white space before it has the same ids in
every text. A worker therefore encodes distinct stretches only and keeps the
ids of the latest in a table of fixed size; whole texts are put together from
them, with the same ids as the library gives for the whole text (tested).

Defined results: a null or empty text is a record of the end id only; rows
without doc_id come first; rows with one doc_id are ordered by a hash of the
text; repeated rows get records of their own; an empty table writes no shard and
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, new_folder, picked, table, written
from .textbatch import TextBatch, as_large, chunks

END_ID = 0
MASK = 0xA282EAD8
NO_ID = -(1 << 63)
INDEX_ROW = "<qQQ"  # doc_id, byte offset, number of ids
CACHE_BITS = 20
POOL_LIMIT = 16_000_000
JOINED_BYTES = 4096
TEXTS_AT_ONCE = 64  # joined stretches that are handed to the library in one call
ENCODED_BYTES = 500_000  # text that is cut into stretches at once
READ_ROWS = 10_000
NO_SPACE_AT_END = np.zeros(256, bool)  # a byte that ends a character which is white space nowhere
NO_SPACE_AT_END[0x21:0x7F] = True


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


class StretchEncoder:
    """Ids of whole texts from the ids of their distinct stretches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would each hold memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.kind = np.uint16 if self.width == 2 else np.uint32
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)  # byte-level: one character stands for one byte
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(1 << CACHE_BITS, np.uint64)
        self.at = np.zeros(1 << CACHE_BITS, np.int64)
        self.n = np.zeros(1 << CACHE_BITS, np.int64)
        self.pool = np.full(1 << 16, END_ID, self.kind)
        self.used = 1

    def _keep(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        at = self.used
        self.pool[at:at + len(ids)] = ids
        self.used += len(ids)
        return at

    @staticmethod
    def _cuts(batch: TextBatch) -> np.ndarray:
        """Ends of words after which white space begins a new stretch: those whose last character can't be white space itself."""
        end = batch.end
        last = batch.bytes[end - 1]
        safe = NO_SPACE_AT_END[last]
        wide = np.flatnonzero(last >= 0x80)
        if len(wide):
            e = end[wide]
            two = batch.bytes[e - 2]
            three = batch.bytes[np.maximum(e - 3, 0)]
            safe[wide] = ((two >= 0xC3) & (two <= 0xDF)) | ((two < 0xC0) & (two >= 0x80) & ~np.isin(three, (0xE1, 0xE2, 0xE3)))
        return end[safe]

    def _looked_up(self, batch: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the stretches of a batch that has text, the places of their ids in the pool, and how many each has."""
        total = len(batch.bytes)
        cuts = self._cuts(batch)
        starts = np.unique(np.concatenate([batch.doc_at[:-1], cuts]))
        starts = starts[starts < total]
        ends = np.append(starts[1:], total)
        key = batch.span_hashes(starts, ends, lower=False)
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        slot = (distinct >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        if self.used > POOL_LIMIT:
            self._reset()
        at, n = self.at[slot], self.n[slot]
        miss = np.flatnonzero((self.key[slot] != distinct) | (n == 0))
        if len(miss):
            a, b = starts[first[miss]], ends[first[miss]]
            at[miss], n[miss] = self._encode_stretches(batch, a, b, cuts)
            self.key[slot[miss]], self.at[slot[miss]], self.n[slot[miss]] = distinct[miss], at[miss], n[miss]
        return starts, at[inverse], n[inverse]

    def encode(self, batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the batch one after another, and how many each has."""
        if not len(batch.bytes):
            return np.empty(0, self.kind), np.zeros(batch.n_docs, np.int64)
        starts, at, n = self._looked_up(batch)
        before = np.cumsum(n) - n
        ids = self.pool[np.repeat(at - before, n) + np.arange(int(n.sum()))]
        return ids, self._per_text(batch, starts, n)

    def counts(self, batch: TextBatch) -> np.ndarray:
        """How many ids each text of the batch has."""
        if not len(batch.bytes):
            return np.zeros(batch.n_docs, np.int64)
        starts, _, n = self._looked_up(batch)
        return self._per_text(batch, starts, n)

    @staticmethod
    def _per_text(batch: TextBatch, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, batch.doc_at)])

    def _encode_stretches(self, batch: TextBatch, a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = batch.bytes.tobytes()
        # Stretches that begin with white space and end at a cut may follow each other in one text.
        joinable = ~batch.solid[a] & np.isin(b, cuts)
        at, n = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for some, single in ((np.flatnonzero(joinable), False), (np.flatnonzero(~joinable), True)):
            if not len(some):
                continue
            size = (b - a)[some]
            groups = np.arange(len(some)) if single else (np.cumsum(size) - size) // JOINED_BYTES
            head = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            tail = np.append(head[1:], len(some))
            ids = [np.empty(0, np.int64)]
            for k in range(0, len(head), TEXTS_AT_ONCE):
                ends = zip(head[k:k + TEXTS_AT_ONCE], tail[k:k + TEXTS_AT_ONCE])
                texts = [b"".join([data[a[i]:b[i]] for i in some[h:t]]).decode("utf-8") for h, t in ends]
                ids += [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.concatenate(ids)
            reached = np.cumsum(self.n_bytes[ids])
            stop = np.cumsum(size)
            last = np.searchsorted(reached, stop)
            if not len(ids) or (reached[np.minimum(last, len(ids) - 1)] != stop).any():
                raise ValueError("the tokenizer's ids don't end where a stretch of text ends: it is not byte-level")
            begin = np.concatenate(([0], last[:-1] + 1))
            base = self._keep(ids.astype(self.kind))
            at[some], n[some] = base + begin, last + 1 - begin
        return at, n


_ENCODERS: dict[str, StretchEncoder] = {}


def encoder_of(path: str) -> StretchEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = StretchEncoder(path)
    return _ENCODERS[path]


def _write(path: str, folder: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        shard = f"shard-{context.partitionId():06d}"
        own = f"{root}/.{shard}-{context.taskAttemptId()}"
        encoder, records, total, out, side = None, 0, 0, None, None
        for part in parts:
            texts = as_large(part.column("text"))
            ids_of = part.column("doc_id").to_pylist()
            encoder = encoder or encoder_of(path)
            if out is None:
                out, side = (store.open_output_stream(f"{own}.{kind}", compression=None) for kind in ("rec", "idx"))
            for lo, hi in chunks(texts, ENCODED_BYTES):
                ids, counts = encoder.encode(TextBatch(texts, lo, hi))
                ends = np.cumsum(counts)
                for doc_id, a, b in zip(ids_of[lo:hi], ends - counts, ends):
                    payload = ids[a:b].tobytes() + END_ID.to_bytes(encoder.width, "little")
                    length = struct.pack("<Q", len(payload))
                    side.write(struct.pack(INDEX_ROW, NO_ID if doc_id is None else doc_id, out.tell(), b - a + 1))
                    out.write(length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload)))
                    records, total = records + 1, total + int(b - a) + 1
        if out is not None:
            out.close()
            side.close()
            for kind in ("rec", "idx"):
                store.move(f"{own}.{kind}", f"{root}/{shard}.{kind}")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "n_records": [records], "n_ids": [total], "width": [encoder.width]})

    return run


SHARD_COLUMNS = "shard string, n_records long, n_ids long, width long"


def write_records(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Writes the shards under ``folder`` and returns their list: shard, n_records, n_ids, width, start (ids in earlier shards)."""
    rows = picked(docs, doc_id="long", text="string").withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    shards = written(rows.mapInArrow(_write(tokenizer, folder), SHARD_COLUMNS), "shards")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard file
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))


def _read(folder: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _ENCODERS:  # of the shards this worker wrote: no longer needed
            _ENCODERS.clear()
            give_back()
        store, root = fs.FileSystem.from_uri(folder)
        for part in parts:
            for row in part.to_pylist():
                kind, start, out = ("<u2" if row["width"] == 2 else "<u4"), row["start"], []
                with (store.open_input_stream(f"{root}/{row['shard']}.idx", compression=None) as side,
                      store.open_input_stream(f"{root}/{row['shard']}.rec", compression=None, buffer_size=1 << 20) as data):
                    at = 0
                    for doc_id, offset, n in _index_rows(side):
                        head = data.read(12)
                        length, crc = struct.unpack("<QI", head)
                        if at != offset or crc != masked_crc(head[:8]):
                            raise ValueError(f"{row['shard']}: a damaged record length at byte {at}")
                        payload = data.read(length)
                        if struct.unpack("<I", data.read(4))[0] != masked_crc(payload):
                            raise ValueError(f"{row['shard']}: a damaged record at byte {at}")
                        ids = np.frombuffer(payload, kind).astype("<u4")
                        if len(ids) != n:
                            raise ValueError(f"{row['shard']}: the index gives {n} ids at byte {at}, the record has {len(ids)}")
                        out.append((None if doc_id == NO_ID else doc_id, start, n, zlib.crc32(ids.tobytes())))
                        start, at = start + n, at + 16 + length
                        if len(out) == READ_ROWS:
                            yield _batch(out)
                            out = []
                if out:
                    yield _batch(out)

    return run


def _index_rows(side) -> Iterator[tuple[int, int, int]]:
    """(doc_id, offset, number of ids) of each record, a block of the index at a time."""
    while block := side.read(struct.calcsize(INDEX_ROW) * READ_ROWS):
        yield from struct.iter_unpack(INDEX_ROW, block)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every record, read from the files with all checksums tested."""
    n = max(1, shards.count())
    return shards.repartitionByRange(n, "shard").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` as records of token ids, written and read back."""
    folder = new_folder(spark, "records")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    shards = write_records(table(spark, sf_dir, "documents"), default_tokenizer(), folder)
    return read_records(written(shards, "shard-starts"), folder)


#: Merges are beyond SQL; the tests hold ids, offsets and checksums against the library's own encoding of whole texts.
ORACLE_SQL: dict[str, str] = {}
