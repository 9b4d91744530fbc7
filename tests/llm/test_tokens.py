import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from shoptide.llm import length_packing, merge_dropout, token_records
from shoptide.llm.common import new_folder, local_path
from shoptide.llm.textbatch import TextBatch, as_large, chunks

FRAGMENTS = ["a", " ", "  ", "\n", "\t", " ", " ", "é", "　", "foo", "don't", "'s", "ing", "12", "!!", "***", "\x85", "\x1c", "漢", "🙂", "<|endoftext|>", "<s>",
             "\r\n", "\x0b", "—", "..", "x  y", "  ", "the", "ab" * 40]


def hard_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


def encode_all(encode, texts, limit=2_000_000):
    arr, out = as_large(pa.array(texts)), []
    for lo, hi in chunks(arr, limit):
        ids, n = encode(TextBatch(arr, lo, hi), np.arange(lo, hi))
        ends = np.cumsum(n)
        out += [ids[a:b].tolist() for a, b in zip(ends - n, ends)]
    return out


def test_packing_measures_token_ids(spark, docs, odd_rows, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_records.default_tokenizer())
    tokenizer.encode_special_tokens = True
    rows = odd_rows + [(20 + i, t) for i, t in enumerate(hard_texts(60, 7))]
    expected = sorted((i is None, i or 0, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows)
    docs(rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for out in (length_packing.op1_length_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, read, str(tmp_path))):
        out = out.collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in out) == expected
        batches = {}
        for r in out:
            assert r["n_tokens"] <= r["bucket_tokens"]
            batches.setdefault((r["bucket"], r["batch"]), []).append(r["bucket_tokens"])
        assert all(sum(x) <= length_packing.BUDGET or len(x) == 1 for x in batches.values())


def test_stretches_give_the_ids_of_whole_texts():
    encoder = token_records.StretchEncoder(token_records.default_tokenizer())
    texts = hard_texts(1500)
    expected = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encode_all(lambda b, _: encoder.encode(b), texts) == expected
    assert encode_all(lambda b, _: encoder.encode(b), texts, 500) == expected  # from the table of kept ids


def test_records_are_read_back_in_order(spark, docs, odd_rows):
    from tokenizers import Tokenizer

    path = token_records.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rows = odd_rows + [(20 + i, t) for i, t in enumerate(hard_texts(40, 5))]
    folder = new_folder(spark, "records-test")
    folder = folder if folder.startswith("file:") else f"file://{folder}"
    shards = token_records.write_records(docs(rows, clash=True), path, folder)
    out = sorted(token_records.read_records(shards, folder).collect(), key=lambda r: (r["start"]))
    ids = {}
    for i, t in rows:
        x = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        ids.setdefault(i, []).append((len(x), zlib.crc32(x.tobytes())))
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in out] == sorted((i is not None, i or 0) for i, _ in rows)
    at = 0
    for r in out:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in ids[r["doc_id"]]
        at += r["n_tokens"]
    empty = new_folder(spark, "records-empty")
    empty = empty if empty.startswith("file:") else f"file://{empty}"
    assert token_records.read_records(token_records.write_records(docs([]), path, empty), empty).count() == 0

    shard = sorted(r["shard"] for r in shards.collect())[-1]
    file = f"{local_path(folder)}/{shard}.rec"
    data = bytearray(open(file, "rb").read())
    data[14] ^= 1
    open(file, "wb").write(data)
    with pytest.raises(Exception, match="damaged record"):
        token_records.read_records(shards, folder).count()


def plain_agenda(encoder, text, key):
    """One agenda over a whole text, kept as a list that is searched from the left."""
    p = encoder.pieces
    chars = " " + text if text else ""
    symbols = [(int(p.of_char[ord(c)]), i, c) for i, c in enumerate(chars)]
    seed = merge_dropout.mix64(np.array([key], np.uint64) ^ np.uint64(encoder.seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    while True:
        best = None
        for k in range(len(symbols) - 1):
            (a, at, _), (b, _, _) = symbols[k], symbols[k + 1]
            if a < 0 or b < 0:
                continue
            made = int(p.merged(np.array([a]), np.array([b]))[0])
            if made < 0 or (encoder.rate and merge_dropout.dropped(seed, np.array([at]), np.array([made]), encoder.rate)[0]):
                continue
            if best is None or p.rank[made] < best[0]:
                best = (p.rank[made], k, made)
        if best is None:
            break
        _, k, made = best
        symbols[k:k + 2] = [(made, symbols[k][1], "")]
    return [i for a, _, c in symbols for i in ([a] if a >= 0 else [int(p.byte_id[x]) for x in c.encode()])]


def test_rate_zero_is_the_librarys_encoding():
    import sentencepiece

    encoder = merge_dropout.Encoder(merge_dropout.default_model(), 0.0)
    library = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.default_model())
    texts = [t.replace("<s>", "") for t in hard_texts(800)] + ["x" * 3000, "the " * 500, "  ", "abab" * 600]
    assert encode_all(encoder.encode, texts) == [library.encode(t) for t in texts]


def test_dropout_follows_a_plain_agenda_and_decodes_without_loss(monkeypatch):
    texts = hard_texts(120, 9) + ["", "▁ ▁▁x", "a▁b"]
    for rate, seed in ((0.1, 1), (0.5, 2), (1.0, 3)):
        encoder = merge_dropout.Encoder(merge_dropout.default_model(), rate, seed)
        got = encode_all(encoder.encode, texts)
        assert got == [plain_agenda(encoder, t, k) for k, t in enumerate(texts)]
        with monkeypatch.context() as m:
            m.setattr(merge_dropout, "CLASSES", (2,))  # everything on the heap
            assert encode_all(encoder.encode, texts[:60]) == got[:60]
        n = np.array([len(x) for x in got])
        data, size = encoder.decode(np.array([i for x in got for i in x], np.int64), n)
        ends = np.cumsum(size)
        assert [data[a:b].tobytes().decode() for a, b in zip(ends - size, ends)] == texts
    assert encode_all(merge_dropout.Encoder(merge_dropout.default_model(), 0.5, 4).encode, texts) != encode_all(merge_dropout.Encoder(merge_dropout.default_model(), 0.5, 5).encode, texts)


def test_merge_dropout_over_odd_rows(docs, odd_rows):
    out = merge_dropout.encoded(docs(odd_rows, clash=True), merge_dropout.default_model()).collect()
    assert len(out) == len(odd_rows) and all(r["lossless"] for r in out)
    assert all((r["n_pieces"] == 0) == (r["doc_id"] in (1, 2, 10) or (r["doc_id"] is None and r["n_pieces"] == 0)) for r in out)
    assert merge_dropout.encoded(docs([]), merge_dropout.default_model()).count() == 0


def test_a_worker_that_reads_shards_holds_no_encoder(tmp_path):
    """Reading needs no tokenizer; the tables of the writing stage would stay in every worker's memory."""
    token_records._ENCODERS["held"] = object()
    assert list(token_records._read(f"file://{tmp_path}")(iter([]))) == []
    assert not token_records._ENCODERS
