import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewright.llm.common import Workspace
from tracewright.llm.packing import pack
from tracewright.llm.rans import Decoder, Frequencies, encode_blocks
from tracewright.llm.token_counts import token_counts
from tracewright.llm.token_files import read_token_files, write_token_files

TEXTS = [None, "", " ", "Hello  world\n\n end ", "<|endoftext|> <|startoftext|>", "naïve Ünïcode 日本語 \x00 é", "it's 12345 $$$", "word " * 30000, "x" * 5000]


@pytest.mark.parametrize("n_symbols", [1, 2, 300, 40000])
def test_round_trip(n_symbols):
    rng = np.random.default_rng(n_symbols)
    blocks = [rng.zipf(1.3, n).astype(np.int64) % n_symbols * 7 for n in (0, 1, 127, 128, 129, 5000, 70000)]
    symbols, counts = np.unique(np.concatenate(blocks), return_counts=True)
    table = Frequencies.of(symbols, counts)
    assert table.share.sum() == 1 << table.bits and table.share.min() >= 1
    coded = encode_blocks(blocks, table, lanes=128, every=16)
    for a, b in zip(blocks, Decoder(table).decode(coded)):
        assert (a == b).all()
    bits = -(counts * np.log2(counts / counts.sum())).sum()
    assert 32 * sum(len(c.words) for c in coded) <= 1.03 * bits + 64 * 128 * len(blocks)
    if n_symbols > 2:
        coded[-1].words[50] ^= 1
        with pytest.raises(ValueError):
            Decoder(table).decode(coded)


def rows_for(seed):
    rng = random.Random(seed)
    rows = [(i * 5, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (None, None), (7, "same"), (7, "same"), (7, "other")]
    rows += [(1000 + i, " ".join(rng.choice(["alpha", "Beta", "it's", "x9", "été", "\n"]) for _ in range(rng.randint(0, 300)))) for i in range(200)]
    rng.shuffle(rows)
    return rows


def test_files(spark):
    rows = rows_for(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    where = Workspace(spark, "t").path("files")
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, ids string").repartition(5)
    write_token_files(docs, where, path, block_ids=700)
    got = sorted(read_token_files(spark, where).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    want = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows]
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)


def test_no_documents(spark):
    where = Workspace(spark, "t").path("none")
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), where, public_tokenizers.path("word_bpe_49k.json"))
    assert read_token_files(spark, where).collect() == []


def test_counts_and_packing(spark):
    rows = rows_for(2)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    ids = [(i, t, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    got = token_counts(docs, path).collect()
    want = [(i, len((t or "").encode()), len(x), len(x) > 1024) for i, t, x in ids]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == sorted(want, key=str)
    pieces = pack(docs, path, block_tokens=20000).collect()
    windows, texts = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
        texts.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(p.length for p in pieces) == sum(len(x) + 1 for _, _, x in ids)
    unique = {i: x for i, _, x in ids if i not in (7, None)}
    for i, x in unique.items():
        data = b"".join(d for _, d in sorted(texts[i, len(x) + 1]))
        assert zlib.crc32(data) == zlib.crc32(np.array([*x, 1], "<u4").tobytes())
    empty = docs.where("false")
    assert pack(empty, path).collect() == [] and token_counts(empty, path).collect() == []
