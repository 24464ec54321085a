import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tracewright.llm import queries
from tracewright.llm.pieces import PieceModel, decode_pieces, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "c", "▁", " ", "  ", " " * 15, " " * 31, "é", "日", "\n", "\t", "\x00", "😀", "<s>", "<0x41>", "th", "ing", "　", "в", "ко", "----", "...."]
TEXTS = [None, "", " ", "▁", "  a  b  ", "x" * 5000, " " * 20000, "ab" * 4000, "日本" * 3000, "word " * 30000, "é́ \x00\x01 😀<s></s><unk>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH, words=2000, stretch=200)


def held(model, library, texts):
    rows = [np.frombuffer(m, "<i4") for m in model.encode(texts)]
    for text, row, back in zip(texts, rows, model.decode(rows)):
        want = library.encode(text)
        assert row.tolist() == want, repr(text[:80])
        assert back == library.decode(want), repr(text[:80])


def test_same_as_library(model, library):
    rng = random.Random(3)
    vocabulary = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [t or "" for t in TEXTS]
    for pool, most in ((PARTS, 40), (vocabulary, 12), (letters, 200), (" ▁a", 90), ("-=_ .", 60)):
        texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, most))) for _ in range(600)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(200)]
    held(model, library, texts)


def test_long_texts(library):
    rng = random.Random(4)
    whole = PieceModel(PATH)
    pieces = [" ".join(rng.choice(["alpha", "été", "zq", "日本", "\n"]) for _ in range(400_000)), "".join(rng.choice("etaoin") for _ in range(1_200_000)), " " * 1_100_000]
    held(whole, library, pieces)


def test_decoding_any_ids(model, library):
    rng = random.Random(5)
    kinds = [lambda: rng.choice([0, 1, 2]), lambda: rng.randint(3, 258), lambda: rng.randint(195, 258), lambda: rng.randint(259, 31999), lambda: rng.choice([259, 28705])]
    rows = [np.array([rng.choice(kinds)() for _ in range(rng.randint(0, 9))], np.int64) for _ in range(4000)]
    assert model.decode(rows) == [library.decode(r.tolist()) for r in rows]
    with pytest.raises(ValueError):
        model.decode([np.array([library.vocab_size()])])


def test_tables(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null id", "x"), (None, None, None), (7, "same", "x"), (7, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = decode_pieces(encode_pieces(docs, PATH), PATH).collect()
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=str) == sorted(want, key=str)
    assert decode_pieces(encode_pieces(docs.where("false"), PATH), PATH).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r.ids, r.text) for r in decode_pieces(nothing, PATH).orderBy("doc_id").collect()] == [(None, ""), ([], "")]


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op13_sentencepiece(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = library.encode(d.text or "")
        row = got[d.doc_id]
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
