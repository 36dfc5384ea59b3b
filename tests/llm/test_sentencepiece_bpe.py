"""Ids and texts against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from flowbook.llm import sentencepiece_bpe as bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=bpe.MODEL)


@pytest.fixture(scope="module")
def tables():
    return bpe.load()


def mixed():
    draw = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzABC0123 ▁ \n\té中ßаб😀́."
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    texts += ["".join(draw.choice("inghteaosr ") for _ in range(draw.randint(0, 400))) for _ in range(1000)]
    texts += [" " * k for k in range(70)] + ["a" * k for k in range(70)] + ["  " * k + "the" for k in range(40)]
    return texts + [" " * 20_000 + "x", "ab" * 30_000, "\x00a<s></s><unk><0x41> ▁▁a", "中" * 1000, "▁", " ▁ ", "\n", "", "the " * 300_000 + "end"]


def test_ids_equal_the_library(library, tables):
    texts = mixed()
    want = library.encode(texts, add_bos=True, add_eos=True)
    got = bpe.Encoder(tables)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [bpe.decoded(tables, np.array(w)) for w in want] == [library.decode(w) for w in want]


def test_small_slices_and_table(library, tables, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 37)
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    texts = [t for t in mixed() if len(t) < 2000][::7] + ["x" * 500 + "  y", "no" + " " * 99]
    got = bpe.Encoder(tables)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == library.encode(texts, add_bos=True, add_eos=True)


def test_single_merges_alone_give_the_same(library, tables):
    encoder = bpe.Encoder(tables)
    for text in [t for t in mixed() if 0 < len(t) < 400][::5]:
        symbols = encoder.one_by_one(encoder.symbols[np.frombuffer(("▁" + text.replace(" ", "▁")).encode("utf-32-le"), np.uint32)].tolist())
        pieces = library.encode(text, out_type=str)
        assert [s for s in symbols if s < tables.size] == [library.piece_to_id(p) for p in pieces if not library.is_byte(library.piece_to_id(p))]


def test_any_ids_decode_like_the_library(library, tables):
    draw = random.Random(3)
    for _ in range(5000):
        ids = [draw.randrange(32000) if draw.random() < 0.5 else draw.randrange(260) for _ in range(draw.randint(0, 12))]
        assert bpe.decoded(tables, np.array(ids, np.int64)) == library.decode(ids)


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.query(spark, SF).collect())) == sorted(want)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x", "c"), (4, "two  words", "d"), (4, "two  words", "d"), (5, "long " * 100_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert got == {(1, ""), (2, ""), (None, "x"), (4, "two  words"), (5, "long " * 100_000)}
    assert bpe.encode(docs).count() == 6 and bpe.encode(docs.limit(0)).count() == 0
    assert {r.n_tokens for r in bpe.encode(docs).where("doc_id < 3").collect()} == {2}
