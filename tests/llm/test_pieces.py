import hashlib
import random
import struct

import pytest

from graphloom.llm import pieces

MODEL = pieces.default_model()
TEXTS = [
    None, "", " ", "  ", " a", "a ", "\n", "\na", "a\n", "a \nb", "a\n b", "  \n\n  b", "▁x▁▁", "a\x00b", "😀é́", "<s> </s><0x0A><unk>", "\t\ta", "ﬁ ½  ²", "\r\n x",
    " " * 40 + "x", "x" * 500, "ab" * 300, "1234567890" * 9, "​ ﻿", "�", "the " * 5000, "日本語テキスト 한국어", "ÀÉÎ" * 50,
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def check(enc, library, text):
    words, surface = enc.encode(text)
    ids = [enc.pieces.begin, *memoryview(words).cast("I").tolist(), enc.pieces.end] if words else [enc.pieces.begin, enc.pieces.end]
    assert ids == library.encode(text or "", add_bos=True, add_eos=True), text
    assert enc.pieces.decoded(surface) == enc.pieces.decode(ids) == library.decode(ids)


def test_against_the_library(library):
    enc = pieces.Encoder(MODEL)
    for text in TEXTS:
        check(enc, library, text)
    rng = random.Random(3)
    for letters in ("ab \n▁ é😀<s>e t.h,in ", "thein r", "0123 .,", "́ea​ "):
        for _ in range(400):
            check(enc, library, "".join(rng.choice(letters) for _ in range(rng.randrange(80))))


def test_small_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 3)
    monkeypatch.setattr(pieces, "PAIRS_KEPT", 5)
    enc = pieces.Encoder(MODEL)
    for text in ["one two three four five six one two three", "tester testing tested rested", *TEXTS[:12]]:
        check(enc, library, text)


def test_backtracking_is_needed():
    """Longest matches alone would go wrong: some text must make the encoder step back or shorten."""
    model = pieces.Pieces(MODEL)
    words = ["▁Ciónllos", "▁thntblere", "▁schgesch", "▁éauxment", "▁unbelievably", "▁ththandouning"]
    greedy = []
    for w in words:
        at, out = 0, []
        while at < len(w):
            window = w[at : at + model.reach]
            out.append(model.longest[window[: model.finder.longest_prefix(window)]])
            at += model.sizes[out[-1]]
        greedy.append(out)
    assert any(model.unit(w) != g for w, g in zip(words, greedy, strict=True))
    for w in words:
        assert [model.pieces[i] for i in model.unit(w)] == model.merged(w)


def test_operator(spark, library):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode(df, MODEL).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(TEXTS[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == library.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.encode(df.limit(0), MODEL, outputs="digest").columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def test_query_on_whole_documents(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pieces.op3_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Pieces(b"")
