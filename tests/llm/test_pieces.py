import hashlib
import random

import numpy as np
import pytest

from tabulens.llm import pieces, suite

ROWS = [(1, "Plain words, and  two spaces.\nA second line's end!"), (2, "x" * 9000), (3, None), (4, ""), (5, "  lead\ttab   nbsp  "),
        (6, "<s>a</s><0x0A><unk>"), (7, "é́café ÀÉ 😀😀 ﬁ İstanbul 中文 한국어 Ａ"), (8, "na" * 4000 + " " * 300 + "'ll won't 123 " * 3),
        (1, "Plain words, and  two spaces.\nA second line's end!"), (None, "no id here"), (9, "▁ ▁▁a\x00b")]


def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id long, text string, ids string, decoded long")


@pytest.fixture(scope="module")
def model():
    return pieces.pieces(pieces.default_path()).model


def test_codec_is_the_one_of_the_library(spark, model):
    got = pieces.encode(docs(spark)).collect()
    assert len(got) == len(ROWS)
    want = {}
    for i, t in ROWS:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want[i, tuple(ids)] = model.decode(ids)
    assert {(r["doc_id"], tuple(pieces.unpacked(r["ids"]))): r["decoded"] for r in got} == want
    assert pieces.encode(docs(spark).limit(0)).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 3, 256])
def test_any_text_after_any_number_of_rounds(model, monkeypatch, rounds):
    monkeypatch.setattr(pieces, "ROUNDS", rounds)
    monkeypatch.setattr(pieces, "LONG_WORD", 12)
    monkeypatch.setattr(pieces, "PIECE_CHARS", 40)
    rng, made = random.Random(rounds), pieces.Pieces(pieces.default_path())
    alphabets = ["ab ", "aeiourstln ", "  ", "▁ a", "é😀中文的 a\n", "0123 ", "thofsre ' ll", "\t\n .,", "한국 어는ａ"]
    for _ in range(500):
        signs = list(rng.choice(alphabets) + rng.choice(alphabets)) + rng.choice([[], ["the", "ing", "▁▁", " " * 17]])
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, rng.choice([5, 60, 300])))) for _ in range(2)]
        for text, packed in zip(texts, made.encode(texts), strict=True):
            ids = model.encode(text, add_bos=True, add_eos=True)
            assert pieces.unpacked(packed) == ids
            assert made.decode(packed) == model.decode(ids)


def test_bounded_table_keeps_results(model, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 3)
    made = pieces.Pieces(pieces.default_path())
    for text in ("one two three four five", "five four six", "one two six seven", "", "seven seven one"):
        assert pieces.unpacked(made.encode([text])[0]) == model.encode(text, add_bos=True, add_eos=True)


def test_broken_bytes_decode_as_in_the_library(model):
    made = pieces.pieces(pieces.default_path())
    for ids in ([3 + 0xC3], [1, 3 + 0xC3, 264, 2], [264, 3 + 0xE4, 3 + 0xB8, 287], [2, 1]):
        assert made.decode(np.array(ids, "<i4").tobytes()) == model.decode(ids)


def test_query_digests(spark, tmp_path, model):
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, t in ROWS:
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                  hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    got = suite.sentencepiece_codec(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(ROWS)
