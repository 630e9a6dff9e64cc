import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tabulens.llm import bpe, tokenfile

WORD, BYTE = bpe.default_path("word_bpe_49k.json"), bpe.default_path("byte_bpe_50k.json")
ROWS = [(5, "Plain words, and  two spaces.\nA second line's end!"), (2, "x" * 9000), (3, None), (4, ""), (1, " lead\ttab  nbsp  "),
        (6, "<|endoftext|> and <|STARTOFTEXT|> " + "abc<|endoftext|>" * 900), (7, "é́café ÀÉ 😀😀 ﬁ İstanbul ΣΑΣ"),
        (8, ("the of and " * 200 + "na" * 4000 + "'ll won't 123 ") * 3), (5, "Plain words, and  two spaces.\nA second line's end!"),
        (None, "no id here"), (9, "\n\n a \n b\n\nc  "), (10, "don't***!!! $$$money### (brackets) a<b>c")]


def docs(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in ROWS], "doc_id long, text string, ids string, row long")


def test_codec_is_the_one_of_the_library(spark):
    tok = bpe.tokenizer(WORD)
    got = {(r["doc_id"], tuple(r["ids"])): r["decoded"] for r in bpe.encode(docs(spark)).collect()}
    want = {}
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids)] = tok.decode(ids, skip_special_tokens=False)
    assert got == want
    assert bpe.encode(docs(spark)).count() == len(ROWS)
    assert bpe.encode(docs(spark).limit(0)).count() == 0


def test_words_of_texts_are_held_in_two_bounded_generations():
    tok, known = bpe.tokenizer(WORD), bpe.Words(WORD, "<i4", kept=5)
    texts = [f"word{i % 13} rare{i} the {'x' * (i % 7)}-y" for i in range(200)]
    for text in texts:
        ids = np.frombuffer(b"".join(map(known.__getitem__, text.encode().split())), "<i4").tolist()
        assert ids == tok.encode(text, add_special_tokens=False).ids
        assert len(known) <= 5 and len(known.older) <= 5
    assert bpe.words(WORD, "<i4", kept=bpe.TEXT_WORDS_KEPT).kept * 2 <= 250_000


def test_tree_of_any_leaves_is_exact():
    tok, rng = bpe.tokenizer(WORD), random.Random(4)
    alphabets = ["abcdefghij'", "0123'sé😀", "!?.#<|", "ab cdé\n", "thofsre'll"]
    for _ in range(400):
        signs = list(rng.choice(alphabets) + rng.choice(["", "é", " "])) + ["<|endoftext|>", "'ll", "the"]
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 700)))
        made = bpe.tree(tok, [bpe.coded(tok, x) for x in bpe.leaves(text, rng.choice([5, 17, 100]))])
        assert made.text == text and made.ids == tok.encode(text, add_special_tokens=False).ids


def test_small_leaves_in_spark_give_the_same(spark):
    tok = bpe.tokenizer(WORD)
    got = bpe.encode(docs(spark), leaf=16).collect()
    assert sorted(tuple(r["ids"]) for r in got) == sorted(
        tuple(tok.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS)


def test_token_files_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_CHARS", 4000)
    tok = bpe.tokenizer(BYTE)
    folder = tokenfile.write_token_files(docs(spark), str(tmp_path / "tokens"))
    got = sorted(tokenfile.documents_of(spark, folder).collect(), key=lambda r: r["start"])
    at = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (i, at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    empty = tokenfile.write_token_files(docs(spark).limit(0), str(tmp_path / "none"))
    assert tokenfile.documents_of(spark, empty).count() == 0


def test_wide_ids_survive_the_file():
    ids = [5, 65_541, 70_000, (1 << 20) + 3, 2]
    row = tokenfile._shard_row(0, 0, [7], [np.array(ids, "<u4").tobytes()]).to_pylist()[0]
    matrix = tokenfile.WaveletMatrix(row["n_tokens"], [np.frombuffer(p, np.uint8) for p in row["planes"]], row["zeros"])
    assert len(row["planes"]) == 21 and matrix.ids().tolist() == ids
    assert [matrix.access(i) for i in range(5)] == ids and [matrix.locate(x, 0) for x in ids] == list(range(5))


def test_words_of_the_byte_tokenizer_are_exact():
    tok, rng = bpe.tokenizer(BYTE), random.Random(8)
    tables = [bpe.Words(BYTE, "<u4", p) for p in ("", " ", "\n")]
    signs = list("abcé😀.'!#<|>0123ÀΩ") + [" ", " ", "\n", "'s", "'ll", "***", "<|endoftext|>", " ", "\t"]
    for _ in range(1500):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(tokenfile.chunks(text, *tables), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32)
    m = tokenfile.WaveletMatrix.build(ids)
    assert (m.ids() == ids).all()
    for place in {0, n // 2, n - 1} if n else ():
        value = int(ids[place])
        spots = np.flatnonzero(ids == value)
        assert m.access(place) == value
        assert m.count(value) == len(spots) and m.count(value, place) == (spots < place).sum()
        for k in (0, len(spots) - 1):
            assert m.locate(value, k) == spots[k]
        assert m.locate(value, len(spots)) == -1
    assert m.count(60_000) == 0 and m.locate(60_000, 0) == -1


def test_query_digests(spark, tmp_path):
    from tabulens.llm import suite
    docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    tok = bpe.tokenizer(WORD)
    got = suite.bpe_codec(spark, str(tmp_path)).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for i, t in ROWS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert {tuple(r) for r in got} == want


def test_words_learned_together_are_those_of_the_library():
    random.seed(5)
    tok, letters = bpe.tokenizer(BYTE), "abcdefghilmnorstuABSéüßñłж"
    words = {"".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(3000)}
    words |= {"the", "aaaaaaaaaaaa", "x", "end.", "(so", "a1b", "it's", "漢字", "ªµ", "...", "<|endoftext|>"}
    raw = [(sign + w).encode() for w in words for sign in ("", " ", "\n")]
    table = bpe.Words(BYTE, "<u4")
    table.learn(raw, tokenfile._latin_words(raw))
    assert set(table) - {b"\n"} == {w for w in raw if len(w) <= bpe.MERGED_BYTES and w.decode().lstrip().isalpha()
                                    and max(w.decode()) < "\u0100"} and len(table) > 900
    for word in raw:
        assert np.frombuffer(table[word], "<u4").tolist() == tok.encode(word.decode(), add_special_tokens=False).ids, word
    bounded = bpe.Words(BYTE, "<u4", kept=100)
    for some in (raw, raw[:30], [b" newword"]):
        bounded.learn(some, tokenfile._latin_words(some))
    assert len(bounded) <= 100 and bounded[b" newword"] == bpe.Words(BYTE, "<u4")[b" newword"]
    other = bpe.Words(WORD, "<i4")
    other.learn(raw, tokenfile._latin_words(raw))
    assert bpe.merges(WORD) is None and not other


def test_new_words_of_a_shard_are_encoded_together(monkeypatch):
    frame = SimpleNamespace(first=lambda: [1], mapInArrow=lambda work, schema: work)
    for name in ("agg", "select", "repartitionByRange", "sortWithinPartitions"):
        setattr(frame, name, lambda *a: frame)
    one_by_one = []
    coded = bpe.Words._coded
    monkeypatch.setattr(bpe.Words, "_coded", lambda self, word: one_by_one.append(word) or coded(self, word))
    bpe.words.cache_clear()
    random.seed(6)
    texts = [" ".join("".join(random.choices("abcdefghiklmnoprstu", k=9)) for _ in range(500)) for _ in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 8, pa.int32()), pa.array(range(8)), pa.array(texts)], ["part", "doc_id", "text"])
    shard, = tokenfile.encode_shards(frame)(iter([batch]))
    row = shard.to_pylist()[0]
    matrix = tokenfile.WaveletMatrix(row["n_tokens"], [np.frombuffer(p, np.uint8) for p in row["planes"]], row["zeros"])
    tok = bpe.tokenizer(BYTE)
    assert matrix.ids().tolist() == [i for t in texts for i in [*tok.encode(t, add_special_tokens=False).ids, 2]]
    assert len(one_by_one) <= 20


def test_texts_cut_together_are_those_of_the_library():
    tok, tables = bpe.tokenizer(BYTE), [bpe.Words(BYTE, "<u4", p) for p in ("", " ", "\n")]
    texts = [t or "" for _, t in ROWS] + ["", " ", "\n", "a", "a b", "a\nb c", "a ", "\na", "a  b", "a\tb", "a\x85b", "a\u3000b", "a\x1cb",
                                         "nl\n\nnl", "l'été d'août, où ?", "x\u200bz y", "é. ×. ÷! ª, ¼. a<b. <|endoftext|>. x<|endoftext|>!! b\ne-- e" + "-" * 20, "<|endoftext|>", "...", "a!", "?", ". .a a. .", "don't 1st\n2nd. end\n- it's"]
    for some in (texts, texts[:1], [""], [" "], []):
        want = [tok.encode(t, add_special_tokens=False).ids for t in some]
        got = tokenfile.coded(pa.array(some, pa.string()), tables[0], tables)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_a_task_leaves_no_words_behind():
    frame = SimpleNamespace(mapInArrow=lambda work, schema: work, dtypes=[("doc_id", "bigint")])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", "and more words"])], ["doc_id", "text"])
    known = bpe.words(WORD, "<i4", kept=bpe.TEXT_WORDS_KEPT)
    parts = bpe._encode_words(frame, WORD)(iter([batch, batch]))
    assert next(parts).num_rows == 2 and len(known) == 5
    rest = list(parts)
    tok = bpe.tokenizer(WORD)
    assert rest[0].column(1).to_pylist() == [tok.encode(t, add_special_tokens=False).ids for t in batch.column(1).to_pylist()]
    assert not known and not known.older
