import math
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabulens.llm import language, ngrams, toxicity

rng = random.Random(1)
VOCABULARY = [f"wo{i}" for i in range(300)]


def lm_rows():
    rows = [(i, " ".join(rng.choice(VOCABULARY[:60] if i % 2 else VOCABULARY) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(i, "the same few words come again and again") for i in range(200, 240)]
    return rows + [(300, None), (301, ""), (302, " \t\n"), (None, "no id"), (7, "repeated Row"), (7, "repeated Row"),
                   (303, "non breaking \x1c É é " + "x" * 5000)]


def tokens_of(text):
    return (text or "").encode().lower().split() + [None]


@pytest.mark.parametrize("room", [ngrams.ROOM, 6000])
def test_counts_and_base_agree_with_brute_force(spark, room):
    rows = lm_rows()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    learned = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            learned.update(tokens_of(t))
    n, v = sum(learned.values()), len(learned)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in
                 ngrams.score(df, room=room).collect())
    want = sorted((i or (-1 if i is None else 0), len(tokens_of(t)), sum(learned[x] > 0 for x in tokens_of(t)), n, round(
        sum(math.log10((learned[x] + 1) / (n + v + 1)) for x in tokens_of(t)), 6)) for i, t in rows)
    want = [(-1 if a == 0 else a, *b) for a, *b in want]
    assert got == sorted(want)


def test_passes_do_not_change_the_score(spark):
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    one, many = (sorted(round(r["score"], 6) for r in ngrams.score(df, room=room).collect()) for room in (ngrams.ROOM, 6000))
    # the filters differ in their false positives alone
    assert sum(one) == pytest.approx(sum(many), rel=0.01)


def test_model_beats_base_on_held_out_repeats(spark):
    df = spark.createDataFrame(lm_rows(), "doc_id long, text string")
    held = ngrams.score(df).where("doc_id >= 200 AND doc_id < 240").where((F.crc32(F.col("doc_id").cast("string")) % 7) == 2)
    rows = held.collect()
    assert rows and all(r["score"] > r["base_score"] + 3 for r in rows)


def test_pairs_seen_once_are_known(spark):
    # every pair stands once in the training rows
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(rng.sample(words, 40))) for i in range(60)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, t if i not in held else rows[[j for j, _ in rows if j not in held][k % 40]][1])
            for k, (i, t) in enumerate(rows)]
    rows = [(i, t) for n, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] - r["base_score"] for r in ngrams.score(df).collect()}
    assert held and all(got[i] > 1.5 for i in held)


def test_filter_levels():
    keys = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.random.default_rng(0).integers(2, 5000, len(keys))
    body = ngrams.bloom(keys, counts)
    depth = int(ngrams.levels(counts).sum()) * ngrams.BITS_PER_KEY
    held = ngrams.Filter(1, [(0, depth, body.tobytes())])
    assert (held.found(keys) >= ngrams.levels(counts)).all()
    assert (held.found(keys + np.uint64(1)) > 0).mean() < 0.03


def test_lm_empty(spark):
    assert ngrams.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_block_max_search_is_exact():
    r = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        terms = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        w = r.random(len(terms)) + 0.1
        vectors.append((terms, w / np.sqrt(w @ w)))
    index, dense = toxicity.BlockMaxIndex(vectors, 40), np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for t, w in vectors[:60]:
        q = np.zeros(40)
        q[t] = w
        cosine = dense @ q
        want = [i for i in np.lexsort((np.arange(500), -np.round(cosine, 12))) if cosine[i] > 0][:25]
        rows, scores = index.nearest(t, w, 25)
        assert np.allclose(scores, cosine[rows]) and np.allclose(np.sort(scores), np.sort(cosine[want]))


def toxic_tables(spark, n=300):
    bad = ["idiotish", "trashy", "scummy"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(VOCABULARY) for _ in range(60)]
        toxic = i % 5 == 1
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad).upper() + "***"
        docs.append((i, " ".join(words), f"s{i % 3}", 9))
        if i % 10 != 7:
            labels.append((i, int(toxic)))
    docs += [(1000, None, None, 1), (1001, "", "s", 1), (1002, "***", "s", 1), (None, "trashy words", "s", 1), (1, docs[1][1], "s", 1)]
    labels += [(5000, 1), (None, 1), (2, None), (1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, score string, toxic int"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_finds_held_out_documents(spark):
    docs, labels = toxic_tables(spark)
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 1000:
            assert (r["score"] >= 0.5) == (r["doc_id"] % 5 == 1)
        assert 0 <= r["score"] <= 1
    clean = toxicity.keep_clean(docs, model)
    assert clean.schema == docs.schema
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in got if r["score"] < 0.5}


def test_toxicity_filter_works_on_few_texts_at_once():
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    docs = SimpleNamespace(columns=["doc_id", "text"], schema=None, sparkSession=SimpleNamespace(sparkContext=context),
                           mapInArrow=lambda work, schema: work)
    vocabulary = {"bad": 0, "good": 1}
    examples = [(i, i % 2, Counter({0 if i % 2 else 1: 1 + i % 3})) for i in range(40)]
    model = toxicity.Model(vocabulary, np.ones(2), examples, {0: 1.0, 1: 1.0})
    texts = [("bad " if i % 3 == 0 else "good ") * 30_000 for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts)], ["doc_id", "text"])
    parts = list(toxicity.keep_clean(docs, model)(iter([batch])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [i for i in range(30) if i % 3]
    assert max(p.num_rows for p in parts) < 12


def test_known_words_are_held_in_two_generations(monkeypatch):
    monkeypatch.setattr(toxicity, "WORDS_KEPT", 4)
    vocabulary = {t: i for i, t in enumerate(["bad", "bett-", "bette-", "worse"])}
    known = toxicity.Known(vocabulary)
    for i in range(50):
        counts = known.counts(f"Bad, better {'worse ' * 2}rare{i} (bad)".encode())
        assert counts == Counter({0: 2, 1: 1, 2: 1, 3: 2})
        assert len(known) <= 4 and len(known.older) <= 4


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = toxic_tables(spark, 20)
    model = toxicity.fit(docs, labels.limit(0))
    assert {r["score"] <= 0.5 for r in toxicity.score(docs, model).collect()} == {True}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_language_field(spark):
    lexicon = {"en": ["the", "water", "house", "with", "and"], "de": ["wasser", "und", "der", "haus", "mit"],
               "fr": ["eau", "maison", "avec", "les", "été"]}
    rows = [(i, " ".join(rng.choice(lexicon[x]) for _ in range(30)), x) for i in range(90) for x in [list(lexicon)[i % 3]]]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !!", "fr"), (203, "the " * 3000, None), (None, "wasser und", "de"),
             (1, rows[1][1], "de")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    field = language.fit(df)
    assert field.languages == ["de", "en", "fr"]
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language.identify(df, field).collect()}
    for i, text, lang in rows[:90]:
        assert (i, lang) in got and 0.5 < got[i, lang] <= 1
    assert {(200, "und"), (201, "und"), (202, "und"), (203, "en"), (None, "de")} <= set(got)
    mixed = language.words("the water and the house wasser und der haus mit", field)
    assert [x for _, x, _ in mixed] == ["en"] * 5 + ["de"] * 5
    nothing = language.fit(df.limit(0))
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}
    assert language.identify(df.limit(0), field).count() == 0


def test_text_without_spaces_counts_to_its_end(spark):
    lexicon = {"en": ["the", "water", "house", "with", "and"], "de": ["wasser", "und", "der", "haus", "mit"]}
    glued = lambda x, n: "".join(rng.choice(lexicon[x]) for _ in range(n))
    rows = [(i, " ".join(rng.choice(lexicon[x]) for _ in range(30)) if i % 4 < 2 else glued(x, 30), x)
            for i in range(80) for x in [list(lexicon)[i % 2]]]
    field = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [glued(a, 20) + glued(b, 200) for a, b in (("en", "de"), ("de", "en"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(df, field).collect()} == {0: "de", 1: "en"}
    assert "".join(w for w, *_ in language.words(texts[0], field)) == texts[0]
    word = "abcdefghij" * 6
    assert len(language.features(word)) == 7 + len(word) + 1 + len(word)


def test_forward_backward_sums_all_paths():
    r = np.random.default_rng(5)
    k, lengths = 3, np.array([4, 2, 2, 1])
    t, s = r.random((k, k)), r.random(k)
    t, s = t / t.sum(1, keepdims=True), s / s.sum()
    whole = [r.random((n, k)) for n in lengths]
    emission = np.array([whole[j][i] for i in range(4) for j in range(4) if i < lengths[j]])
    marginal, *_ = language.forward_backward(emission, lengths, t, s)
    row = 0
    import itertools
    want = []
    for j, n in enumerate(lengths):
        m = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            p = s[path[0]] * whole[j][0][path[0]]
            for a in range(1, n):
                p *= t[path[a - 1], path[a]] * whole[j][a][path[a]]
            for a in range(n):
                m[a, path[a]] += p
        want.append(m / m.sum(1, keepdims=True))
    for i in range(4):
        for j in range(4):
            if i < lengths[j]:
                assert np.allclose(marginal[row], want[j][i])
                row += 1
