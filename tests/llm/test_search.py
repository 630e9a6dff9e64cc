import random

import numpy as np
import pytest

from tabulens.llm import decontam, graph, licenses, suite

rng = random.Random(6)


def prose(n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def edit_distance_anywhere(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        previous, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (c != d))
    return min(row)


def edited(text, rate):
    out = []
    for c in text:
        u = rng.random()
        if u < rate / 3:
            continue
        out.append(rng.choice("abcdefghij") if u < 2 * rate / 3 else c)
        if 2 * rate / 3 <= u < rate:
            out.append(rng.choice("abcdefghij"))
    return "".join(out)


def test_edit_distance_is_exact():
    for _ in range(60):
        item, text = prose(6).encode(), prose(12).encode()
        assert decontam.edit_distance_within(item, text)[0] == edit_distance_anywhere(item, text)


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.03, 0.99), (0.08, 0.95)])
def test_recall_of_edited_passages(rate, least):
    items = [(i, prose(35).encode()) for i in range(60)]
    held, hits, n = decontam.Items(items), 0, 0
    for i, text in items:
        doc = f"{prose(50)} {edited(text.decode(), rate)} {prose(50)}".encode()
        if edit_distance_anywhere(text, doc) <= 0.2 * len(text):
            n += 1
            hits += any(m["item_id"] == i for m in held.found([doc])[0])
    assert n and hits / n >= least


@pytest.mark.parametrize("size", [20, 21, 23, 26, 56, 58, 60, 62])
def test_exact_items_wherever_they_begin(size):
    items = [(i, prose(30)[:size].strip().ljust(size, "x").encode()) for i in range(20)]
    held = decontam.Items(items)
    for i, text in items:
        for lead in (4, 5):
            for before, after in ((f"{prose(lead)} ", f" {prose(5)}"), (f"{prose(lead)}-(\"", "\")."), (prose(lead), prose(5))):
                doc = before.encode() + text + after.encode()
                found = [m for m in held.found([prose(9).encode(), doc])[1] if m["item_id"] == i]
                assert found and found[0]["distance"] == 0
    item = "".join(chr(0x4e00 + rng.randrange(900)) for _ in range(size)).encode()
    doc = "".join(chr(0x4e00 + rng.randrange(900)) for _ in range(400)).encode()
    assert [m["distance"] for m in decontam.Items([(1, item)]).found([doc[:300] + item + doc[300:]])[0]] == [0]


@pytest.mark.parametrize("size", [13, 15, 19, 20, 26, 60, 85, 115, 233])
def test_places_are_those_of_brute_force(size):
    items = [(i, prose(60)[:size].strip().ljust(size, "x").encode()) for i in range(20)]
    held, near = decontam.Items(items), 0
    docs = [f"{prose(12)} {edited(text.decode(), rate)} {prose(12)}".encode() for _, text in items for rate in (0.1, 0.15, 0.19)]
    for number, (doc, found) in enumerate(zip(docs, held.found(docs))):
        item_id, text = items[number // 3]
        least = edit_distance_anywhere(text, doc)
        near += least <= 0.2 * size + 1e-9
        assert [m["distance"] for m in found if m["item_id"] == item_id] == [least] * (least <= 0.2 * size + 1e-9)
    assert near >= 40


def test_short_items_with_signs_behind_them():
    held = decontam.Items([(1, b"a shorter item"), (2, b"short item")])
    found = held.found([b"see a shorter item. there", b"in a shortet itm of", b"no such thing"])
    assert [[m["item_id"] for m in some] for some in found] == [[1], [1], []]


def test_contamination_of_whole_tables(spark):
    items = [(1, prose(30)), (2, prose(40)), (3, "Short  Item"), (4, None), (5, ""), (None, prose(20)), (6, prose(8)), (2, prose(12))]
    df_items = spark.createDataFrame(items, "item_id long, text string")
    long_text = prose(30_000) + " " + items[0][1].upper() + " " + prose(100)
    rows = [(1, long_text), (2, prose(80)), (3, f"x {edited(items[1][1], 0.04)}\n y"), (4, "a short item, here"), (5, "short item"),
            (6, None), (7, ""), (None, items[6][1]), (5, "short item"), (8, items[7][1] + " tail")]
    docs = spark.createDataFrame([(i, t, "s", 1.0) for i, t in rows], "doc_id long, text string, item_id string, similarity double")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(docs, df_items).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (None, 6), (8, 2)}
    clean = decontam.keep_clean(docs, df_items)
    assert clean.schema == docs.schema and sorted(r["doc_id"] for r in clean.collect()) == [2, 4, 6, 7]
    assert decontam.matches(docs.limit(0), df_items).count() == 0
    assert decontam.matches(docs, df_items.limit(0)).count() == 0


def brute_phrases(text):
    import re
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for label, phrase in licenses.PHRASES for p in [phrase.split()]
              for i in range(len(words)) if words[i:i + len(p)] == p]
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({x for _, x in places})))


def test_license_scan(spark):
    long_text = f"{prose(5000)} Under the MIT License; {prose(5000)} apache LICENSE, version 2 cc-by-nc"
    rows = [(1, "under the mit license under the MIT license"), (2, "CC BY-NC"), (3, None), (4, ""), (5, "--- ..."), (6, long_text),
            (7, "Licensed under the Apache extra License Version 2.0"), (8, "under the mit licence"), (None, "cc by nc"),
            (2, "CC BY-NC"), (2, "other text under the MIT license"), (9, "This work is licensed under the GNU General Public License, version 3.")]
    df = spark.createDataFrame([(i, t, "s", 3) for i, t in rows], "doc_id long, text string, labels string, n_words int")
    got = licenses.scan(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = [(i, *brute_phrases(t)) for i, t in rows]
    assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got],
                  key=key) == sorted(want, key=key)
    labels = {r["doc_id"]: r["labels"] for r in got}
    assert labels[7] == "apache-2" and labels[9] == "gpl-3" and labels[6] == "apache-2,cc-by-nc,mit"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(df.limit(0)).count() == 0


def nearest_brute(vectors, queries, top):
    out = set()
    for q, x in queries.items():
        scores = sorted(((-float(np.dot(np.float32(x).astype(float), np.float32(v).astype(float))), i)
                         for i, v in vectors.items() if i != q and len(v) == len(x)))
        out |= {(q, rank + 1, i) for rank, (_, i) in enumerate(scores[:top])}
    return out


def test_nearest_with_ties_and_bad_vectors(spark):
    r = np.random.default_rng(1)
    vectors = {i: r.normal(size=8).round(2).tolist() for i in range(300)}
    vectors |= {i: [1.0] + [0.0] * 7 for i in range(300, 500)}
    bad = {600: None, 601: [0.0] * 8, 602: [float("nan")] * 8, 603: [float("inf")] + [0.0] * 7, 604: [None] + [1.0] * 7, 605: []}
    other = {700: [1.0, 2.0], 720: [2.0, 1.0]}
    rows = [(i, v, 1) for i, v in {**vectors, **bad, **other}.items()] + [(None, [1.0] * 8, 1), (5, vectors[5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = graph.nearest(df, df.where("vec_id % 20 = 0"), shard_vectors=150).collect()
    good = {**vectors, **other}
    want = nearest_brute(good, {i: v for i, v in good.items() if i % 20 == 0}, 20)
    found = {(x["query_id"], x["rank"], x["vec_id"]) for x in got}
    assert len(found & want) / len(want) >= 0.97
    assert {x for x in found if x[0] == 300} == {x for x in want if x[0] == 300}
    assert {x for x in found if x[0] >= 700} == {(700, 1, 720), (720, 1, 700)}
    assert graph.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    d = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    vectors = dict(zip(t["vec_id"].tolist(), t["embedding"]))
    got = {(x["query_id"], x["vec_id"]) for x in suite.vector_graph(spark, d).collect()}
    want = {(q, i) for q, _, i in nearest_brute(vectors, {i: v for i, v in vectors.items() if i % 20 == 0}, 20)}
    assert len(got & want) / len(want) >= 0.95


def test_few_places_are_looked_up_in_each_table(monkeypatch):
    draw, asked, find = random.Random(9), [], decontam.Lookup.find
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6))) for _ in range(150)]
    items = [(i, " ".join(draw.choices(words, k=40)).encode()) for i in range(100)]
    pieces, text = decontam.Items(items).pieces, " ".join(draw.choices(words, k=8000)).encode()
    monkeypatch.setattr(decontam.Lookup, "find", lambda self, keys: asked.append(len(keys)) or find(self, keys))
    for some in pieces:
        list(some.met(np.frombuffer(text, np.uint8)))
    print(sum(asked) / len(text))
    assert sum(asked) < 6 * len(text)
