import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tabulens.llm import simhash
from tabulens.llm.common import stored
from tabulens.llm.components import components


def brute_fingerprint(text, words=4):
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    shingles = [b" ".join(tokens[i:i + words]) for i in range(max(len(tokens) - words + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits):
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


def texts():
    rng, vocabulary = random.Random(5), [f"w{i}" for i in range(400)]
    out = {}
    for i in range(60):
        out[i] = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300)))
    for i in range(60, 120):  # copies with one word changed, of few originals
        words = out[i % 7 + 40].split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out[i] = " ".join(words)
    out |= {200: "", 201: None, 202: "  \n ", 203: "One", 204: "one", 205: "a b c", 206: "ÄB c\xa0d É e f g h " * 400}
    return out


def test_fingerprint_and_components_agree_with_brute_force(spark):
    docs = texts()
    rows = [(i, t, "x", 1) for i, t in docs.items()] + [(3, docs[3], "again", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = brute_components(fps, 4)
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_shingle_hash_is_the_one_of_spark(spark):
    want = spark.range(1).select(F.xxhash64(F.lit("one two three four")).alias("h")).first()["h"]
    assert simhash.fingerprint(b"One two THREE four", 4) == [want % (1 << 64)]


def test_dense_group_of_fingerprints(spark):
    rng, base = random.Random(2), 0x0123456789ABCDEF
    fps = {base}
    while len(fps) < 400:
        x = base
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = spark.createDataFrame([(signed[f], 1 + (f == base)) for f in fps], "fp long, n long")
    got = {r["node"]: r["root"] for r in simhash.fingerprint_components(nodes).collect()}
    want = brute_components({signed[f]: f for f in fps}, 4)
    assert {f: got.get(f, f) for f in want} == want


def test_cells_are_not_broadcast(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(1200)}
    fps |= {f ^ 1 << rng.randrange(64) for f in sorted(fps)[:400]}
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    nodes = stored(spark.createDataFrame([(s, 1) for s in signed.values()], "fp long, n long"))
    limit, before = "spark.sql.maxBroadcastTableSize", spark.conf.get("spark.sql.maxBroadcastTableSize")
    # the nodes fit, 35 times as many rows do not
    spark.conf.set(limit, 3 << 20)
    try:
        got = {r["node"]: r["root"] for r in simhash.fingerprint_components(nodes).collect()}
    finally:
        spark.conf.set(limit, before)
    want = brute_components({signed[f]: f for f in fps}, 4)
    assert {f: got.get(f, f) for f in want} == want


@pytest.mark.parametrize("bits", [1, 4])
def test_every_near_pair_shares_a_cell(bits):
    rng, masks = random.Random(bits), [m % (1 << 64) for m in simhash.blocks(bits)]
    even = 0x5555555555555555
    counts = lambda x: ((x & (x >> 1) & even) << 1) | ((x ^ (x >> 1)) & even)
    assert sum(masks) == (1 << 64) - 1
    for _ in range(500):
        a = rng.getrandbits(64)
        b = a
        for _ in range(bits):
            b ^= 1 << rng.randrange(64)
        assert sum(counts(a) & m == counts(b) & m for m in masks) >= 3


def test_keep_one_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "other words stand here now", None),
                                (None, "a b c d e f", "t"), (4, None, "u"), (5, "", "v")],
                               "doc_id long, text string, source string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4]
    none = simhash.near_duplicates(df.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "fp", "component_id"]


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}


def test_families_link_by_any_fingerprint(spark):
    rng, vocabulary = random.Random(9), [f"w{i}" for i in range(900)]
    docs = {i: [rng.choice(vocabulary) for _ in range(150)] for i in range(30)}
    for i in range(30, 60):
        docs[i] = list(docs[i - 30])
        docs[i][rng.randrange(150)] = "changed"
    texts = {i: " ".join(w) for i, w in docs.items()}
    fps = {i: simhash.fingerprint(t.encode(), 4, 3) for i, t in texts.items()}
    parent = {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in fps:
        for j in fps:
            if i < j and any(bin(a ^ b).count("1") <= 4 for a, b in zip(fps[i], fps[j])):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = simhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), families=3)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: find(i) for i in fps}
    assert sum(find(i) == i - 30 for i in range(30, 60)) >= 20
