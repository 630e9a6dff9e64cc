import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tabulens.llm import common, nearcopies

rng = random.Random(8)


def fresh(n):
    return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]


def near_copy(words, similarity):
    """A copy that shares as few five-word shingles as the similarity allows; the sets have one size."""
    n = len(words) - 4
    lost, out, at = n - int(np.ceil(2 * similarity / (1 + similarity) * n - 1e-9)), list(words), 4
    while lost >= 5 and at < len(words) - 5:
        out[at], lost, at = f"x{rng.randrange(10 ** 9)}", lost - 5, at + 5
    for i in range(lost):
        out[len(out) - 1 - i] = f"y{rng.randrange(10 ** 9)}"
    return out


def jaccard(a, b):
    a, b = ({tuple(x[i:i + 5]) for i in range(max(len(x) - 4, 1))} for x in (a, b))
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def planted(spark):
    rows, pairs = [], {}
    for number in range(450):
        goal = (0.8, 0.85, 0.9)[number % 3]
        words = fresh(rng.choice([14, 24, 40, 60, 120, 400, 1200]))
        copy = near_copy(words, goal)
        rows += [(2 * number, " ".join(words)), (2 * number + 1, " ".join(copy))]
        pairs[2 * number + 1] = goal, jaccard(words, copy)
    # just beyond the threshold: clean documents stay
    for number in range(450, 510):
        words = fresh(200)
        copy = near_copy(words, 0.77)
        rows += [(2 * number, " ".join(words)), (2 * number + 1, " ".join(copy))]
        pairs[2 * number + 1] = 0.77, jaccard(words, copy)
    rows += [(5000, ""), (5001, None), (None, rows[0][1]), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert kept.schema == docs.schema
    return pairs, [r["doc_id"] for r in kept.collect()]


@pytest.mark.parametrize("goal", [0.8, 0.85, 0.9])
def test_planted_copies_go(planted, goal):
    pairs, kept = planted
    asked = [i for i, (g, j) in pairs.items() if g == goal and j >= 0.8]
    share = sum(i not in kept for i in asked) / len(asked)
    print(goal, len(asked), share)
    assert len(asked) >= 100 and share >= 0.95


def test_clean_documents_stay(planted):
    pairs, kept = planted
    assert all(i in kept for i, (_, j) in pairs.items() if j < 0.8)
    assert all(2 * (i // 2) in kept for i in pairs) and kept.count(None) == 1
    assert 5000 in kept and 5001 not in kept


def test_cells_are_the_segment_bit_counts(spark):
    sims = [bytes(rng.randrange(256) for _ in range(32)) for _ in range(20)]
    # both bits of a segment swapped: another fingerprint with the same counts
    sims.append(bytes((b & 0xAA) >> 1 | (b & 0x55) << 1 for b in sims[0]))
    nodes = spark.createDataFrame([(i, i, 100, 100, bytearray(s), []) for i, s in enumerate(sims)],
                                  "node long, part long, size long, shared long, sim binary, least array<long>")
    sampled = nearcopies.grids()
    found = {}
    for r in nearcopies.cells(nodes, sampled).collect():
        found.setdefault(r["node"], []).append(r["cell"])
    assert all(len(set(c)) == len(sampled) for c in found.values()) and sorted(found[0]) == sorted(found[20])

    def counts(sim, grid):
        bits = [sim[i // 8] >> i % 8 & 1 for i in range(256)]
        return tuple(bits[2 * j] + bits[2 * j + 1] for j in grid)
    for a in range(20):
        for b in range(a):
            assert len(set(found[a]) & set(found[b])) == sum(counts(sims[a], g) == counts(sims[b], g) for g in sampled)


def test_copies_with_own_changes_make_no_pairs(spark):
    base, rows = fresh(150), []
    for i in range(80):
        own = list(base)
        for k in range(4):
            own[30 * k + rng.randrange(10, 20)] = f"own{i}x{k}"
        rows.append((i, " ".join(own)))
    # of two with the same changes one differs from the other by a word
    rows += [(80, rows[7][1] + " end"), (81, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = nearcopies.sketches(docs).withColumns({"part": nearcopies.F.col("node"), "first_id": nearcopies.F.col("doc_id")})
    sets = nearcopies.sets_of(marks.where("doc_id <> 81").select("node"), docs, marks, 5)
    nodes = marks.where("doc_id <> 81").join(nearcopies.shared_members(sets), "node", "left") \
        .withColumn("shared", nearcopies.F.expr("size - coalesce(alone, 0)"))
    names = {r["node"]: r["doc_id"] for r in marks.collect()}
    border = nearcopies.bordering(nodes, nearcopies.grids(), 0.8).count()
    pairs = {tuple(sorted((names[r["x"]], names[r["y"]]))) for r in nearcopies.across_pairs(nodes, nearcopies.grids(), 0.8).collect()}
    assert border > 60 and pairs == {(7, 80)}
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
    assert found[80] == 7 and len(found) == 82


def test_tasks_hold_the_sets_of_few_texts_at_once(monkeypatch):
    docs = SimpleNamespace(dtypes=[("doc_id", "bigint")])
    monkeypatch.setattr(nearcopies, "map_rows", lambda df, columns, schema, work: work)
    texts = [" ".join(f"w{i * j}" for j in range(20_000)) for i in range(1, 31)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(32)), pa.array(texts)], ["doc_id", "text"])
    parts = list(nearcopies.sketches(docs)(iter([batch])))
    assert sum(p.num_rows for p in parts) == 32 and max(p.num_rows for p in parts) < 12
    got = pa.Table.from_batches(parts).to_pydict()
    assert got["doc_id"] == list(range(32))
    sets = [nearcopies.shingles((t or "").encode()) for t in texts]
    assert got["node"] == [nearcopies.node_of(s) for s in sets] and got["sim"] == [nearcopies.simhash(s) for s in sets]


def test_sets_are_compared_and_their_members_read_in_parts():
    frame = SimpleNamespace(mapInArrow=lambda work, schema: work)
    frame.select = frame.join = lambda *a: frame
    sets = [np.arange(i, i + 10_000, dtype=np.uint64) for i in range(0, 60_000, 1000)]
    keys = pa.array([s.tobytes() for s in sets], pa.binary())
    x = pa.array(range(60))
    compared = list(nearcopies.alike(frame, frame, 0.8)(iter([pa.RecordBatch.from_arrays([x, x, keys, keys.take(pa.array([0] * 60))],
                                                                                         ["x", "y", "a", "b"])])))
    # i thousand of ten thousand members differ: (10 - i) / (10 + i) is 0.8 or more for 0 and 1
    assert pa.Table.from_batches(compared).column("x").to_pylist() == [0, 1] and len(compared) > 3



def test_arrow_batches_follow_bytes_while_sets_are_compared(spark, monkeypatch):
    limits = []
    stored = nearcopies.stored
    monkeypatch.setattr(nearcopies, "stored", lambda df: limits.append(spark.conf.get(common.BATCH_BYTES)) or stored(df))
    before = spark.conf.get(common.BATCH_BYTES)
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words")], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3} and set(limits) == {str(4 << 20)} and spark.conf.get(common.BATCH_BYTES) == before

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])
    wide = spark.range(0, 4000, 1, 1).selectExpr("repeat('0123456789', 1000) AS text")
    with common.batches_of(spark):
        sizes = [r["n"] for r in wide.mapInArrow(rows, "n long").collect()]
    assert max(sizes) < 6 << 20 and sum(sizes) > 40_000_000


def test_groups_of_copies_that_share_changes_are_joined_without_all_pairs(spark, monkeypatch):
    draw, base, texts = random.Random(3), fresh(150), []
    # changes from a small stock: three of them are a copy still, four are one of some copies only
    stock = [(at, f"new{at}x{k}") for at in range(8, 146, 11) for k in range(2)]

    def changed(changes):
        words = list(base)
        for at, word in changes:
            words[at] = word
        return " ".join(words)
    for i in range(90):
        some = [draw.choice(stock[k:k + 2]) for k in draw.sample(range(0, len(stock), 2), 4)]
        texts += [changed(some[:1 + i % 3]), changed(some)]
    # six changes of its own: a copy of none
    texts += [changed([])] + [changed([(at, f"own{i}x{at}") for at in range(10, 76, 11)]) for i in range(20)]
    sets = [set(nearcopies.shingles(t.encode()).tolist()) for t in texts]
    linked = [[b for b in range(len(texts)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] for a in range(len(texts))]
    root = list(range(len(texts)))
    for _ in texts:
        root = [min(root[b] for b in some) for some in linked]
    compared, alike = [], nearcopies.alike
    monkeypatch.setattr(nearcopies, "alike", lambda pairs, *rest: compared.append(pairs.count()) or alike(pairs, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()}
    print(compared, len(texts), len(set(root)))
    assert [found[i] for i in range(len(texts))] == root and len(set(root)) < 60
    assert sum(compared) < 12 * len(texts)


def test_pairs_by_rare_members_are_those_of_brute_force(spark):
    draw, texts = random.Random(4), []
    for _ in range(6):
        base = fresh(draw.choice([3, 12, 30, 90]))
        for _ in range(12):
            words = [w if draw.random() > 0.015 else draw.choice(["one", "two", f"w{draw.randrange(10 ** 9)}"]) for w in base]
            texts.append(" ".join(words[draw.randrange(3):]))
    sets = {nearcopies.node_of(s): s for s in (nearcopies.shingles(t.encode()) for t in texts)}
    frame = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node long, keys binary")
    for similarity in (0.8, 0.6):
        rare = nearcopies.rare_members(frame, similarity).withColumn("part", nearcopies.F.col("node"))
        met = nearcopies.member_pairs(rare, similarity)
        got = {(r["x"], r["y"]) for r in nearcopies.alike(met, frame, similarity).collect()}
        assert got == {(a, b) for a in sets for b in sets if a < b
                       and len(np.intersect1d(sets[a], sets[b])) >= similarity * len(np.union1d(sets[a], sets[b])) - 1e-9}
        assert len(got) > 20
