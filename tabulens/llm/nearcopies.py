"""Near copies by the Jaccard similarity of word shingles: a grid join of SimHashes finds candidates, the sets decide.

A text is the set of its ``words``-word shingles, hashed to 64 bits.  Its SimHash has ``BITS`` bits; at
similarity ``s`` a bit of two sets of one size differs with probability ``acos(2s / (1 + s)) / pi``.
As in ``simhash`` a fingerprint is mapped to the bit counts of its 2-bit segments, and nodes meet in the cells of
grids over some of the segments.  That many bits apart no few grids hold every pair, so each grid samples ``SEGMENTS``
segments, and there are as many grids as the missed share of pairs at the threshold asks for; their number does not
depend on the size of the table.  Sets of few shingles have coarse fingerprints; besides the grids they meet
by the smallest hashes of the set: of two sets at the threshold each has a member of the other among these.

Groups are found first with a few grids, every node being compared with its best centre alone.  Then all grids tell the
nodes that have a near one in another group.  Of these alone the sets are read and searched without loss: in one order of
all members, the rarest first, two sets at the threshold meet at one of their first members, and its places bound what they
can have in common.  Each node is compared with the most central node of another group at each of these members,
and groups so linked are one, until no more are; so copies with changes of their own are not paired with each other.
The pairs that meet and are left across groups are compared.  A pair is linked if the exact similarity of its sets reaches the
threshold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tabulens.llm.common import batches_of, map_rows, small, stored, text_bytes
from tabulens.llm.components import components
from tabulens.llm.simhash import BITS_OF_BYTE, LANES, SEED, SEGMENT_BITS

WORDS = 5
SIMILARITY = 0.8
FAMILIES = 4
BITS = 64 * FAMILIES
MISSED = 0.01
SEGMENTS = 10
STAR_GRIDS = 16
SMALL = 32
# bits that a linked pair may be apart by the number of families compared, four standard deviations beyond the threshold
APART = {2: 36, 4: 64}
NODES_AT_ONCE = 256


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text; a shorter text is one shingle."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    n = max(len(tokens) - words + 1, 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n))


def simhash(hashes: np.ndarray) -> bytes:
    """``BITS`` bits of a set of hashes, one family of 64 after the other."""
    out, hashes = [], hashes.astype("<u8")
    for _ in range(FAMILIES):
        seen = np.zeros(2048, np.int64)
        for lo in range(0, len(hashes), 1 << 16):
            seen += np.bincount((hashes[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8) + LANES).ravel(), minlength=2048)
        out.append(np.packbits(2 * (seen.reshape(8, 256) @ BITS_OF_BYTE).ravel() > len(hashes), bitorder="little").tobytes())
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    return b"".join(out)


def node_of(hashes: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def grids(similarity: float = SIMILARITY) -> np.ndarray:
    """The sampled segments of every grid, one row each."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    # both bits of a segment agree, or both differ and cancel out
    same = ((1 - apart) ** 2 + apart ** 2 / 2) ** SEGMENTS
    n = math.ceil(math.log(MISSED) / math.log(1 - same))
    random = np.random.default_rng(SEED)
    return np.stack([random.choice(BITS // SEGMENT_BITS, SEGMENTS, replace=False) for _ in range(n)])


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, node, size, sim, least)`` of every row; ``least`` are the smallest hashes of a small set."""
    def work(batches):
        for batch in small(batches, 1):
            sets = [shingles(x, words) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([simhash(s) for s in sets], pa.binary()), pa.array([_least(s) for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "node", "size", "sim", "least"])
    return map_rows(docs, ["doc_id", "text"],
                    f"doc_id {dict(docs.dtypes)['doc_id']}, node long, size long, sim binary, least array<long>", work)


def _least(hashes: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    # a set of more than SMALL / similarity members has no partner of SMALL members or fewer
    if len(hashes) > SMALL / similarity:
        return []
    return hashes[:len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1].view(np.int64).tolist()


def cells(nodes: DataFrame, sampled: np.ndarray, families: int = FAMILIES) -> DataFrame:
    """``(cell, node, part, size, shared, s0 ...)``: every node ``(node, part, size, shared, sim, least)`` in its cell of
    each grid, with the given number of fingerprint families; cells of smallest hashes are negative."""
    weights = np.int64(1) << (SEGMENT_BITS * np.arange(sampled.shape[1], dtype=np.int64))
    of_grid = np.arange(len(sampled), dtype=np.int64) << (SEGMENT_BITS * sampled.shape[1])

    def work(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, NODES_AT_ONCE):
                batch = whole.slice(lo, NODES_AT_ONCE)
                sims = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, BITS // 8)
                counts = np.unpackbits(sims, axis=1, bitorder="little").reshape(len(sims), -1, SEGMENT_BITS).sum(2, dtype=np.int64)
                keys = counts[:, sampled] @ weights + of_grid
                least = batch.column(5).to_pylist()
                row = np.concatenate([np.repeat(np.arange(len(sims)), len(sampled)),
                                      np.repeat(np.arange(len(least)), list(map(len, least)))])
                cell = np.concatenate([keys.ravel(), np.array([x for some in least for x in some], np.int64) | np.iinfo(np.int64).min])
                longs, take = sims.view("<i8"), pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), *[batch.column(i).take(take) for i in range(4)],
                     *[pa.array(longs[row, i]) for i in range(families)]],
                    ["cell", "node", "part", "size", "shared", *_PARTS[:families]])
    return nodes.select("node", "part", "size", "shared", "sim", "least").mapInArrow(
        work, "cell long, node long, part long, size long, shared long, " + ", ".join(f"{p} long" for p in _PARTS[:families]))


_PARTS = [f"s{i}" for i in range(FAMILIES)]


def _near(similarity: float, families: int = FAMILIES):
    """Whether two rows ``a`` and ``b`` of a cell can be of one kind: sizes and SimHashes near; small sets by size alone."""
    apart = sum((F.bit_count(F.col(f"a.{p}").bitwiseXOR(F.col(f"b.{p}"))) for p in _PARTS[:families]), F.lit(0))
    return (F.least("a.size", "b.size") >= F.greatest("a.size", "b.size") * similarity - 1e-9) \
        & ((F.col("a.cell") < 0) | (apart <= APART[families]))


def sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``(node, keys)``: the sets of the ``wanted (node)``, from the texts."""
    named = nodes.join(wanted, "node").select(F.col("first_id").alias("doc_id"), "node")

    def work(batches):
        for batch in small(batches, 1):
            sets = [shingles(x, words) for x in text_bytes(batch.column(1))]
            # another text under the same id has another node
            keep = [i for i, (s, n) in enumerate(zip(sets, batch.column(2).to_pylist())) if node_of(s) == n]
            yield pa.RecordBatch.from_arrays([batch.column(2).take(pa.array(keep, pa.int64())),
                                              pa.array([sets[i].tobytes() for i in keep], pa.binary())], ["node", "keys"])
    return stored(docs.select("doc_id", "text").join(named, "doc_id").select("doc_id", "text", "node")
                  .mapInArrow(work, "node long, keys binary").groupBy("node").agg(F.first("keys").alias("keys")))


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs (x, y)`` of nodes whose sets have at least the given Jaccard similarity."""
    def compare(batches):
        for batch in small(batches, 2):
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                common = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                keep.append(common >= similarity * ((len(a) + len(b)) // 8 - common) - 1e-9)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["x", "y"])
    left = sets.select(F.col("node").alias("x"), F.col("keys").alias("a"))
    right = sets.select(F.col("node").alias("y"), F.col("keys").alias("b"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "a", "b").mapInArrow(compare, "x long, y long")


def star_pairs(nodes: DataFrame, sampled: np.ndarray, similarity: float) -> DataFrame:
    """``(x, y)``: every node with the best centre near it; the centre of a cell is the node that shares most places."""
    placed = cells(nodes, sampled)
    crowded = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("mates")).where("mates > 1")
    placed = stored(placed.join(crowded, "cell"))
    ranks = placed.groupBy("node").agg(F.sum("mates").alias("rank"))
    ranked = placed.join(ranks, "node")
    top = ranked.groupBy("cell").agg(F.max(F.struct("rank", "node", "size", *_PARTS)).alias("top")).select("cell", "top.*")
    return placed.alias("a").join(top.alias("b"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.node") != F.col("b.node"))
                                  & _near(similarity)) \
        .groupBy(F.col("a.node").alias("x")).agg(F.max(F.struct(F.col("b.rank"), F.col("b.node").alias("y"))).alias("best")) \
        .select("x", F.col("best.y").alias("y"))


def bordering(nodes: DataFrame, sampled: np.ndarray, similarity: float) -> DataFrame:
    """``(node)``: the nodes that have a near node of another part in a cell; one row each, however many there are.

    Nodes that a few grids tell are not looked up in the others, where they would be told once a cell again."""
    apart = (F.col("a.part") != F.col("b.part")) & (F.col("a.node") != F.col("b.node"))

    def told(some: DataFrame, grids: np.ndarray) -> DataFrame:
        return cells(some, grids, 2).alias("a").join(cells(nodes, grids, 2).alias("b"), (F.col("a.cell") == F.col("b.cell")) & apart
                                                     & _near(similarity, 2), "left_semi").select("node").distinct()
    soon = stored(told(nodes, sampled[:STAR_GRIDS]))
    return soon.union(told(nodes.join(soon, "node", "left_anti"), sampled[STAR_GRIDS:]))


def members_of(sets: DataFrame) -> DataFrame:
    """``(node, size, member)`` of ``sets (node, keys)``."""
    def work(batches):
        for batch in small(batches, 1):
            keys = [np.frombuffer(k, "<i8") for k in batch.column(1).to_pylist()]
            sizes = np.array(list(map(len, keys)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), sizes))), pa.array(np.repeat(sizes, sizes)),
                                              pa.array(np.concatenate([np.zeros(0, "<i8"), *keys]))], ["node", "size", "member"])
    return sets.select("node", "keys").mapInArrow(work, "node long, size long, member long")


def shared_members(sets: DataFrame) -> DataFrame:
    """``(node, alone)``: how many members of a set stand in no other of these ``sets (node, keys)``; sets without any are left out."""
    return members_of(sets).groupBy("member") \
        .agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")).where("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))


def rare_members(sets: DataFrame, similarity: float) -> DataFrame:
    """``(member, node, size, place, rank)``: the first members of every set, from place 1 in one order of all members, the rarest first.

    Members that stand in one set alone have a place but no row.  Two sets at the threshold have a member in common
    among these, as many as the other set may lack and one.  ``rank`` is in how many sets a member of the node stands on average."""
    members, of_node = members_of(sets), Window.partitionBy("node")
    held = members.groupBy("member").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return members.join(held, "member") \
        .withColumn("alone", F.col("size") - F.count(F.lit(1)).over(of_node)) \
        .withColumn("rank", (F.sum("n").over(of_node) + F.col("alone")) / F.col("size")) \
        .withColumn("place", F.col("alone") + F.row_number().over(of_node.orderBy("n", "member"))) \
        .where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1) \
        .select("member", "node", "size", "place", "rank")


def _with_other(rare: DataFrame, *by: str) -> DataFrame:
    """The rows of ``rare`` with the ``other`` of their member: the largest ``by`` of another part. Members of one part have none."""
    best = rare.groupBy("member", "part").agg(F.max(F.struct(*by)).alias("best"))
    two = best.withColumn("k", F.row_number().over(Window.partitionBy("member").orderBy(F.desc("best"), "part"))).where("k <= 2")
    two = stored(two.groupBy("member").agg(*[F.max(F.when(F.col("k") == k, F.struct("part", "best"))).alias(name)
                                             for k, name in ((1, "first"), (2, "second"))]).where("second IS NOT NULL"))
    return rare.join(two, "member") \
        .withColumn("other", F.when(F.col("part") != F.col("first.part"), F.col("first.best")).otherwise(F.col("second.best")))


def member_stars(rare: DataFrame, similarity: float) -> DataFrame:
    """``(x, y)``: every node with the most central node of another part at each of its ``rare_members`` (with ``part``)."""
    return _with_other(rare, "rank", "node", "size") \
        .where(F.least("size", "other.size") >= F.greatest("size", "other.size") * similarity - 1e-9) \
        .select(F.col("node").alias("x"), F.col("other.node").alias("y")).distinct()


def member_pairs(rare: DataFrame, similarity: float) -> DataFrame:
    """``(x, y)``: all nodes of different parts that meet at one of their ``rare_members`` (with ``part``) and can be at the threshold.

    At the first member that two sets have in common neither has more members in common than it has left from there."""
    share = similarity / (1 + similarity)
    left = rare.withColumn("left", F.col("size") - F.col("place") + 1).withColumn("room", F.col("left") / share - F.col("size"))
    # a row that no row of another part has room for makes no pair
    some = stored(_with_other(left, "room").where((F.col("other.room") >= F.col("size") - 1e-6))
                  .select("member", "node", "part", "size", "left"))
    return some.alias("a").join(some.alias("b"), (F.col("a.member") == F.col("b.member")) & (F.col("a.part") < F.col("b.part"))
                                & (F.least("a.left", "b.left") >= (F.col("a.size") + F.col("b.size")) * share - 1e-9)) \
        .select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()


def across_pairs(nodes: DataFrame, sampled: np.ndarray, similarity: float) -> DataFrame:
    """``(x, y)``: near nodes of different parts whose ``shared`` members allow the similarity.

    Two sets have no more members in common than either shares with any other."""
    placed = cells(nodes, sampled)
    enough = F.least("a.shared", "b.shared") * (1 + similarity) >= (F.col("a.size") + F.col("b.size")) * similarity - 1e-9
    return placed.alias("a").join(placed.alias("b"), (F.col("a.cell") == F.col("b.cell")) & (F.col("a.part") < F.col("b.part"))
                                  & enough & _near(similarity)) \
        .select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()


def across_links(first: DataFrame, wanted: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(x, y)``: links that join the groups ``first (node, root)`` wherever sets of ``wanted (node)`` of different groups are
    at the threshold; links inside a group are left out where others join it."""
    rare, known = stored(rare_members(sets, similarity)), first.select(F.col("node").alias("x"), F.col("root").alias("y"))
    parts, tried = first, None
    while True:
        placed = rare.join(stored(wanted.join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("part"))), "node")
        pairs = member_stars(placed, similarity)
        pairs = stored(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"))
        tried = pairs if tried is None else tried.union(pairs)
        links = stored(alike(pairs, sets, similarity))
        if links.isEmpty():
            return known.union(alike(stored(member_pairs(placed, similarity)), sets, similarity))
        known = known.union(links)
        parts = components(known)


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, component_id)`` of every row with an id: texts whose sets have at least the given Jaccard
    similarity are linked, and ``component_id`` is the smallest id reachable.  Texts without words are
    equal.  Repeated rows give repeated results."""
    # texts and sets reach Python in the jobs that run here, none in the result
    with batches_of(docs.sparkSession):
        return _near_copies(docs.where("doc_id IS NOT NULL"), words, similarity)


def _near_copies(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    marks = stored(sketches(docs, words))
    nodes = stored(marks.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"),
                                             F.first("sim").alias("sim"), F.first("least").alias("least")))
    sampled = grids(similarity)
    ends = lambda pairs: pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct()
    whole = nodes.withColumn("shared", F.col("size"))
    stars = stored(star_pairs(whole.withColumn("part", F.col("node")), sampled[:STAR_GRIDS], similarity))
    first = stored(components(alike(stars, sets_of(ends(stars), docs, nodes, words), similarity)))
    parts = stored(whole.join(first, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root"))
    wanted = stored(bordering(parts, sampled, similarity))
    sets = sets_of(wanted, docs, nodes, words)
    roots = components(across_links(first, wanted, sets, similarity))
    joined = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    named = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marks.select("doc_id", "node").join(joined.join(named, "root").select("node", "component_id"), "node") \
        .select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the near copies: of each group the one with the smallest id stays.

    Rows that share an id are one document; rows without an id stay."""
    copies = near_copies(docs, words, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
