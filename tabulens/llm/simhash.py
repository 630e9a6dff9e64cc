"""Near-duplicate documents by SimHash fingerprints.

A fingerprint is mapped to the bit counts of its 2-bit segments.  The Manhattan distance of two
such vectors never exceeds the Hamming distance of the fingerprints, so with ``k`` bits allowed and
``k + 3`` blocks of segments at least three blocks of a linked pair have equal counts: the cells of
a grid over three blocks, one grid for each choice, hold every linked pair.  Candidates are compared
by the total bit count (again a lower bound) and then exactly.

Equal fingerprints are one node.  Within a cell all nodes near its most frequent one link to that
one alone; pairs are compared only across the components found so far, so a large group of near
copies gives a number of links in proportion to its size.

Spark takes the exploded cells to be as small as their nodes and would broadcast them, all grids at
once; the joins by cell are therefore asked to be sort-merge joins."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tabulens.llm.common import map_rows, stored, text_bytes
from tabulens.llm.components import components

SEED = 42
SHINGLES_AT_ONCE = 1 << 16
LANES = np.arange(8, dtype=np.int64) * 256
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
SEGMENT_BITS = 2
ALIKE_BLOCKS = 3


def fingerprint(text: bytes, words: int, families: int = 1) -> list[int]:
    """SimHashes of the word shingles of a text, one per family; zero without words.

    The first family uses the shingle hashes themselves, the others scrambled ones."""
    tokens = text.lower().split()
    if not tokens:
        return [0] * families
    joined = b" ".join(tokens)
    n = max(len(tokens) - words + 1, 1)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts, stops = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    digest, seen = xxhash.xxh64_intdigest, np.zeros((families, 2048), np.int64)
    for lo in range(0, n, SHINGLES_AT_ONCE):
        spans = zip(starts[lo:lo + SHINGLES_AT_ONCE], stops[lo:lo + SHINGLES_AT_ONCE])
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        for family in range(families):
            # how often each value stands in each of the eight bytes; bit counts follow from that
            seen[family] += np.bincount((hashes.view(np.uint8).reshape(-1, 8) + LANES).ravel(), minlength=2048)
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
    return [int(np.packbits(2 * (s.reshape(8, 256) @ BITS_OF_BYTE).ravel() > n, bitorder="little").view("<u8")[0])
            for s in seen]


def fingerprints(docs: DataFrame, words: int = 4, families: int = 1) -> DataFrame:
    """``(doc_id, fp, fp1 ...)`` of every row: 64 bits as a signed long. Null text counts as empty."""
    names = ["fp", *[f"fp{i}" for i in range(1, families)]]

    def work(batches):
        for batch in batches:
            found = np.array([fingerprint(x, words, families) for x in text_bytes(batch.column(1))],
                             np.uint64).reshape(-1, families).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[:, i]) for i in range(families)]],
                                             ["doc_id", *names])
    return map_rows(docs, ["doc_id", "text"],
                    f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in names), work)


def segment_counts(fp: str = "fp") -> Column:
    """The bit counts of the 2-bit segments, packed in the same 64 bits."""
    x, y, even = F.col(fp), F.shiftrightunsigned(fp, 1), F.lit(0x5555555555555555)
    return F.shiftleft(x.bitwiseAND(y).bitwiseAND(even), 1).bitwiseOR(x.bitwiseXOR(y).bitwiseAND(even))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocks(bits: int) -> list[int]:
    """Masks of ``bits + 3`` blocks of whole segments."""
    n, segments = bits + ALIKE_BLOCKS, 64 // SEGMENT_BITS
    edges = [round(i * segments / n) * SEGMENT_BITS for i in range(n + 1)]
    return [_signed(sum(1 << j for j in range(a, b))) for a, b in zip(edges, edges[1:])]


def cells(nodes: DataFrame, bits: int) -> DataFrame:
    """Every node ``(fp, ...)`` in its cell of each grid: ``(grid, cell, fp, ...)``."""
    masks = blocks(bits)
    keys = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("_counts").bitwiseAND(F.lit(sum(masks[j] for j in choice)))
                              .alias("cell")) for i, choice in enumerate(combinations(range(len(masks)), ALIKE_BLOCKS))])
    rest = nodes.columns
    return nodes.withColumn("_counts", segment_counts()).select(*rest, F.explode(keys).alias("_key")) \
        .select("_key.grid", "_key.cell", *rest)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def stars(nodes: DataFrame, bits: int) -> DataFrame:
    """Links of nodes ``(fp, n)`` to the most frequent node of a cell."""
    placed = cells(nodes, bits)
    centres = placed.groupBy("grid", "cell").agg(F.max(F.struct("n", "fp")).alias("top"), F.count(F.lit(1)).alias("size")) \
        .where("size > 1").select("grid", "cell", F.col("top.fp").alias("centre"))
    a, b = placed.alias("a"), centres.alias("b").hint("merge")
    return a.join(b, (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell"))
                  & (F.col("fp") != F.col("centre")) & (_apart("fp", "centre") <= bits)).select("fp", "centre").distinct()


def fingerprint_components(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """``(node, root)`` over distinct fingerprints ``nodes (fp, n)``; roots and unlinked nodes are left out."""
    first = stored(components(stars(nodes, bits)))
    parts = stored(nodes.join(first, nodes["fp"] == first["node"], "left").select("fp", F.coalesce("root", "fp").alias("part")))
    placed = cells(parts, bits)
    a, b = placed.alias("a"), placed.alias("b").hint("merge")
    across = a.join(b, (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell"))
                    & (F.col("a.part") < F.col("b.part")) & (_apart("a.fp", "b.fp") <= bits)
                    & (F.abs(F.bit_count("a.fp") - F.bit_count("b.fp")) <= bits)) \
        .select(F.col("a.part").alias("x"), F.col("b.part").alias("y")).distinct()
    return components(first.select(F.col("node").alias("x"), F.col("root").alias("y")).union(across))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 4, families: int = 1) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row: documents are linked if the fingerprints of one family
    differ in at most ``bits`` bits, and ``component_id`` is the smallest id reachable.

    One fingerprint misses many pairs that are a little further apart; with several independent
    families a pair is linked if any of them brings it near.  Empty and null texts have fingerprint
    zero, linked like any other.  Repeated rows get equal results; rows with a null id link but name
    no component.  An empty table gives no rows."""
    marks = stored(fingerprints(docs, words, families))
    nodes = stored(marks.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")))
    roots = fingerprint_components(nodes, bits)
    if families > 1:
        # documents with one root in any family are linked through their first fingerprints
        shared = roots.select(F.col("node").alias("x"), F.col("root").alias("y"))
        for family in range(1, families):
            pairs = stored(marks.groupBy("fp", F.col(f"fp{family}").alias("other")).agg(F.count(F.lit(1)).alias("n")))
            near = fingerprint_components(pairs.groupBy(F.col("other").alias("fp")).agg(F.sum("n").alias("n")), bits)
            classes = pairs.join(near, pairs["other"] == near["node"], "left").select("fp", F.coalesce("root", "other").alias("class"))
            least = classes.groupBy("class").agg(F.min("fp").alias("least"))
            shared = shared.union(classes.join(least, "class").where("fp <> least").select("fp", "least"))
        roots = stored(components(shared))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left") \
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(joined.join(smallest, "root").select("fp", "component_id"))
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 4, bits: int = 4, families: int = 3) -> DataFrame:
    """The documents without the near copies: of each group the one with the smallest id stays.

    Rows that share an id are one document; rows without an id stay."""
    copies = near_duplicates(docs, words, bits, families).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
