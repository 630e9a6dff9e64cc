"""Nearest neighbours by inner product from robust-pruned directed graphs, one per shard.

Vectors are dealt to shards by a hash of their id.  Within a shard equal vectors are one node; a
further coordinate turns the largest inner product into the smallest distance.  Nodes are inserted
in growing batches: a beam search from the node nearest the mean proposes neighbours, relaxed
distance pruning (``ALPHA``) keeps diverse edges, and reverse edges are pruned alike.  Queries are
laid out in blocks; every block searches every shard with a beam, candidates are scored again in
double precision on the original vectors, and the best of all shards are kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabulens.llm.common import stored

DEGREE = 28
ROOM = 14  # further edges a node may gather before it is pruned to DEGREE again
BEAM = 96
BUILD_BEAM = 64
ALPHA = 1.2
SHARD_VECTORS = 8192
BLOCK_QUERIES = 512
TOP = 20


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Graph:
    """Vectors (augmented, float32) with out-edges; ``-1`` fills rows of fewer edges."""

    def __init__(self, points: np.ndarray, edges: np.ndarray, entry: int):
        self.points, self.edges, self.entry = points, edges, entry

    @classmethod
    def build(cls, points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> Graph:
        n = len(points)
        graph = cls(points, np.full((n, degree + ROOM), -1, np.int32), 0)
        if n <= 1:
            return graph
        graph.entry = int(np.argmin(squared(points, points.mean(axis=0))))
        order = np.random.default_rng(11).permutation(n)
        order = np.concatenate([[graph.entry], order[order != graph.entry]])
        at, width = 1, 1
        while at < n:
            batch = order[at:at + width]
            seen, near = graph.search(points[batch], beam)
            for node, ids, distances in zip(batch.tolist(), seen, near):
                keep = ids >= 0
                graph._prune(node, ids[keep], distances[keep], alpha)
            graph._reverse(batch, alpha)
            at += len(batch)
            width = min(max(width * 2, 1), 256, max(at // 4, 1))
        return graph

    def _prune(self, node: int, ids: np.ndarray, distances: np.ndarray, alpha: float) -> None:
        """Keep near candidates that no kept one is much nearer to."""
        own = ids != node
        ids, distances = ids[own], distances[own]
        ids, first = np.unique(ids, return_index=True)
        distances = distances[first]
        order = np.lexsort((ids, distances))
        ids, distances = ids[order], distances[order]
        points = self.points[ids]
        length = np.einsum("ij,ij->i", points, points)
        between = alpha * alpha * (length[:, None] + length - 2 * (points @ points.T))
        degree, kept, alive = self.edges.shape[1] - ROOM, [], np.ones(len(ids), bool)
        at = 0
        while len(kept) < degree and at < len(ids):
            kept.append(at)
            alive &= between[at] > distances
            alive[:at + 1] = False
            step = int(np.argmax(alive))
            if not alive[step]:
                break
            at = step
        self.edges[node] = -1
        self.edges[node, :len(kept)] = ids[kept]

    def _reverse(self, batch: np.ndarray, alpha: float) -> None:
        """Edges back to the nodes of a batch, pruned where a node has too many."""
        targets = self.edges[batch]
        sources = np.repeat(batch, targets.shape[1]).reshape(targets.shape)
        valid = targets >= 0
        targets, sources = targets[valid], sources[valid]
        order = np.argsort(targets, kind="stable")
        targets, sources = targets[order], sources[order]
        nodes, starts = np.unique(targets, return_index=True)
        for node, new in zip(nodes.tolist(), np.split(sources, starts[1:])):
            row = self.edges[node]
            old = row[row >= 0]
            merged = np.unique(np.concatenate([old, new]))
            if len(merged) <= len(row):
                row[:] = -1
                row[:len(merged)] = merged
            else:
                self._prune(node, merged, squared(self.points[merged], self.points[node]), alpha)

    def search(self, queries: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, squared distances)`` of the ``beam`` nearest nodes found for each query, nearest first.

        All queries walk at once; ids are -1 where fewer were found."""
        m, n = len(queries), len(self.points)
        ids = np.full((m, beam), -1, np.int64)
        far = np.full((m, beam), np.inf, np.float32)
        open_ = np.zeros((m, beam), bool)
        met = np.zeros((m, n), bool)
        ids[:, 0], open_[:, 0] = self.entry, True
        far[:, 0] = squared(queries, self.points[self.entry])
        met[:, self.entry] = True
        active = np.arange(m)
        while len(active):
            pick = np.argmax(open_[active], axis=1)
            current = ids[active, pick]
            open_[active, pick] = False
            edges = self.edges[current]
            fresh = edges >= 0
            fresh &= ~met[active[:, None], edges]
            rows, columns = np.nonzero(fresh)
            if len(rows):
                new, who = edges[rows, columns], active[rows]
                met[who, new] = True
                distance = np.full(edges.shape, np.inf, np.float32)
                distance[rows, columns] = squared(self.points[new], queries[who])
                some = np.unique(rows)
                part = active[some]
                all_far = np.concatenate([far[part], distance[some]], axis=1)
                all_ids = np.concatenate([ids[part], np.where(fresh, edges, -1)[some]], axis=1)
                all_open = np.concatenate([open_[part], fresh[some]], axis=1)
                best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
                far[part] = np.take_along_axis(all_far, best, axis=1)
                ids[part] = np.take_along_axis(all_ids, best, axis=1)
                open_[part] = np.take_along_axis(all_open, best, axis=1)
            active = active[open_[active].any(axis=1)]
        return ids, far


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` without vectors that are null, empty, zero or hold null or non-finite values."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(
        "vec_id", F.col("embedding").cast("array<float>").alias("embedding")) \
        .where(finite & F.exists("embedding", lambda x: x != 0))


INDEX = "shard int, n_nodes int, dimensions int, entry int, points binary, edges binary, members binary, sizes binary"


def index(vectors: DataFrame, shards: int, top: int = TOP) -> DataFrame:
    """One row per shard and vector length: nodes, edges and the ids that share a node.

    Of equal vectors only the ``top + 1`` smallest ids of a shard can be among the nearest (ties go to
    the smaller id), so only those are kept with the node."""
    placed = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"),
                            F.size("embedding").alias("dimensions"), "vec_id", "embedding")

    def make(table: pa.Table) -> pa.Table:
        data = table.column("embedding").combine_chunks()
        size = table.column("dimensions")[0].as_py()
        points = np.asarray(data.flatten(), np.float32).reshape(-1, size) + np.float32(0)
        ids = np.asarray(table.column("vec_id"), np.int64)
        nodes, node_of = np.unique(points, axis=0, return_inverse=True)
        order = np.lexsort((ids, node_of.ravel()))
        ids, node_of = ids[order], node_of.ravel()[order]
        first = np.searchsorted(node_of, np.arange(len(nodes)))
        keep = np.arange(len(ids)) - first[node_of] <= top
        lengths = np.einsum("ij,ij->i", nodes.astype(float), nodes.astype(float))
        extra = np.sqrt(np.maximum(lengths.max() - lengths, 0))[:, None]
        graph = Graph.build(np.concatenate([nodes, extra.astype(np.float32)], axis=1))
        return pa.Table.from_pylist([{
            "shard": table.column("shard")[0].as_py(), "n_nodes": len(nodes), "dimensions": size, "entry": graph.entry,
            "points": graph.points.tobytes(), "edges": graph.edges.tobytes(), "members": ids[keep].tobytes(),
            "sizes": np.bincount(node_of[keep], minlength=len(nodes)).astype(np.int64).tobytes()}],
            pa.schema([("shard", pa.int32()), ("n_nodes", pa.int32()), ("dimensions", pa.int32()), ("entry", pa.int32()),
                       *[(c, pa.binary()) for c in ("points", "edges", "members", "sizes")]]))
    return placed.groupBy("shard", "dimensions").applyInArrow(make, INDEX)


def _search_rows(top: int, beam: int):
    def work(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                n, size = row["n_nodes"], row["dimensions"]
                points = np.frombuffer(row["points"], np.float32).reshape(n, size + 1)
                graph = Graph(points, np.frombuffer(row["edges"], np.int32).reshape(n, -1), row["entry"])
                members, sizes = np.frombuffer(row["members"], np.int64), np.frombuffer(row["sizes"], np.int64)
                first = np.cumsum(sizes) - sizes
                queries = np.frombuffer(row["queries"], np.float32).reshape(-1, size)
                wide = np.concatenate([queries, np.zeros((len(queries), 1), np.float32)], axis=1)
                found, _ = graph.search(wide, beam)
                who, where = np.nonzero(found >= 0)
                nodes = found[who, where]
                # the measure itself, in double precision on the original vectors
                score = np.einsum("ij,ij->i", queries[who].astype(float), points[nodes, :size].astype(float))
                each = sizes[nodes]
                who, score = np.repeat(who, each), np.repeat(score, each)
                inside = np.arange(len(who)) - np.repeat(np.cumsum(each) - each, each)
                ids = members[np.repeat(first[nodes], each) + inside]
                names = np.frombuffer(row["query_ids"], np.int64)[who]
                keep = names != ids
                names, ids, score = names[keep], ids[keep], score[keep]
                order = np.lexsort((ids, -score, names))
                names, ids, score = names[order], ids[order], score[order]
                start = np.searchsorted(names, names)
                best = np.arange(len(names)) - start < top
                yield pa.RecordBatch.from_arrays([pa.array(names[best]), pa.array(ids[best]), pa.array(score[best])],
                                                 ["query_id", "vec_id", "score"])
    return work


def nearest(vectors: DataFrame, queries: DataFrame, top: int = TOP, beam: int = BEAM,
            shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` nearest vectors found for each query by inner product.

    A vector is no neighbour of the query with its own id.  Vectors that are null, empty, zero or hold
    null or non-finite values take no part; a query only meets vectors of its own length.  With fewer
    candidates all are returned; ties go to the smaller id.  Repeated ids count once, with the
    greatest of their vectors.  Empty tables give no rows."""
    unique = lambda df: valid_vectors(df).groupBy("vec_id").agg(F.max("embedding").alias("embedding"))
    pool, asked = unique(vectors), unique(queries)
    shards = max(-(-pool.count() // shard_vectors), 1)
    built = stored(index(pool, shards, top))
    blocks = max(-(-asked.count() // BLOCK_QUERIES), 1)

    def pack(table: pa.Table) -> pa.Table:
        size = table.column("dimensions")[0].as_py()
        return pa.table({"block": table.column("block")[:1], "dimensions": table.column("dimensions")[:1],
                         "query_ids": pa.array([np.asarray(table.column("vec_id"), np.int64).tobytes()], pa.binary()),
                         "queries": pa.array([np.asarray(table.column("embedding").combine_chunks().flatten(), np.float32)
                                              .reshape(-1, size).tobytes()], pa.binary())})
    packed = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"),
                          F.size("embedding").alias("dimensions"), "vec_id", "embedding") \
        .groupBy("block", "dimensions").applyInArrow(pack, "block int, dimensions int, query_ids binary, queries binary")
    # every block of the stated queries meets every shard
    meet = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).join(built, ["shard", "dimensions"])
    found = meet.drop("block").repartition("shard", F.xxhash64("query_ids")) \
        .mapInArrow(_search_rows(top, beam), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select("query_id", "rank", "vec_id", "score")
