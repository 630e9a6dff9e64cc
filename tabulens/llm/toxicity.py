"""Toxicity from the nearest labelled examples.

A bounded sample of labelled rows (``PER_LABEL`` of each label, the smallest hashes) is the example
set.  Terms are words and word beginnings of four and five letters; those that go with a label in
the examples (chi square) span the space, at most ``TERMS`` of them.  Document frequencies are
counted over all documents.  An inverted index holds the unit TF-IDF vectors of the examples in
blocks of 64; the largest weight of each term in each block bounds the cosine of a whole block, so
a search visits blocks in falling order of their bound and stops when no later one can reach the k
best: the neighbours are exact.  Their votes, weighted by cosine, are calibrated by a logistic
curve fitted to the examples themselves, each left out of its own vote."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabulens.llm.common import fold, map_rows, small, text_bytes

PER_LABEL = 2000
TERMS = 2048
CHI_SQUARE = 30.0
NEIGHBOURS = 25
BLOCK = 64
EVIDENCE = 3
BEGINNINGS = (4, 5)
WORDS_KEPT = 100_000
# texts whose terms are counted at once, all of them being kept
COUNTED_BYTES = 1 << 18


def core(word: bytes) -> str:
    """A white-space word without the signs at its ends."""
    text = word.decode()
    if not text.isalpha():
        lo, hi = 0, len(text)
        while lo < hi and not text[lo].isalnum():
            lo += 1
        while lo < hi and not text[hi - 1].isalnum():
            hi -= 1
        text = text[lo:hi]
    return text


def terms_of(word: bytes) -> list[str]:
    """Terms of one white-space word: itself without signs at its ends, and its beginnings."""
    text = core(word)
    return [text, *[f"{text[:n]}-" for n in BEGINNINGS if len(text) > n]] if text else []


class Known(dict):
    """Places of the terms of a word in the vocabulary, filled on demand. Two generations are kept: the older one goes
    when the newer one is full, and what is used moves on."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[bytes, tuple[int, ...]] = {}
        self.beginnings = [(n, {t[:-1]: i for t, i in vocabulary.items() if len(t) == n + 1 and t.endswith("-")})
                           for n in BEGINNINGS]

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        found = self.older.get(word)
        if found is None:
            text = core(word)
            whole = [self.vocabulary.get(text)] if text else []
            found = tuple(i for i in (*whole, *(known.get(text[:n]) for n, known in self.beginnings if len(text) > n))
                          if i is not None)
        if len(self) >= WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found

    def counts(self, text: bytes) -> Counter:
        return Counter(i for found in filter(None, map(self.__getitem__, text.lower().split())) for i in found)


class BlockMaxIndex:
    """Inverted index over unit vectors, with the largest weight of each term in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        self.n_blocks = -(-self.n // BLOCK)
        terms = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in vectors]])
        rows = np.repeat(np.arange(self.n), [len(t) for t, _ in vectors])
        weights = np.concatenate([np.zeros(0), *[w for _, w in vectors]])
        order = np.lexsort((rows, terms))
        self.rows, self.weights = rows[order], weights[order]
        places = np.arange(n_terms)[:, None] * self.n_blocks + np.arange(self.n_blocks)
        keys = terms[order] * self.n_blocks + self.rows // BLOCK
        # postings of term t in block b: from[t, b] up to to[t, b]
        self.first = np.searchsorted(keys, places)
        self.last = np.searchsorted(keys, places, "right")
        self.top = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.top.reshape(-1), keys, self.weights)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, cosines)`` of the ``k`` examples with the largest positive cosine, ties to the smaller row."""
        bound = weights @ self.top[terms]
        rows, scores, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for block in np.argsort(-bound, kind="stable"):
            if bound[block] <= 0 or bound[block] < least - 1e-12:
                break
            total = np.zeros(BLOCK)
            for t, w in zip(terms, weights):
                lo, hi = self.first[t, block], self.last[t, block]
                if lo < hi:
                    total[self.rows[lo:hi] - block * BLOCK] += w * self.weights[lo:hi]
            hit = np.flatnonzero(total > 0)
            hit = hit[hit + block * BLOCK != skip]
            rows, scores = np.concatenate([rows, hit + block * BLOCK]), np.concatenate([scores, total[hit]])
            best = np.lexsort((rows, -scores))[:k]
            rows, scores = rows[best], scores[best]
            least = scores[-1] if len(scores) == k else 0.0
        return rows, scores


class Model:
    """The example set with its index, prior and calibration."""

    def __init__(self, vocabulary: dict[str, int], idf: np.ndarray, examples: list[tuple[int, int, Counter]],
                 weight: dict[int, float], k: int = NEIGHBOURS):
        self.vocabulary, self.idf, self.k = vocabulary, idf, k
        vectors = [(*self.vector(c), label, doc_id) for doc_id, label, c in examples]
        share = lambda some: sum(weight[y] * y for *_, y, _ in some) / max(sum(weight[y] for *_, y, _ in some), 1e-9)
        self.prior = share(vectors)
        blank = [v for v in vectors if not len(v[0])]
        # documents without any term get the share of label 1 among such examples
        self.blank = share(blank) if blank else self.prior
        # examples with the same strongest term stand together, which keeps the bounds of blocks apart
        kept = sorted((v for v in vectors if len(v[0])), key=lambda v: (int(v[0][np.argmax(v[1])]), v[2], v[3]))
        self.labels = np.array([v[2] for v in kept], float)
        self.weights = np.array([weight[v[2]] for v in kept])
        self.ids = [v[3] for v in kept]
        self.index = BlockMaxIndex([v[:2] for v in kept], len(idf))
        self.slope, self.shift = 1.0, 0.0
        votes = [self.vote(*v[:2], skip=i)[0] for i, v in enumerate(kept)] + [self.blank] * len(blank)
        truth = np.array([v[2] for v in kept] + [v[2] for v in blank], float)
        if len(set(truth)) == 2:
            self._calibrate(np.array(votes), truth, np.array([weight[int(y)] for y in truth]))

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        terms = np.array(sorted(counts), np.int64)
        weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * self.idf[terms]
        size = math.sqrt(float(weights @ weights))
        return (terms, weights / size) if size > 0 else (terms[:0], weights[:0])

    def vote(self, terms: np.ndarray, weights: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        if not len(terms) or not self.index.n:
            return self.blank, np.zeros(0, np.int64), np.zeros(0)
        rows, scores = self.index.nearest(terms, weights, self.k, skip)
        power = scores * self.weights[rows]
        return float((power @ self.labels[rows] + 0.1 * self.prior) / (power.sum() + 0.1)), rows, scores

    def _calibrate(self, votes: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> None:
        x = _logit(votes)
        beta, data = np.array([1.0, 0.0]), np.stack([x, np.ones_like(x)], axis=1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
            gradient = data.T @ (weight * (truth - p)) - 0.01 * (beta - [1.0, 0.0])
            curve = (data * (weight * p * (1 - p))[:, None]).T @ data + 0.01 * np.eye(2)
            beta = beta + np.clip(np.linalg.solve(curve, gradient), -1, 1)
        if beta[0] > 0:
            self.slope, self.shift = float(beta[0]), float(beta[1])

    def score(self, counts: Counter) -> tuple[float, list[dict]]:
        vote, rows, scores = self.vote(*self.vector(counts))
        value = 1 / (1 + math.exp(-max(min(self.slope * float(_logit(vote)) + self.shift, 30), -30)))
        return value, [{"doc_id": self.ids[r], "cosine": float(s), "toxic": int(self.labels[r])}
                       for r, s in zip(rows[:EVIDENCE].tolist(), scores[:EVIDENCE].tolist())]


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, held_out: int = 0, per_label: int = PER_LABEL) -> Model:
    """Learn from at most ``per_label`` rows of each label outside the held-out fold.

    Only the sample (ids from the label table, then the terms of those documents) and one count per
    term of the vocabulary reach the driver."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id") \
        .agg(F.max("toxic").cast("int").alias("toxic")).where(fold("doc_id", parts) != held_out)
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_label).drop("rank")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def term_counts(batches):
        for batch in small(batches, 1, COUNTED_BYTES):
            rows = [Counter(t for w in text.lower().split() for t in terms_of(w)) for text in text_bytes(batch.column(1))]
            where = pa.array([i for i, c in enumerate(rows) for _ in c], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(where), batch.column(2).take(where), pa.array([t for c in rows for t in c], pa.string()),
                 pa.array([n for c in rows for n in c.values()], pa.int64())], ["doc_id", "toxic", "term", "tf"])

    kind = dict(docs.dtypes)["doc_id"]
    counted = map_rows(sample, ["doc_id", "text", "toxic"], f"doc_id {kind}, toxic int, term string, tf long", term_counts)
    taken = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = taken.get(1, 0), taken.get(0, 0)
    weight = {y: sizes.get(y, 0) / max(taken.get(y, 0), 1) for y in (0, 1)}
    if not n1 or not n0:
        examples = [(0, y, Counter()) for y in (0, 1) if taken.get(y)]
        return Model({}, np.zeros(0), examples, weight)
    a, b = F.sum("toxic").cast("double"), F.sum(1 - F.col("toxic")).cast("double")
    n = n1 + n0
    chosen_terms = counted.groupBy("term").agg(a.alias("a"), b.alias("b")).withColumn("seen", F.expr("a + b")).withColumn(
        "chi", F.expr(f"{n}D * pow(a * ({n0} - b) - b * ({n1} - a), 2)"
                      f" / nullif({n1}D * {n0}D * seen * ({n} - seen), 0)")) \
        .where(F.col("chi") >= CHI_SQUARE).orderBy(F.desc("chi"), "term").limit(TERMS)
    vocabulary = {r["term"]: i for i, r in enumerate(chosen_terms.select("term").collect())}
    total, seen = document_frequencies(docs, vocabulary)
    idf = np.log((1 + total) / (1 + seen)) + 1
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def few(batches):
        words = Known(shared.value)
        for batch in small(batches, 1):
            found = [words.counts(x) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([list(c) for c in found], pa.list_(pa.int32())),
                 pa.array([list(c.values()) for c in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "tfs"])
    rows = map_rows(sample, ["doc_id", "text", "toxic"], f"doc_id {kind}, toxic int, terms array<int>, tfs array<int>", few)
    examples = [(r["doc_id"], r["toxic"], Counter(dict(zip(r["terms"], r["tfs"])))) for r in rows.collect()]
    return Model(vocabulary, idf, examples, weight)


def document_frequencies(docs: DataFrame, vocabulary: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents with each term, over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        words, seen, n = Known(shared.value), np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in small(batches, 0):
            n += batch.num_rows
            for text in text_bytes(batch.column(0)):
                found = {i for t in filter(None, map(words.__getitem__, text.lower().split())) for i in t}
                seen[list(found)] += 1
        seen[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(range(len(seen)), pa.int32()), pa.array(seen)], ["term", "n"])

    rows = map_rows(docs, ["text"], "term int, n long", work).groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        found[r["term"]] = r["n"]
    return int(found[-1]), found[:-1]


EVIDENCE_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, evidence)`` of every row; ``evidence`` names the nearest examples.

    A text without any term, the empty and the null text among them, gets the calibrated share of
    label 1 among such examples.  Without labelled rows all scores are 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        known = Known(shared.value.vocabulary)
        for batch in small(batches, 1):
            found = [shared.value.score(known.counts(x)) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()),
                                              pa.array([e for _, e in found], EVIDENCE_TYPE)],
                                             ["doc_id", "score", "evidence"])
    return map_rows(docs, ["doc_id", "text"], f"doc_id {dict(docs.dtypes)['doc_id']}, score double,"
                                              " evidence array<struct<doc_id long, cosine double, toxic int>>", work)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows with a score below ``threshold``, all columns as they are, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def work(batches):
        known = Known(shared.value.vocabulary)
        for batch in small(batches, at):
            keep = [shared.value.score(known.counts(x))[0] < threshold for x in text_bytes(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return docs.mapInArrow(work, docs.schema)
