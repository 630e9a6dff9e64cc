"""Language-model scores from a log-frequency Bloom filter of word pairs.

Tokens are hashed to 64 bits.  One pass over the training rows counts words and pairs: every task
sends its distinct keys, packed by shard, and each shard is merged once.  All pairs go into the
filter: a pair counted ``c`` times is inserted at the levels 1 to ``floor(log2 c) + 1``, so the number of levels found again tells its frequency up to a factor of two.
A pair's probability is interpolated with the exact add-one probability of the word:

    p(w | h) = (1 - l) p1(w) + l c(h, w) / c(h),   l = MIX c(h) / (c(h) + 20)

The filter and the word counts are broadcast.  Where they exceed ``ROOM`` bytes, words are dealt to
groups by their hash, and each pair of groups (of the word, of the one before it) is scored in a
pass of its own over the texts with nothing but the counts of these two groups in memory; the sum
over passes is the score, so no table is cut and no broadcast outgrows the bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulens.llm.common import fold, map_rows, stored, text_bytes

MIX = 0.2
BITS_PER_KEY = 10
PROBES = 7
LEVEL_FACTOR = 1.2
ROOM = 256 << 20
TOKENS_PER_SHARD = 1_000_000
TOKENS_AT_ONCE = 1_000_000
BYTES_AT_ONCE = 1 << 19
ROWS_AT_ONCE = 256
GROUP_BITS = 8

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_factors = np.zeros(0, np.uint64)


def _factor(n: int) -> np.ndarray:
    """An odd 64-bit factor for each of ``n`` places in a word."""
    global _factors
    if len(_factors) < n:
        size = max(n, 2 * len(_factors), 64)
        _factors = _mixed(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _factors[:n]


END = _mixed(np.array([1], np.uint64))[0]
START = _mixed(np.array([2], np.uint64))[0]


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts in order, each text closed by ``END``, and the number of tokens of each.

    A word's hash is the sum of its A-Z-lowered bytes plus one, each times the factor of its place, scrambled."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(before & ~space)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    if len(starts):
        signs = np.flatnonzero(~space)
        ends = np.flatnonzero(~before & space)
        lengths = ends - starts
        inside = np.arange(len(signs)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        worth = (_LOWER[data[signs]].astype(np.uint64) + np.uint64(1)) * _factor(int(lengths.max()))[inside]
        words = _mixed(np.add.reduceat(worth, np.cumsum(lengths) - lengths))
    else:
        words = np.zeros(0, np.uint64)
    counts = np.bincount(owner, minlength=len(texts))
    return np.insert(words, np.cumsum(counts), END), counts + 1


def histories(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token before each one, ``START`` at the beginning of a text."""
    before = np.concatenate([[START], tokens[:-1]])
    before[np.cumsum(counts) - counts] = START
    return before.astype(np.uint64)


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """64-bit keys: eight bits of the word, eight of the one before it, 48 of both."""
    both = _mixed(before * np.uint64(0x9E3779B97F4A7C15) + tokens)
    top = np.uint64(64 - GROUP_BITS)
    return (tokens >> top) << top | (before >> top) << np.uint64(64 - 2 * GROUP_BITS) | both >> np.uint64(2 * GROUP_BITS)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys & np.uint64(0xFFFFFFFF)) % np.uint64(shards)


def _grouped_texts(batch_column: pa.Array):
    """Texts of a column in groups of about ``BYTES_AT_ONCE``."""
    held, size = [], 0
    for lo in range(0, len(batch_column), ROWS_AT_ONCE):
        for text in text_bytes(batch_column.slice(lo, ROWS_AT_ONCE)):
            held.append(text)
            size += len(text)
            if size >= BYTES_AT_ONCE:
                yield held
                held, size = [], 0
    if held:
        yield held


COUNTED = "kind int, shard int, n long, total long, inserted long, keys binary, counts binary"
WORD, PAIR = 0, 1


def _packed(kind: int, keys: np.ndarray, shards: int) -> list[dict]:
    keys, counts = np.unique(keys, return_counts=True)
    shard = _shard(keys, shards)
    order = np.argsort(shard, kind="stable")
    keys, counts, shard = keys[order], counts[order].astype(np.uint32), shard[order]
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    rows = []
    for s, (lo, hi) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
        if lo < hi:
            some, often = keys[lo:hi], counts[lo:hi]
            once = often == 1
            rows.append({"kind": kind, "shard": s, "once": some[once].tobytes(), "more": some[~once].tobytes(),
                         "counts": often[~once].tobytes()})
    return rows


_PACKED = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("once", pa.binary()), ("more", pa.binary()),
                     ("counts", pa.binary())])


def count(texts: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """Counts of all words and pairs, one row per kind and shard."""
    def work(batches):
        words, pairs, size = [], [], 0

        def flushed():
            rows = _packed(WORD, np.concatenate(words), shards) + _packed(PAIR, np.concatenate(pairs), shards)
            return pa.RecordBatch.from_pylist(rows, _PACKED)
        for batch in batches:
            for some in _grouped_texts(batch.column(0)):
                tokens, lengths = token_hashes(some)
                words.append(tokens)
                pairs.append(pair_keys(histories(tokens, lengths), tokens))
                size += len(tokens)
                if size >= TOKENS_AT_ONCE:
                    yield flushed()
                    words, pairs, size = [], [], 0
        if size:
            yield flushed()

    def merge(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        once = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("once")]
        more = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("more")]
        counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")]
        keys = np.concatenate([*once, *more])
        counts = np.concatenate([np.ones(sum(map(len, once)), np.int64), *[c.astype(np.int64) for c in counts]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        total, inserted = int(counts.sum()), 0
        if kind == PAIR:
            inserted = int(levels(counts).sum())
        return pa.table({"kind": pa.array([kind], pa.int32()), "shard": pa.array([shard], pa.int32()),
                         "n": [len(keys)], "total": [total], "inserted": [inserted],
                         "keys": pa.array([keys.tobytes()], pa.binary()),
                         "counts": pa.array([counts.tobytes()], pa.binary())})

    packed = map_rows(texts, [text], "kind int, shard int, once binary, more binary, counts binary", work)
    return packed.groupBy("kind", "shard").applyInArrow(merge, COUNTED)


def levels(counts: np.ndarray) -> np.ndarray:
    """How many levels a count fills: floor(log2) and one more."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def _probes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = _mixed(keys + np.uint64(level * 0xD1342543DE82EF95 % (1 << 64)))
    return mixed >> np.uint64(32), (mixed & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def bloom(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of a filter over keys at all their levels."""
    depth = levels(counts)
    size = max(int(depth.sum()) * BITS_PER_KEY, 64)
    bits = np.zeros(size, bool)
    for level in range(1, int(depth.max(initial=0)) + 1):
        a, b = _probes(keys[depth >= level], level)
        for i in range(PROBES):
            bits[(a + np.uint64(i) * b) % np.uint64(size)] = True
    return np.packbits(bits, bitorder="little")


def filters(counted: DataFrame, groups: int) -> DataFrame:
    """``(word_group, before_group, shard, bits, body)``: the filter of every shard and pair of groups."""
    shift = np.uint64(GROUP_BITS - (groups.bit_length() - 1))

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, counts = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)
                top = (keys >> np.uint64(64 - GROUP_BITS)) >> shift
                second = ((keys >> np.uint64(64 - 2 * GROUP_BITS)) & np.uint64(2 ** GROUP_BITS - 1)) >> shift
                for g in range(groups):
                    for h in range(groups):
                        mine = (top == g) & (second == h)
                        depth = max(int(levels(counts[mine]).sum()) * BITS_PER_KEY, 64) if mine.any() else 64
                        body = bloom(keys[mine], counts[mine])
                        yield pa.RecordBatch.from_pylist([{"word_group": g, "before_group": h, "shard": row["shard"],
                                                           "bits": depth, "body": body.tobytes()}], _FILTER)
    return counted.where(F.col("kind") == PAIR).select("shard", "keys", "counts") \
        .mapInArrow(work, "word_group int, before_group int, shard int, bits long, body binary")


_FILTER = pa.schema([("word_group", pa.int32()), ("before_group", pa.int32()), ("shard", pa.int32()),
                     ("bits", pa.int64()), ("body", pa.binary())])


class Counts:
    """Exact word counts of one group, looked up by hash."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        # four bytes a count where they are enough
        small = counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts
        self.counts = small[order]

    def of(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(tokens), np.int64)
        at = np.minimum(np.searchsorted(self.keys, tokens), len(self.keys) - 1)
        return np.where(self.keys[at] == tokens, self.counts[at], 0).astype(np.int64)


class Filter:
    """The shards of a pair of groups side by side."""

    def __init__(self, shards: int, rows):
        """``rows`` are ``(shard, bits, body)``; they may come one by one."""
        self.shards = shards
        self.bits, self.first = np.ones(shards, np.uint64), np.full(shards, -1, np.int64)
        whole = bytearray()
        for shard, bits, body in rows:
            self.bits[shard], self.first[shard] = bits, len(whole)
            whole += body
        whole += b"\0"
        self.body = np.frombuffer(whole, np.uint8)

    def found(self, keys: np.ndarray) -> np.ndarray:
        """Number of levels of each key that are all present from the first on."""
        shard = _shard(keys, self.shards).astype(np.int64)
        depth = np.zeros(len(keys), np.int64)
        alive = np.flatnonzero(self.first[shard] >= 0)
        level = 1
        while len(alive):
            a, b = _probes(keys[alive], level)
            size, first = self.bits[shard[alive]], self.first[shard[alive]]
            for i in range(PROBES):
                place = (a + np.uint64(i) * b) % size
                hit = self.body[first + (place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1
                keep = hit.astype(bool)
                alive, a, b, size, first = alive[keep], a[keep], b[keep], size[keep], first[keep]
                if not len(alive):
                    break
            depth[alive] = level
            level += 1
        return depth


class Pass:
    """What one pass holds in memory: counts of the word group and of the group before it, and their filter."""

    def __init__(self, groups: int, word_group: int, before_group: int, words: Counts, before: Counts, pairs: Filter,
                 tokens: int, vocabulary: int, texts: int):
        self.groups, self.word_group, self.before_group = groups, word_group, before_group
        self.words, self.before, self.pairs = words, before, pairs
        self.tokens, self.vocabulary, self.texts = tokens, vocabulary, texts

    def score(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text: tokens and known tokens of the pass, base score and model score (log10)."""
        tokens, counts = token_hashes(texts)
        before, owner = histories(tokens, counts), np.repeat(np.arange(len(texts)), counts)
        if self.groups > 1:
            shift = np.uint64(64 - (self.groups.bit_length() - 1))
            mine = ((tokens >> shift) == self.word_group) & ((before >> shift) == self.before_group)
            tokens, before, owner = tokens[mine], before[mine], owner[mine]
        seen = self.words.of(tokens)
        single = (seen + 1) / (self.tokens + self.vocabulary + 1)
        context = np.where(before == START, self.texts, self.before.of(before))
        share = MIX * context / (context + 20)
        depth = self.pairs.found(pair_keys(before, tokens))
        often = np.where(depth > 1, LEVEL_FACTOR * np.exp2(depth - 1), depth)
        pair = np.minimum(often, context) / np.maximum(context, 1)
        add = lambda x: np.bincount(owner, x, len(texts)).astype(float)
        return [np.bincount(owner, minlength=len(texts)), add(seen > 0), add(np.log10(single)),
                add(np.log10((1 - share) * single + share * pair))]


def score(docs: DataFrame, train: Column | None = None, room: int = ROOM) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``train`` says which rows are learned from (all but fold 2 of 7 by default; rows without an id
    are).  Null and empty texts are the end token alone.  Without training rows all counts are 0.
    Repeated rows count as often as they stand there."""
    train = F.coalesce(fold("doc_id", 7) != 2, F.lit(True)) if train is None else train
    learned = docs.where(train).select("text")
    size = learned.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    shards = max(int((size[0] or 0) // 6 // TOKENS_PER_SHARD), 1)
    counted = stored(count(learned, shards))
    sums = {r["kind"]: r for r in counted.groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("inserted").alias("inserted")).collect()}
    words = sums[WORD]["n"] if WORD in sums else 0
    tokens = sums[WORD]["total"] if WORD in sums else 0
    inserted = sums[PAIR]["inserted"] if PAIR in sums else 0
    groups = 1
    while groups < 2 ** GROUP_BITS and 2 * 12 * words / groups + inserted * BITS_PER_KEY / 8 / groups ** 2 > room:
        groups *= 2
    made = stored(filters(counted, groups))
    kind, out = dict(docs.dtypes)["doc_id"], None
    for g in range(groups):
        for h in range(groups):
            words_of_group = _group_counts(counted, groups, g)
            before = words_of_group if g == h else _group_counts(counted, groups, h)
            one = Pass(groups, g, h, words_of_group, before,
                       Filter(shards, made.where((F.col("word_group") == g) & (F.col("before_group") == h))
                              .select("shard", "bits", "body").toLocalIterator()),
                       tokens, words, size[1])
            shared = docs.sparkSession.sparkContext.broadcast(one)

            def work(batches, shared=shared):
                for batch in batches:
                    at = 0
                    for some in _grouped_texts(batch.column(1)):
                        n, known, base, model = shared.value.score(some)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(at, len(some)), pa.array(n, pa.int64()),
                             pa.array(known.astype(np.int64)), pa.array(base), pa.array(model),
                             pa.array([_row_key(x) if groups > 1 else 0 for x in some], pa.int64())],
                            ["doc_id", "n_tokens", "n_known", "base_score", "score", "mark"])
                        at += len(some)
            part = map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, n_tokens long, n_known long, base_score double,"
                                                      " score double, mark long", work)
            out = part if out is None else out.union(part)
    if groups > 1:
        # a row is added up over the passes; equal rows are told apart by their number of repeats
        out = out.groupBy("doc_id", "mark").agg(
            F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"),
            F.sum("score").alias("score"), (F.count(F.lit(1)) / groups ** 2).cast("int").alias("times")) \
            .select("doc_id", F.explode(F.array_repeat(F.struct(*[
                (F.col(c) / F.col("times")).cast(t).alias(c) for c, t in (
                    ("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"))]),
                F.col("times"))).alias("s")).select("doc_id", "s.*")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _row_key(text: bytes) -> int:
    import xxhash
    value = xxhash.xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def _group_counts(counted: DataFrame, groups: int, group: int) -> Counts:
    """Word counts of one group. Shards come one by one and keep what belongs to the group."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    shift = np.uint64(64 - (groups.bit_length() - 1)) if groups > 1 else None

    def mine(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k, c = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.int64)
                if shift is not None:
                    k, c = k[(keep := (k >> shift) == group)], c[keep]
                yield pa.RecordBatch.from_arrays([pa.array([k.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary())],
                                                 ["keys", "counts"])
    rows = counted.where(F.col("kind") == WORD).select("keys", "counts").mapInArrow(mine, "keys binary, counts binary")
    for row in rows.toLocalIterator():
        keys.append(np.frombuffer(row["keys"], np.uint64))
        counts.append(np.frombuffer(row["counts"], np.int64))
    return Counts(np.concatenate(keys), np.concatenate(counts))
