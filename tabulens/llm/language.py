"""Language of words and texts by a linear-chain conditional random field.

The state of a word is its language.  Features of a word are the word itself (lexicon), its first
and last one to three letters, and its letter pairs and triples, hashed to ``BUCKETS``; transitions
between neighbouring words are learned with them.  The training set is a bounded sample
(``PER_LANGUAGE`` documents of each language, the smallest hashes; ``TAKEN`` words of each), cut
into sequences that join stretches of several documents, so that switches within a text are seen.
A text is labelled by forward-backward over all its words; its language is the one with the largest
mean marginal.  A token of more than ``PIECE`` letters (text without spaces) is cut into successive
pieces, each a position of the chain like a word, so that every letter counts."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabulens.llm.common import fold, map_rows, text_bytes

PER_LANGUAGE = 250
TAKEN = 200
SEQUENCE = 40
BUCKETS = 1 << 15
EPOCHS = 60
WORDS_KEPT = 300_000
NAMES_KEPT = 1_000_000
PIECE = 48
DOCS_AT_ONCE = 512
WORDS_AT_ONCE = 400_000
UNKNOWN = "und"


class Buckets(dict):
    """Bucket of a feature name; the names of a process are hashed once, as words share most of theirs."""

    def __missing__(self, name: str) -> int:
        if len(self) >= NAMES_KEPT:
            self.clear()
        self[name] = bucket = zlib.crc32(name.encode()) % BUCKETS
        return bucket


BUCKET_OF = Buckets()


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    padded = f"<{word}>"
    names = [f"w:{word}", *[f"p:{word[:n]}" for n in (1, 2, 3)], *[f"s:{word[-n:]}" for n in (1, 2, 3)],
             *[padded[i:i + 2] for i in range(len(padded) - 1)], *[padded[i:i + 3] for i in range(len(padded) - 2)]]
    return list(map(BUCKET_OF.__getitem__, names))


def letters(token: bytes) -> str:
    """The lower-case word inside a white-space token; empty if it holds no letter."""
    text = token.decode().lower()
    if text.isalpha():
        return text
    if not any(c.isalpha() for c in text):
        return ""
    lo, hi = 0, len(text)
    while not text[lo].isalpha():
        lo += 1
    while not text[hi - 1].isalpha():
        hi -= 1
    return text[lo:hi]


def pieces(token: bytes) -> list[bytes]:
    """A token of more than ``PIECE`` characters in stretches of about equal length, else the token itself."""
    if len(token) <= PIECE:
        return [token]
    text = token.decode()
    n = -(-len(text) // PIECE)
    cuts = [i * len(text) // n for i in range(n + 1)]
    return [text[a:b].encode() for a, b in zip(cuts, cuts[1:])]


def split(text: bytes) -> list[bytes]:
    """The tokens of a text, long ones in pieces."""
    tokens = text.split()
    if max(map(len, tokens), default=0) <= PIECE:
        return tokens
    return [p for t in tokens for p in pieces(t)]


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple:
    """Marginals of sequences of falling length, laid out step by step.

    ``emission`` has the rows of step 0 of all sequences, then step 1 of those that reach it, and so
    on (probabilities up to a factor per row).  Returns marginals in the same layout, the scaled
    forward and backward rows, and the log of each normaliser."""
    counts = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    offsets = np.concatenate([[0], np.cumsum(counts)]).tolist()
    ahead, back = np.empty_like(emission), np.ones_like(emission)
    scale = np.empty(len(emission))
    for t, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
        row = (ahead[offsets[t - 1]:offsets[t - 1] + hi - lo] @ transition if t else start) * emission[lo:hi]
        total = row.sum(axis=1, keepdims=True)
        ahead[lo:hi], scale[lo:hi] = row / total, total[:, 0]
    for t in range(len(offsets) - 3, -1, -1):
        lo, n = offsets[t], offsets[t + 2] - offsets[t + 1]
        following = slice(offsets[t + 1], offsets[t + 2])
        row = (emission[following] * back[following]) @ transition.T
        back[lo:lo + n] = row / row.sum(axis=1, keepdims=True)
    both = ahead * back
    return both / both.sum(axis=1, keepdims=True), ahead, back, np.log(scale), offsets


class Field:
    """Learned weights: ``languages``, ``weights[feature, state]``, ``moves[from, to]``, ``begin``."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.languages, self.weights = languages, weights
        self.transition, self.start = _softmax(moves), _softmax(begin)

    def scores(self, word: str) -> np.ndarray:
        return self.weights[features(word)].sum(axis=0) if word else np.zeros(len(self.languages))


def _softmax(x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(languages: list[str], examples: list[tuple[str, list[str]]], epochs: int = EPOCHS) -> Field:
    """Fit by Adam on the conditional likelihood. ``examples`` are ``(language, words)`` of documents.

    Transitions and the first state are normalised (they are learned log probabilities); word scores are free."""
    k, random = len(languages), np.random.default_rng(7)
    if k == 0:
        return Field([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), np.zeros(0))
    stretches = []
    for language, words in examples:
        at = 0
        while at < len(words):
            n = int(random.integers(4, SEQUENCE + 1))
            stretches.append((languages.index(language), words[at:at + n]))
            at += n
    order = random.permutation(len(stretches))
    vocabulary: dict[str, int] = {}
    tokens, states = [], []
    for i in order:
        state, words = stretches[i]
        for w in words:
            tokens.append(vocabulary.setdefault(w, len(vocabulary)))
            states.append(state)
    tokens, states = np.array(tokens, np.int64), np.array(states, np.int64)
    size = min(SEQUENCE, len(tokens))
    n = len(tokens) // size if size else 0
    if not n:
        return Field(languages, np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k))
    # sequence-major to step-major
    grid = np.arange(n * size).reshape(n, size).T
    tokens, states, lengths = tokens[grid.ravel()], states[grid.ravel()], np.full(n, size)
    found = [features(w) for w in vocabulary]
    flat, owner = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
    first = np.concatenate([[0], np.cumsum([len(f) for f in found])[:-1]])
    truth = np.eye(k)[states]
    weights, moves, begin = np.zeros((BUCKETS, k)), np.eye(k) * 2.0, np.zeros(k)
    parameters = [weights, moves, begin]
    means, squares = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    total = len(tokens)
    for epoch in range(1, epochs + 1):
        raw = np.add.reduceat(weights[flat], first)[tokens]
        emission = np.exp(raw - raw.max(axis=1, keepdims=True))
        transition, start = _softmax(moves), _softmax(begin)
        marginal, ahead, back, scale, offsets = forward_backward(emission, lengths, transition, start)
        error = truth - marginal
        by_word = np.stack([np.bincount(tokens, error[:, j], len(found)) for j in range(k)], axis=1)
        grad_w = np.stack([np.bincount(flat, by_word[owner, j], BUCKETS) for j in range(k)], axis=1)
        expected, seen = np.zeros((k, k)), np.zeros((k, k))
        if size > 1:
            left, right = slice(0, offsets[-2]), slice(offsets[1], offsets[-1])
            pair = ahead[left][:, :, None] * transition[None] * (emission[right] * back[right])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            expected = pair.sum(axis=0)
            np.add.at(seen, (states[left], states[right]), 1)
        # gradient through the normalisation of each row
        difference = seen - expected
        grad_m = difference - transition * difference.sum(axis=1, keepdims=True)
        ahead_start = error[:n].sum(axis=0)
        grad_b = ahead_start - start * ahead_start.sum()
        for p, g, m, s, decay in zip(parameters, (grad_w, grad_m, grad_b), means, squares, (1e-5, 0, 0)):
            g = g / total - decay * p
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            p += 0.1 * (m / (1 - 0.9 ** epoch)) / (np.sqrt(s / (1 - 0.99 ** epoch)) + 1e-9)
    return Field(languages, weights, moves, begin)


def fit(docs: DataFrame, parts: int = 4, held_out: int = 2, per_language: int = PER_LANGUAGE, taken: int = TAKEN) -> Field:
    """Learn from rows with a language outside the held-out fold; the sample alone reaches the driver."""
    known = docs.select("doc_id", "lang").where(
        (fold("doc_id", parts) != held_out) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()) \
        .groupBy("doc_id").agg(F.min("lang").alias("_lang"))
    order = Window.partitionBy("_lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_language).drop("_rank")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def work(batches):
        for batch in batches:
            found = []
            for text in text_bytes(batch.column(0)):
                words = [w for w in map(letters, split(text)) if w]
                # a stretch from anywhere in the text, told by its own bytes
                at = zlib.crc32(text) % max(len(words) - taken + 1, 1)
                found.append(words[at:at + taken])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], ["lang", "words"])
    rows = map_rows(sample, ["text", "_lang"], "lang string, words array<string>", work).orderBy("lang", "words").collect()
    examples = [(r["lang"], r["words"]) for r in rows]
    return train(sorted({language for language, _ in examples}), examples)


class Scores(dict):
    """Number of a token in a growing table of scores; -1 for tokens without a letter."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.rows, self.of = field, [], {}

    def learn(self, tokens: set[bytes]) -> None:
        """Score the words of all tokens not met before, together."""
        new = [t for t in tokens if t not in self]
        word_of = {t: letters(t) for t in new}
        words = [w for w in dict.fromkeys(word_of.values()) if w and w not in self.of]
        if words:
            found = [features(w) for w in words]
            sizes = np.array([len(f) for f in found])
            flat = np.fromiter((b for f in found for b in f), np.int64, int(sizes.sum()))
            raw = np.add.reduceat(self.field.weights[flat], np.cumsum(sizes) - sizes, axis=0)
            for w in words:
                self.of[w] = len(self.of)
            self.rows.append(np.exp(raw - raw.max(axis=1, keepdims=True)))
        for t, w in word_of.items():
            self[t] = self.of[w] if w else -1

    def table(self) -> np.ndarray:
        """The scores of all words, by number."""
        if len(self.rows) != 1:
            self.rows = [np.concatenate([np.zeros((0, len(self.field.languages))), *self.rows])]
        return self.rows[0]

    def emptied(self) -> bool:
        """Drop everything when full, between groups of documents only."""
        if len(self) < WORDS_KEPT:
            return False
        self.clear()
        self.rows, self.of = [], {}
        return True


TABLES: dict[str, Scores] = {}


def table_of(name: str, shared) -> Scores:
    """The word table of the process for one run: later tasks of a worker find the words of earlier ones."""
    if name not in TABLES:
        TABLES.clear()
        TABLES[name] = Scores(shared.value)
    return TABLES[name]


def label(texts: list[bytes], scores: Scores) -> list[tuple[str, float]]:
    """``(language, mean marginal)`` of each text."""
    field = scores.field
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if not field.languages:
        return out
    tokens = [split(t) for t in texts]
    scores.learn(set().union(*tokens))
    numbers = [np.array([x for x in map(scores.__getitem__, some) if x >= 0], np.int64) for some in tokens]
    order = sorted((i for i in range(len(texts)) if len(numbers[i])), key=lambda i: -len(numbers[i]))
    table = scores.table()
    at = 0
    while at < len(order):
        group, size = [], 0
        while at < len(order) and (not group or size + len(numbers[order[at]]) <= WORDS_AT_ONCE):
            group.append(order[at])
            size += len(numbers[order[at]])
            at += 1
        lengths = np.array([len(numbers[i]) for i in group])
        joined = np.concatenate([numbers[i] for i in group])
        owner = np.repeat(np.arange(len(group)), lengths)
        step = np.arange(len(joined)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        lay = np.lexsort((owner, step))
        marginal, *_ = forward_backward(table[joined[lay]], lengths, field.transition, field.start)
        who = owner[lay]
        mean = np.stack([np.bincount(who, marginal[:, j], len(group)) for j in range(len(field.languages))], axis=1) \
            / lengths[:, None]
        for i, row in zip(group, mean):
            best = int(np.argmax(row))
            out[i] = field.languages[best], float(min(row[best], 1.0))
    return out


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row.

    ``und`` with score 0 where the text is null, empty or without a letter, or nothing was learned.
    Repeated rows get equal results; ties go to the first language in order of name."""
    shared, name = docs.sparkSession.sparkContext.broadcast(field), uuid.uuid4().hex

    def work(batches):
        scores = table_of(name, shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(lo, DOCS_AT_ONCE)
                found = label(text_bytes(part.column(1)), scores)
                scores.emptied()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()),
                                                  pa.array([s for _, s in found], pa.float64())],
                                                 ["doc_id", "lang_pred", "score"])
    return map_rows(docs, ["doc_id", "text"],
                    f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double", work)


def words(text: str, field: Field) -> list[tuple[str, str, float]]:
    """``(word, language, marginal)`` of every word with a letter: code-switched text, word by word."""
    scores = Scores(field)
    tokens = split(text.encode())
    if not field.languages:
        return []
    scores.learn(set(tokens))
    tokens = [t for t in tokens if scores[t] >= 0]
    if not tokens:
        return []
    rows = scores.table()[[scores[t] for t in tokens]]
    marginal, *_ = forward_backward(rows, np.array([len(tokens)]), field.transition, field.start)
    best = marginal.argmax(axis=1)
    return [(t.decode(), field.languages[b], float(m[b])) for t, b, m in zip(tokens, best.tolist(), marginal)]

