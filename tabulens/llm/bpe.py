"""BPE encoding and decoding of whole texts with a given tokenizer file.

Text is looked up word by word in a bounded table of words met before, which is exact because
white space never joins the pieces of this tokenizer.  Texts that hold a run of more than ``leaf``
characters without white space go another way: they are cut into leaves, the leaves are encoded in
parallel tasks, and neighbours are joined pairwise up a tree.  At a cut inside a run the text around
the join is encoded again in a window that doubles until it shares tokens with both sides; a
token sequence of a BPE is valid when all its neighbouring pairs are, so shared tokens make the
joined sequence the one that the whole text has."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulens.llm.common import text_bytes

LEAF = 4096
WINDOW = 64
WORDS_KEPT = 500_000
# of whole texts, whose workers live on beside the other stages of a pipeline
TEXT_WORDS_KEPT = 125_000
# words that are merged together: how long they may be, and how many at once
MERGED_BYTES = 32
MERGED_AT_ONCE = 4096
SIGNS = b"!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
GAP = " \t\n\r\x0b\x0c"


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding; one per process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the signs from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


class Merges:
    """The merge rules of a plain byte-level BPE, for many words at once.

    Each round merges in every word its pair of the smallest rank, the leftmost of them, as the library does. Words
    stand side by side as columns, so a round is a few operations on whole rows."""

    NONE = np.iinfo(np.int32).max
    SLOT_BITS = 20

    def __init__(self, model: dict):
        vocab, signs = model["vocab"], byte_signs()
        self.base = max(vocab.values()) + 2
        self.of_byte = np.array([vocab[chr(signs[b])] for b in range(256)], np.int32)
        halves = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = np.array([vocab["".join(m)] for m in halves], np.int32)
        self.keys = np.array([vocab[a] * self.base + vocab[b] for a, b in halves], np.int64)
        # open addressing: the rank of a rule, or -1; of repeated rules the last one holds, as in the library
        ranks = {key: rank for rank, key in enumerate(self.keys.tolist())}
        self.slots = np.full(1 << max(self.SLOT_BITS, len(ranks).bit_length() + 2), -1, np.int32)
        self.shift = np.uint64(65 - len(self.slots).bit_length())
        for rank, slot in zip(ranks.values(), self._slot(self.keys[list(ranks.values())]).tolist()):
            while self.slots[slot] >= 0:
                slot = slot + 1 & len(self.slots) - 1
            self.slots[slot] = rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of symbols; ``NONE`` where they do not merge, or where one is missing (-1)."""
        # a missing left symbol makes a negative key, a missing right one takes the place that no symbol has
        keys = left.astype(np.int64) * self.base + np.where(right < 0, self.base - 1, right)
        slots = self._slot(keys)
        found = self.slots[slots]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            slots[open_] = slots[open_] + 1 & len(self.slots) - 1
            found[open_] = self.slots[slots[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != keys[open_])]
        return np.where(found < 0, self.NONE, found)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each word; words of like length should stand together."""
        return [x for lo in range(0, len(words), MERGED_AT_ONCE) for x in self._encode(words[lo:lo + MERGED_AT_ONCE])]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width).T
        places = np.arange(width)[:, None]
        sym = np.where(places < sizes, self.of_byte[raw], -1).astype(np.int32)
        rank = np.full(sym.shape, self.NONE, np.int32)
        if width > 1:
            rank[:-1] = self.rank(sym[:-1].ravel(), sym[1:].ravel()).reshape(width - 1, -1)
        out, of = np.full(sym.shape, -1, np.int32), np.arange(len(words))
        while True:
            least = rank.min(axis=0)
            some = least < self.NONE
            if not some.all():
                out[:len(sym), of[~some]] = sym[:, ~some]
                sym, rank, of, least = sym[:, some], rank[:, some], of[some], least[some]
            if not len(of):
                break
            at, column = (rank == least).argmax(axis=0), np.arange(len(of))
            # what stands behind the pair moves up by one
            behind = places[:len(sym) - 1] > at
            sym = np.where(behind, sym[1:], sym[:-1])
            rank = np.where(behind, rank[1:], rank[:-1])
            sym[at, column] = self.made[least]
            after = np.where(at + 1 < len(sym), sym[np.minimum(at + 1, len(sym) - 1), column], -1)
            rank[at, column] = self.rank(sym[at, column], after)
            inner = np.flatnonzero(at)
            rank[at[inner] - 1, inner] = self.rank(sym[at[inner] - 1, inner], sym[at[inner], inner])
        flat = out.T
        kept = flat >= 0
        packed = flat[kept].astype("<u4").tobytes()
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def merges(path: str) -> Merges | None:
    """The merge rules of a tokenizer file, if it is a plain byte-level BPE without normalizer."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, before = made["model"], made.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(
        model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    if not plain or not byte_level or made.get("normalizer") or not all(chr(s) in model["vocab"] for s in byte_signs().values()):
        return None
    return Merges(model)


class Words(dict):
    """Packed ids of words (UTF-8, no white space inside), filled on demand.

    Two generations of ``kept`` words at most are held: the older one goes when the newer one is full, and what
    is used moves on. A word that ends in signs after a letter is looked up in two parts, as the tokenizers used
    here always break there; a word of Latin letters is one piece and goes to the BPE model of the
    tokenizer at once. ``prefix`` is put before each word."""

    SIGN_OF_BYTE = byte_signs()

    def __init__(self, path: str, kind: str, prefix: str = "", kept: int = WORDS_KEPT):
        super().__init__()
        self.path, self.kept = path, kept
        self.tokenizer, self.kind, self.prefix = tokenizer(path), "I" if kind == "<u4" else "i", prefix
        self.model, self.lower = self.tokenizer.model, self.tokenizer.normalizer is not None
        self.signs = Words(path, kind, kept=kept) if prefix else self
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = self._coded(word)
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self[word] = packed
        return packed

    def learn(self, words: list[bytes], latin: np.ndarray) -> None:
        """Encode the new ones of the words together that are marked as letters up to U+00FF alone, and so as one piece; a
        space or a line end may stand before them. All others are encoded when they are looked up."""
        rules = merges(self.path) if self.kind == "I" and not self.prefix else None
        if rules is None:
            return
        new = [w for w in compress(words, latin.tolist()) if w not in self and w not in self.older and len(w) <= MERGED_BYTES]
        new.sort(key=len)
        if len(self) + len(new) > self.kept:
            self.older = dict(self)
            self.clear()
        # the tokenizer breaks behind a line end, but not behind a single space
        broken = [w for w in new if w.startswith(b"\n")]
        if broken:
            head = self[b"\n"]
            self.update(zip(broken, [head + x for x in rules.encode([w[1:] for w in broken])]))
            new = [w for w in new if not w.startswith(b"\n")]
        self.update(zip(new, rules.encode(new)))

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def _coded(self, word: bytes) -> bytes:
        core = word.rstrip(SIGNS)
        text = core.decode()
        if core and len(core) < len(word):
            if text[-1].isalpha() and b"<" not in word:
                return self[core] + self.signs[word[len(core):]]
            text = word.decode()
        elif len(core) < len(word):
            text = word.decode()
        if text.isalpha() and max(text) < "\u0100" and self.prefix in ("", " "):
            piece = (self.prefix + (text.lower() if self.lower else text)).encode().decode("latin-1")
            ids = [t.id for t in self.model.tokenize(piece.translate(self.SIGN_OF_BYTE))]
        else:
            ids = self.tokenizer.encode(self.prefix + text, add_special_tokens=False).ids
        return array(self.kind, ids).tobytes()


@lru_cache(maxsize=8)
def words(path: str, kind: str, prefix: str = "", kept: int = WORDS_KEPT) -> Words:
    """The table of the process: later tasks of a worker find the words of earlier ones."""
    return Words(path, kind, prefix, kept)


class Coded:
    """A stretch of text with its ids and their character spans."""

    __slots__ = ("text", "ids", "spans")

    def __init__(self, text: str, ids: list, spans: list):
        self.text, self.ids, self.spans = text, ids, spans


def coded(tok, text: str) -> Coded:
    found = tok.encode(text, add_special_tokens=False)
    return Coded(text, found.ids, found.offsets)


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    """The text in stretches of at most ``leaf`` characters, cut after white space where there is some."""
    cuts, at = [], 0
    while len(text) - at > leaf:
        end = at + leaf
        gap = max(text.rfind(c, at + 1, end) for c in GAP)
        end = gap + 1 if gap > at else end
        cuts.append(text[at:end])
        at = end
    return [*cuts, text[at:]]


def _alone(spans: list, i: int) -> bool:
    """Whether no neighbour has the same span, as parts of one character do."""
    return (i == 0 or spans[i - 1] != spans[i]) and (i + 1 == len(spans) or spans[i + 1] != spans[i])


def _shared(side: Coded, window: Coded, shift: int, order) -> tuple[int, int] | None:
    """``(index in side, index in window)`` of two neighbouring tokens that both have, first in ``order``."""
    at = {span: i for i, span in enumerate(side.spans)}
    for p in order:
        spans = [(a + shift, b + shift) for a, b in window.spans[p:p + 2]]
        i = at.get(spans[0])
        if i is not None and side.spans[i:i + 2] == spans and len(spans) == 2 \
                and side.ids[i:i + 2] == window.ids[p:p + 2] \
                and all(_alone(side.spans, i + k) and _alone(window.spans, p + k) for k in (0, 1)):
            return i, p
    return None


def joined(tok, left: Coded, right: Coded) -> Coded:
    """The two stretches as one."""
    text, cut = left.text + right.text, len(left.text)
    moved = [(a + cut, b + cut) for a, b in right.spans]
    if not left.text or not right.text or left.text[-1] in GAP:
        return Coded(text, left.ids + right.ids, left.spans + moved)
    size = WINDOW
    while True:
        lo, hi = max(cut - size, 0), min(cut + size, len(text))
        window = coded(tok, text[lo:hi])
        n = len(window.ids)
        head = (-1, -1) if lo == 0 else _shared(left, window, lo, range(n))
        tail = (len(moved), n) if hi == len(text) else \
            _shared(Coded("", right.ids, moved), window, lo, range(n - 2, -1, -1))
        if head and tail and head[1] < tail[1]:
            (i, p), (j, q) = head, tail
            spans = [(a + lo, b + lo) for a, b in window.spans]
            return Coded(text, left.ids[:i + 1] + window.ids[p + 1:q] + right.ids[j:],
                         left.spans[:i + 1] + spans[p + 1:q] + moved[j:])
        size *= 2


def tree(tok, parts: list[Coded]) -> Coded:
    """All stretches as one, joined pairwise level by level."""
    while len(parts) > 1:
        parts = [joined(tok, *parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row: the ids of the whole text and the text that they decode to.

    Null text counts as empty: no ids, empty text.  Repeated rows give repeated results."""
    path = path or default_path("word_bpe_49k.json")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    run = F.col("text").rlike(f"[^ \\t\\n\\r\\x0B\\f]{{{leaf + 1}}}")
    return _encode_words(rows.where(~run), path).union(_encode_runs(rows.where(run), path, leaf))


def _schema(docs: DataFrame) -> str:
    return f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>, decoded string"


def _result(tok, doc_ids: pa.Array, packed: list[bytes]) -> pa.RecordBatch:
    ids = [np.frombuffer(x, "<i4") for x in packed]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]), pa.int32())
    decoded = [tok.decode(x.tolist(), skip_special_tokens=False) for x in ids]
    return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(pa.array(ends), flat),
                                       pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])


def _encode_words(rows: DataFrame, path: str) -> DataFrame:
    def work(batches):
        known, tok = words(path, "<i4", kept=TEXT_WORDS_KEPT), tokenizer(path)
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 512):
                    part = batch.slice(lo, 512)
                    # this tokenizer lowers case itself; names of special tokens, which hold a "<", keep theirs
                    texts = [x if b"<" in x else x.lower() for x in text_bytes(part.column(1))]
                    yield _result(tok, part.column(0), [b"".join(map(known.__getitem__, x.split())) for x in texts])
        finally:
            # the worker goes on with other stages, which have no use for the words
            known.forget()
    return rows.mapInArrow(work, _schema(rows))


def _encode_runs(rows: DataFrame, path: str, leaf: int) -> DataFrame:
    kind = dict(rows.dtypes)["doc_id"]

    def split(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                parts = leaves(batch.column(2)[row].as_py(), leaf)
                same = pa.array([row] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(same), batch.column(1).take(same), pa.array(range(len(parts)), pa.int32()),
                     pa.array(parts, pa.string())], ["row", "doc_id", "leaf", "text"])

    def code(batches):
        tok = tokenizer(path)
        for batch in batches:
            found = [coded(tok, x) for x in batch.column(3).to_pylist()]
            flat = [pa.array([[s[k] for s in c.spans] for c in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.ids for c in found], pa.list_(pa.int32())), *flat],
                ["row", "doc_id", "leaf", "text", "ids", "starts", "ends"])

    def join(table: pa.Table) -> pa.Table:
        tok = tokenizer(path)
        parts = sorted(table.to_pylist(), key=lambda r: r["leaf"])
        whole = tree(tok, [Coded(r["text"], r["ids"], list(zip(r["starts"], r["ends"]))) for r in parts])
        made = _result(tok, table.column("doc_id").combine_chunks()[:1], [np.array(whole.ids, "<i4").tobytes()])
        return pa.Table.from_batches([made])

    base = f"row long, doc_id {kind}, leaf int, text string"
    cut = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(split, base)
    done = cut.repartition("row", "leaf").mapInArrow(code, f"{base}, ids array<int>, starts array<int>, ends array<int>")
    return done.groupBy("row").applyInArrow(join, _schema(rows))
