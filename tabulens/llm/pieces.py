"""SentencePiece BPE encoding and decoding of whole texts by vectorised merge rounds.

Text is cut into words (white space goes with the word behind it), and words into segments wherever
two neighbouring characters stand together in no piece of the model, so that no merge can cross a
cut.  The symbols of all new words of a slice lie in one flat array.  A round finds the smallest
pair rank of every segment, merges the leftmost pairs of that rank in all segments at once and
closes the gaps; segments without a pair leave the array.  One round may merge several pairs of a
segment only as far as merging them one by one, from the left, would do the same: the first merge
whose new neighbours rank no worse than the pair itself ends the round for its segment.

The words of a text are met again and again, so their ids are kept in a bounded table per process;
words longer than ``LONG_WORD`` characters are not kept.  A segment that still merges after
``ROUNDS`` rounds (runs of one character, very long words) is finished pair by pair with a heap,
in the same order, so that time does not grow with the square of its length."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tabulens.llm.common import slices, text_bytes

SPACE_SIGN = "▁"
WORD = re.compile(" *[^ ]+| +")
LONG_WORD = 64
WORDS_KEPT = 500_000
PIECE_CHARS = 1 << 20
ROUNDS = 256
NONE = np.iinfo(np.int32).max
CODE_POINTS = 0x110000


def default_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def prefixed(text: str) -> str:
    """The text with the space that the model puts in front; both signs of a space are one."""
    return " " + text.replace(SPACE_SIGN, " ") if text else ""


def stretches(text: str):
    """The prefixed text in stretches of whole words, about ``PIECE_CHARS`` characters each."""
    text, lo = prefixed(text), 0
    while lo < len(text):
        hi = lo + PIECE_CHARS
        while 0 <= hi < len(text) and not (text[hi] == " " != text[hi - 1]):
            hi = text.find(" ", hi + 1)
        hi = len(text) if hi < 0 else min(hi, len(text))
        yield text[lo:hi]
        lo = hi


class Pieces:
    """The merge rules of a model file: identity normaliser, dummy prefix, byte fallback, no user-defined symbols.

    Symbols are the pieces by their ids, then the characters that only stand inside pieces; one more
    stands for every other character."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.byte_ids = np.zeros(256, np.int32)
        for i in filter(model.is_byte, range(size)):
            self.byte_ids[int(names[i][1:-1], 16)] = i
        symbols = {names[i]: i for i in plain}
        for sign in sorted({c for i in plain for c in names[i]} - set(symbols)):
            symbols[sign] = size + len(symbols) - len(plain)
        self.size, self.unknown = size, size + len(symbols) - len(plain)
        self.of_char = np.full(CODE_POINTS, self.unknown, np.int32)
        for name, i in symbols.items():
            if len(name) == 1:
                self.of_char[ord(name)] = i
        rank = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        rules, touching = [], set()
        for i in plain:
            name = names[i]
            for k in range(1, len(name)):
                touching.add(ord(name[k - 1]) * CODE_POINTS + ord(name[k]))
                left, right = symbols.get(name[:k]), symbols.get(name[k:])
                if left is not None and right is not None:
                    rules.append((left * (self.unknown + 1) + right, rank[model.get_score(i)], i))
        self.pairs, self.ranks, self.made = np.array(sorted(rules), np.int64).reshape(-1, 3).T
        self.touching = np.array(sorted(touching), np.int64)
        hidden = [*filter(model.is_control, range(size))]
        self.bytes_of = [n.replace(SPACE_SIGN, " ").encode() for n in names]
        for i in hidden:
            self.bytes_of[i] = b""
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.model = model
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of neighbouring symbols; ``NONE`` where they do not merge."""
        keys = left.astype(np.int64) * (self.unknown + 1) + right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        hit = self.pairs[at] == keys
        return np.where(hit, self.ranks[at], NONE).astype(np.int32), self.made[at].astype(np.int32)

    def segments(self, points: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
        """Where segments begin: at words, and where two characters stand together in no piece."""
        keys = points[:-1].astype(np.int64) * CODE_POINTS + points[1:]
        at = np.minimum(np.searchsorted(self.touching, keys), len(self.touching) - 1)
        starts = np.concatenate([[True], self.touching[at] != keys])
        starts[word_starts] = True
        return starts

    def merged(self, points: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
        """The symbol that begins at each character after all merges; -1 inside a symbol."""
        out = np.full(len(points), -1, np.int32)
        sym = self.of_char[points]
        begins = self.segments(points, word_starts)
        place, seg = np.arange(len(points)), np.cumsum(begins) - 1
        rank, product = self._pairs_of(sym, seg)
        for turn in range(ROUNDS + 1):
            first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            least = np.minimum.reduceat(rank, first)
            width = np.diff(np.append(first, len(seg)))
            done = np.repeat(least == NONE, width)
            out[place[done]] = sym[done]
            if done.all():
                return out
            if done.any():
                left = ~done
                sym, seg, place, rank, product = (x[left] for x in (sym, seg, place, rank, product))
                width, least = width[least != NONE], least[least != NONE]
                first = np.cumsum(width) - width
            if turn == ROUNDS:
                break
            chosen = self._chosen(sym, seg, rank, product, first, width, np.repeat(least, width))
            sym = np.where(chosen, product, sym)
            keep = ~np.concatenate([[False], chosen[:-1]])
            stale = (chosen | np.append(chosen[1:], False) | np.append(chosen[2:], [False, False]))[keep]
            sym, seg, place, rank, product = (x[keep] for x in (sym, seg, place, rank, product))
            rank[stale], product[stale] = self._pairs_of(sym, seg, np.flatnonzero(stale))
        for lo, n in zip(first.tolist(), width.tolist()):
            kept, places = self.finish(sym[lo:lo + n].tolist(), place[lo:lo + n])
            out[places] = kept
        return out

    def _pairs_of(self, sym, seg, at=None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and product of each symbol (or those ``at`` the given places) with the next one of its segment."""
        at = np.arange(len(sym)) if at is None else at
        after = np.minimum(at + 1, len(sym) - 1)
        rank, product = self.pair(sym[at], sym[after])
        rank[(after == at) | (seg[after] != seg[at])] = NONE
        return rank, product

    def _chosen(self, sym, seg, rank, product, first, width, least) -> np.ndarray:
        """The pairs of the smallest rank that merge in this round, as a mask of their left symbols."""
        index = np.arange(len(sym))
        flagged = rank == least
        opens = flagged & ~np.concatenate([[False], flagged[:-1]])
        chosen = flagged & ((index - np.maximum.accumulate(np.where(opens, index, 0))) % 2 == 0)
        at = np.flatnonzero(chosen)
        worst = np.full(len(at), NONE, np.int32)
        behind = at + 2
        some = behind < len(sym)
        some[some] = seg[behind[some]] == seg[at[some]]
        worst[some] = self.pair(product[at[some]], sym[behind[some]])[0]
        some = at > 0
        some[some] = seg[at[some] - 1] == seg[at[some]]
        before = at[some] - 1
        left = np.where(chosen[before - 1] & (before > 0), product[before - 1], sym[before])
        worst[some] = np.minimum(worst[some], self.pair(left, product[at[some]])[0])
        stops = np.full(len(sym), len(sym))
        bad = at[worst <= least[at]]
        stops[bad] = bad
        return chosen & (index <= np.repeat(np.minimum.reduceat(stops, first), width))

    def finish(self, sym: list, places: np.ndarray) -> tuple[list, np.ndarray]:
        """The rest of one segment, pair by pair: best rank first, leftmost on ties."""
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, product = self.pair(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(r, i, sym[i], sym[i + 1], p) for i, (r, p) in enumerate(zip(rank.tolist(), product.tolist())) if r != NONE]
        heapq.heapify(heap)
        known: dict[tuple, tuple] = {}

        def offer(i: int, j: int) -> None:
            pair = sym[i], sym[j]
            if pair not in known:
                r, p = self.pair(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = int(r[0]), int(p[0])
            if known[pair][0] != NONE:
                heapq.heappush(heap, (known[pair][0], i, *pair, known[pair][1]))

        while heap:
            _, i, left, right, p = heapq.heappop(heap)
            j = after[i]
            if j < 0 or sym[i] != left or sym[j] != right:
                continue
            sym[i], sym[j], after[i] = p, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        kept = [i for i in range(n) if sym[i] >= 0]
        return [sym[i] for i in kept], places[kept]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word (white space in front of it included)."""
        if not words:
            return []
        points = np.frombuffer("".join(words).replace(" ", SPACE_SIGN).encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        out = self.merged(points, np.concatenate([[0], ends[:-1]]))
        opens = out >= 0
        sym = out[opens]
        strange = sym >= self.size
        signs = points[opens][strange]
        lengths = np.ones(len(sym), np.int64)
        lengths[strange] = 1 + (signs >= 0x80) + (signs >= 0x800) + (signs >= 0x10000)
        ids = np.repeat(sym, lengths).astype("<i4")
        raw = signs.astype("<u4").tobytes().decode("utf-32-le").encode()
        ids[np.repeat(strange, lengths)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        cuts = upto[np.concatenate([[0], np.cumsum(opens)])[np.concatenate([[0], ends])]] * 4
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def learn(self, words: set[str]) -> None:
        """Put words into the table; what the older table holds moves on, the rest is encoded together."""
        new = words.difference(self.table)
        moved = new & self.older.keys()
        rest = sorted(new - moved)
        if len(self.table) + len(new) > WORDS_KEPT:
            self.older, self.table = self.table, {w: self.table[w] for w in words & self.table.keys()}
        self.table.update((w, self.older[w]) for w in moved if w in self.older)
        rest += [w for w in moved if w not in self.table]
        self.table.update(zip(rest, self.encode_words(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian ids of each text, with begin and end."""
        begin, end = (np.array([i], "<i4").tobytes() for i in (self.begin, self.end))
        if sum(map(len, texts)) > 4 * PIECE_CHARS:  # a very long text: one stretch after the other
            bodies = [b"".join(self._packed([part])[0] for part in stretches(t)) for t in texts]
        else:
            bodies = self._packed([prefixed(t) for t in texts])
        return [begin + body + end for body in bodies]

    def _packed(self, texts: list[str]) -> list[bytes]:
        found = [WORD.findall(t) for t in texts]
        distinct = set().union(*found)
        long = [w for w in distinct if len(w) > LONG_WORD]
        self.learn(distinct.difference(long))
        table = self.table
        table.update(zip(long, self.encode_words(long)))
        packed = [b"".join(map(table.__getitem__, words)) for words in found]
        for word in long:
            del table[word]
        return packed

    def decode(self, packed: bytes) -> str:
        """The text of ids as the library gives it: one space in front goes, broken bytes become U+FFFD."""
        ids = np.frombuffer(packed, "<i4").tolist()
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return self.model.decode(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """The rules and words of the process: later tasks of a worker find what earlier ones made."""
    return Pieces(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row: the ids of the whole text with begin and end, packed as
    little-endian unsigned 32-bit integers, and the text that they decode to.

    Null text counts as empty: begin and end alone, empty text.  Repeated rows give repeated results, an
    empty table an empty one; other columns are not read."""
    path = path or default_path()

    def work(batches):
        made = pieces(path)
        for batch in batches:
            for part in slices(batch, 1):
                packed = made.encode([t.decode("utf-8", "replace") for t in text_bytes(part.column(1))])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(packed, pa.binary()), pa.array(map(made.decode, packed), pa.string())],
                    ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary, decoded string")


def unpacked(ids: bytes) -> list[int]:
    """The ids of one row as numbers."""
    return np.frombuffer(ids, "<u4").tolist()
