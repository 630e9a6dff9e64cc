"""Documents that hold a passage of a benchmark item, exact or slightly edited.

Texts are lowered (A-Z) and their white space runs made one space.  A window starts at every word of a
document and of an item; the CGK walk maps it to a string in
which small edit distance is small Hamming distance: at step ``j`` it writes the character under
its pointer and moves on by a random bit that depends on ``j`` and the character, so that two walks
fall into step again after an insertion.  Each of ``TABLES`` hash tables samples ``SAMPLED`` places
of the string; windows that meet an item in one table, and whose whole walks differ in at
most ``APART`` of their steps, are candidates.  A candidate gives the place
where the whole item should stand, and the exact edit distance there (bit-parallel, over all ends)
decides.

Items shorter than the walk use a shorter walk.  Short items, heavily edited ones and text without
spaces have few windows or none that meet, so disjoint pieces of the items propose places too: of enough
pieces one has a single edit at most, and so have ever longer rows of pieces around it their share; this
loses no place (``Pieces``).  Items under ``WHOLE`` bytes are searched as they are, between spaces."""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tabulens.llm.common import map_rows, text_bytes

SIMILARITY = 0.8
TABLES = 6
SAMPLED = 10
APART = 0.3
STEPS = (56, 20)
WHOLE = 12
LONGEST_PIECE = 31
FILTER_BITS = 20
PLACES_AT_ONCE = 24 << 10
HITS_AT_ONCE = 1 << 13
HITS_HELD = 1 << 18
WINDOWS_AT_ONCE = 1 << 14
BYTES_AT_ONCE = 1 << 20
ITEMS_AT_ONCE = 20_000
ITEM_BYTES_AT_ONCE = 4 << 20
SEED = 20_17


def normalised(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def word_starts(text: np.ndarray) -> np.ndarray:
    """Places of the first bytes of the words of a normalised text."""
    return np.concatenate([[0], np.flatnonzero(text == 32) + 1]) if len(text) else np.zeros(0, np.int64)


@lru_cache(maxsize=4096)
def _codes(item: bytes) -> dict[int, int]:
    codes: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        codes[c] |= 1 << i
    return codes


@lru_cache(maxsize=1 << 14)
def edit_distance_within(item: bytes, region: bytes) -> tuple[int, int]:
    """``(distance, end)``: the least edit distance of the item to any stretch of the region, and where
    the first such stretch ends. Myers' bit vectors."""
    exact = region.find(item)
    if exact >= 0:
        return 0, exact + len(item)
    codes, m = _codes(item), len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(region):
        eq = codes.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        score += (ph & high != 0) - (mh & high != 0)
        if score < best:
            best, end = score, i + 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
    return best, end


class Walk:
    """The embedding of ``steps`` steps and its hash tables; the same on every machine."""

    def __init__(self, steps: int, tables: int = TABLES, sampled: int = SAMPLED):
        random = np.random.default_rng(SEED)
        self.steps, self.tables = steps, tables
        self.moves = random.integers(0, 2, (steps, 256)).astype(np.int64)
        # what the sign met at a step adds to the hash of a table that samples this step
        self.adds: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(steps)]
        for t in range(tables):
            for j in sorted(random.choice(steps, min(sampled, steps), replace=False).tolist()):
                self.adds[j].append((t, random.integers(0, 1 << 32, 256, dtype=np.uint32)))

    def hashes(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of hashes per table for the windows at ``starts``; ``text`` ends in ``steps`` zeros at least."""
        at, found = starts.astype(np.int64), np.zeros((self.tables, len(starts)), np.uint32)
        signs, add = np.zeros(len(starts), np.uint8), np.zeros(len(starts), np.uint32)
        move, index = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.intp)
        for j in range(self.steps):
            np.take(text, at, out=signs, mode="clip")
            index[:] = signs
            for t, values in self.adds[j]:
                np.take(values, index, out=add, mode="clip")
                found[t] += add
            np.take(self.moves[j], index, out=move, mode="clip")
            at += move
        return found

    def strings(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The embedded strings themselves, one row per window."""
        at, out = starts.astype(np.int64), np.zeros((len(starts), self.steps), np.uint8)
        for j in range(self.steps):
            out[:, j] = np.take(text, at, mode="clip")
            at += self.moves[j][out[:, j]]
        return out


class Tables:
    """Windows of the items of one walk length, by table and hash."""

    def __init__(self, steps: int, items: list[tuple[int, bytes]]):
        self.walk = Walk(steps)
        places, found, strings = [], [], []
        for number, (_, text) in enumerate(items):
            signs = np.frombuffer(text, np.uint8)
            starts = word_starts(signs)
            # a window has the whole walk inside its item
            starts = starts[starts + steps <= len(signs)]
            places += [(number, s) for s in starts.tolist()]
            whole = np.concatenate([signs, np.zeros(steps, np.uint8)])
            found.append(self.walk.hashes(whole, starts))
            strings.append(self.walk.strings(whole, starts))
        self.items = items
        self.strings = np.concatenate([np.zeros((0, steps), np.uint8), *strings])
        hashes = np.concatenate(found, axis=1) if found else np.zeros((TABLES, 0), np.uint32)
        self.order = np.argsort(hashes, axis=1, kind="stable")
        self.hashes = np.take_along_axis(hashes, self.order, axis=1)
        self.places = np.array(places, np.int64).reshape(-1, 2)
        self.seen = np.zeros((TABLES, 1 << FILTER_BITS), bool)
        for t in range(TABLES):
            self.seen[t, self.hashes[t] >> np.uint32(32 - FILTER_BITS)] = True

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> set[tuple[int, int, int]]:
        """``(window, item number, bytes of the item before the window)`` of windows that meet in a table and
        whose walks differ in at most ``APART`` of all steps."""
        out = set()
        for lo in range(0, len(starts), WINDOWS_AT_ONCE):
            part = starts[lo:lo + WINDOWS_AT_ONCE]
            found = self.walk.hashes(text, part)
            pairs = [np.zeros((2, 0), np.int64)]
            for t in range(TABLES):
                maybe = np.flatnonzero(np.take(self.seen[t], found[t] >> np.uint32(32 - FILTER_BITS), mode="clip"))
                keys = found[t][maybe]
                a, b = np.searchsorted(self.hashes[t], keys), np.searchsorted(self.hashes[t], keys, "right")
                often = b - a
                entry = np.arange(often.sum()) + np.repeat(a - (np.cumsum(often) - often), often)
                pairs.append(np.stack([np.repeat(maybe, often), self.order[t][entry]]))
            window, entry = np.unique(np.concatenate(pairs, axis=1), axis=1)
            if not len(window):
                continue
            few, which = np.unique(window, return_inverse=True)
            apart = (self.walk.strings(text, part[few])[which] != self.strings[entry]).sum(axis=1)
            near = apart <= APART * self.walk.steps
            out |= set(zip((window[near] + lo).tolist(), *self.places[entry[near]].T.tolist()))
        return out


class Lookup:
    """Entries by 32-bit key, behind two small filters over the high and the low bits."""

    def __init__(self, keys: np.ndarray, entries: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.entries = entries[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.shift = np.uint32(32 - min(max(len(keys) * 8, 1 << 12).bit_length(), FILTER_BITS))
        self.seen = np.zeros(1 << 32 - int(self.shift), bool)
        self.seen[self.keys >> self.shift] = True
        self.low = np.uint32(len(self.seen) - 1)
        self.seen_low = np.zeros(len(self.seen), bool)
        self.seen_low[self.keys & self.low] = True

    def held(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key may be held; surely not where False."""
        return np.take(self.seen, keys >> self.shift, mode="clip")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(index, entry)`` of all keys that are held."""
        maybe = np.flatnonzero(self.held(keys))
        some = np.take(keys, maybe)
        again = np.take(self.seen_low, some & self.low, mode="clip")
        maybe, some = maybe[again], some[again]
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        known = self.keys[at] == some
        maybe, at = maybe[known], at[known]
        often = self.last[at] - self.first[at]
        entry = np.arange(often.sum()) + np.repeat(self.first[at] - (np.cumsum(often) - often), often)
        return np.repeat(maybe, often), self.entries[entry]


class Pieces:
    """Disjoint pieces of ``size`` bytes of items, to find all places within the allowed number of edits.

    An item of ``p`` pieces with fewer than ``2 p`` edits has a piece with one edit at most.  Such a piece meets
    the text in one of these keys: a byte of the piece left out, one place of both left open, a byte of the text
    left out.  A piece so found must have a neighbourhood that fits as well: ``m`` pieces in a row with at most
    ``2 m - 1`` edits, for rows of two, four and more up to a 64-bit word.  Of two halves with more edits than
    allowed the whole would have too many, so no place is lost."""

    def __init__(self, size: int, items: list[tuple[int, bytes]], allowed: list[int]):
        self.size, self.items, self.allowed = size, items, np.array(allowed, np.int64)
        self.row = 63 // size
        texts = [np.frombuffer(t, np.uint8) for _, t in items]
        self.lengths = np.array([len(t) for t in texts], np.int64)
        pieces = self.lengths // size
        self.owner = np.repeat(np.arange(len(items)), pieces)
        number = np.arange(len(self.owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.offset = number * size
        rows = -(-pieces // self.row)
        self.pieces_of, self.rows, self.first_row = pieces, rows, np.cumsum(rows) - rows
        # the row of a piece, its number in the row and the pieces of the row
        self.row_of = np.repeat(self.first_row, pieces) + number // self.row
        self.in_row = number % self.row
        self.row_pieces = np.minimum(np.repeat(pieces, pieces) - (number - self.in_row), self.row)
        grams = np.concatenate([t[:n * size].reshape(n, size) for t, n in zip(texts, pieces.tolist())])
        self._index(grams)
        self.sign = np.zeros(256, np.int16)
        used = np.unique(grams)
        self.sign[used] = np.arange(1, len(used) + 1)
        self.signs = len(used) + 1
        self.where = np.zeros((int(rows.sum()), self.signs), np.uint64)
        bit = (self.in_row * size)[:, None] + np.arange(size)
        np.bitwise_or.at(self.where, (np.repeat(self.row_of, size), self.sign[grams].ravel()),
                         np.uint64(1) << bit.ravel().astype(np.uint64))

    def _index(self, grams: np.ndarray) -> None:
        size, entries = self.size, np.arange(len(grams))
        self.weights = np.random.default_rng(SEED).integers(0, 1 << 31, size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        parts = grams * self.weights
        whole = parts.sum(axis=1, dtype=np.uint32)
        self.whole = Lookup(whole, entries)
        self.open = {j: Lookup(whole - parts[:, j], entries) for j in range(1, size - 1)}
        # pieces without one of their thirds
        self.third = a = size // 3
        ends = parts[:, :a].sum(axis=1, dtype=np.uint32) + parts[:, size - a:].sum(axis=1, dtype=np.uint32)
        self.fronts = Lookup(parts[:, :size - a].sum(axis=1, dtype=np.uint32), entries)
        self.ends = Lookup(ends, entries)
        self.backs = Lookup((grams[:, a:] * self.weights[:size - a]).sum(axis=1, dtype=np.uint32), entries)
        less = [(np.delete(grams, j, axis=1) * self.weights[:-1]).sum(axis=1, dtype=np.uint32) for j in range(size)]
        self.less = Lookup(np.concatenate(less), np.tile(entries, size))

    def met(self, text: np.ndarray):
        """``(places, entries)`` of pieces with one edit at most, block by block; a place may be up to two
        bytes before its text, or one behind."""
        size = self.size
        for lo in range(0, len(text), PLACES_AT_ONCE):
            n = min(PLACES_AT_ONCE, len(text) - lo)
            part = text[lo:lo + n + size + 1]
            part = np.concatenate([part, np.zeros(n + size + 1 - len(part), np.uint8)]).astype(np.uint32)
            parts = [part[i:i + n + 1] * self.weights[i] for i in range(size)]
            before = [np.zeros(n + 1, np.uint32)]
            for some in parts:
                before.append(before[-1] + some)
            whole = before[size]
            # with one edit at most two thirds are as they are: those before the edit at the place itself, those behind it
            # near their own place
            a, b = self.third, size - self.third
            front, back = self.fronts.held(before[b][:n]), self.backs.held(before[b])
            back, tail = np.concatenate([back, np.ones(a + 1, bool)]), whole - before[b]
            tail = np.concatenate([tail[:1], tail])
            backs = {gap: back[max(a + gap, 0):][:n] for gap in (-1, 0, 1)}
            ends = {gap: self.ends.held(before[a][:n] + tail[1 + gap:][:n]) for gap in (-1, 0, 1)}
            # the byte before the block is not at hand
            ends[-1][0] = True
            either = np.flatnonzero(front | backs[-1] | ends[-1])
            fronts, backs, ends = np.flatnonzero(front), *({g: np.flatnonzero(x[g]) for g in (0, 1)} for x in (backs, ends))
            probes = [(self.less, before[size - 1], either)]
            probes += [(table, whole - parts[j], backs[0] if j < a else ends[0] if j < b else fronts) for j, table in self.open.items()]
            probes += [(self.whole, before[j][:n] + (whole - before[j])[1:], backs[1] if j <= a else ends[1] if j < b else fronts)
                       for j in range(1, size)]
            found = []
            for table, keys, at in probes:
                index, entry = table.find(np.take(keys, at))
                found.append((at[index], entry))
            place, entry = (np.concatenate(x) for x in zip(*found))
            both = np.unique(entry * (n + 1) + place)
            # of two places side by side the first will do
            beside = np.flatnonzero(np.concatenate([[False], np.diff(both) == 1]))
            odd = np.concatenate([[True], np.diff(beside) > 1])
            runs = np.arange(len(beside)) - np.maximum.accumulate(np.where(odd, np.arange(len(beside)), 0)) if len(beside) else beside
            both = np.delete(both, beside[runs % 2 == 0])
            yield both % (n + 1) + lo, both // (n + 1)

    def places(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(item numbers, places)``: where items may begin, up to the allowed edits and two bytes more.
        Of places of an item as near as its allowed edits the first stands for all."""
        kept, held, waiting, signs = [], [], 0, np.take(self.sign, text)
        for found in self.met(text):
            held.append(found)
            waiting += len(found[0])
            if waiting >= HITS_HELD:
                kept.append(self._fitting(signs, held))
                held, waiting = [], 0
        kept.append(self._fitting(signs, held))
        return tuple(np.concatenate(x) for x in zip(*kept))

    def _fitting(self, text: np.ndarray, held: list) -> tuple[np.ndarray, np.ndarray]:
        place, entry = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held) if held else ((), ())))
        wide = 2
        while True:
            fits = [self._near(text, place[i:i + HITS_AT_ONCE], entry[i:i + HITS_AT_ONCE], min(wide, self.row))
                    for i in range(0, len(place), HITS_AT_ONCE)]
            fits = np.concatenate([np.zeros(0, bool), *fits])
            place, entry = place[fits], entry[fits]
            if wide >= self.row:
                break
            wide *= 2
        item, start = self.owner[entry], place - self.offset[entry]
        order = np.lexsort((start, item))
        item, start = item[order], start[order]
        stretch = start // (self.allowed[item] + 1)
        first = np.ones(len(item), bool)
        first[1:] = (item[1:] != item[:-1]) | (stretch[1:] != stretch[:-1])
        return item[first], start[first]

    def _near(self, text: np.ndarray, place: np.ndarray, entry: np.ndarray, wide: int) -> np.ndarray:
        """Whether ``wide`` pieces in a row around each met piece stand there within their edits (Myers' bit
        vectors, all rows side by side)."""
        skipped = self.in_row[entry] // wide * wide
        pieces = np.minimum(self.row_pieces[entry] - skipped, wide)
        edits = np.minimum(2 * pieces - 1, self.allowed[self.owner[entry]])
        at = place - (self.in_row[entry] - skipped) * self.size
        return self._least(text, at, self.row_of[entry], skipped, pieces, edits) <= edits

    def possible(self, text: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Whether the rows of an item that begins at ``start``, or up to its allowed edits later, have together no more
        edits than allowed."""
        rows, text = self.rows[item], np.take(self.sign, text)
        case = np.repeat(np.arange(len(item)), rows)
        number = np.arange(len(case)) - np.repeat(np.cumsum(rows) - rows, rows)
        pieces = np.minimum(self.pieces_of[item][case] - number * self.row, self.row)
        at = start[case] + number * self.row * self.size
        least = np.zeros(len(case), np.int64)
        # items of much the same length together
        for some in np.array_split(np.argsort(self.allowed[item][case], kind="stable"), len(case) // HITS_AT_ONCE + 1):
            least[some] = self._least(text, at[some], self.first_row[item][case][some] + number[some], 0 * some, pieces[some],
                                      2 * self.allowed[item][case][some])
        return np.bincount(case, least, len(item)) <= self.allowed[item]

    def _least(self, text: np.ndarray, at: np.ndarray, row: np.ndarray, skipped: np.ndarray, pieces: np.ndarray,
               room: np.ndarray) -> np.ndarray:
        """The least edits of some pieces of a row that stand at ``at``, give or take ``room`` bytes, in a text of numbered signs."""
        if not len(at):
            return np.zeros(0, np.int64)
        at, steps = (at - room - 1).astype(np.int64), int((pieces * self.size + 2 * room + 4).max())
        row, shift = row * self.signs, (skipped * self.size).astype(np.uint64)
        last, where, one = (pieces * self.size - 1).astype(np.uint64), self.where.ravel(), np.uint64(1)
        up, down = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
        score = pieces * self.size
        best = score.copy()
        for _ in range(steps):
            same = np.take(where, row + np.take(text, at, mode="clip"))
            same >>= shift
            across = same & up
            across += up
            across ^= up
            across |= same
            less = up & across
            across |= up
            more = ~across
            more |= down
            score += (more >> last & one).view(np.int64)
            score -= (less >> last & one).view(np.int64)
            np.minimum(best, score, out=best)
            more <<= one
            less <<= one
            same |= down
            down = more & same
            same |= more
            up = ~same
            up |= less
            at += 1
        return best


class Items:
    """Benchmark items, ready to be searched in documents."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY):
        self.similarity = similarity
        items = [(i, t) for i, t in items if t]
        groups, rest = [], items
        for steps in STEPS:
            groups.append((steps, [x for x in rest if len(x[1]) >= steps]))
            rest = [x for x in rest if len(x[1]) < steps]
        self.tables = [Tables(steps, some) for steps, some in groups if some]
        self.short = [x for x in items if len(x[1]) < WHOLE]
        by_size = defaultdict(list)
        for x in items:
            if len(x[1]) >= WHOLE:
                n, k = len(x[1]), self.allowed(x[1])
                # the longest pieces of which one has one edit at most
                by_size[next(q for q in range(LONGEST_PIECE, 0, -1) if 2 * (n // q) > k)].append((x, k))
        self.pieces = [Pieces(size, [x for x, _ in some], [k for _, k in some]) for size, some in sorted(by_size.items())]
        self.home = {x: (group, i) for group, pieces in enumerate(self.pieces) for i, x in enumerate(pieces.items)}

    def allowed(self, item: bytes) -> int:
        return int((1 - self.similarity) * len(item) + 1e-9)

    def found(self, texts: list[bytes]) -> list[list[dict]]:
        """The items in each normalised text: id, distance, similarity and end of the place."""
        gap = np.zeros(max(STEPS), np.uint8)
        parts, starts, bases, at = [], [], [], 0
        for text in texts:
            signs = np.frombuffer(text, np.uint8)
            starts.append(word_starts(signs) + at)
            bases.append(at)
            parts += [signs, gap]
            at += len(signs) + len(gap)
        whole, where = np.concatenate([*parts, gap]), np.concatenate([np.zeros(0, np.int64), *starts])
        best: list[dict] = [{} for _ in texts]
        begins = np.array(bases, np.int64)
        walked: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for table in self.tables:
            for window, number, offset in table.candidates(whole, where):
                group, at = self.home[table.items[number]]
                walked[group].add((at, int(where[window]) - offset))
        spots: dict[tuple[int, tuple], set[int]] = defaultdict(set)
        for group, pieces in enumerate(self.pieces):
            number, place = pieces.places(whole)
            more = np.array(sorted(walked[group]), np.int64).reshape(-1, 2).T
            # a walk's window may have as many edits before it as are allowed
            number, place = np.concatenate([number, more[0]]), np.concatenate([place, more[1]])
            fits = pieces.possible(whole, number, place)
            number, place = number[fits], place[fits]
            edits, lengths = pieces.allowed[number], pieces.lengths[number]
            lo = np.maximum(np.searchsorted(begins, place - edits - 1, "right") - 1, 0)
            hi = np.searchsorted(begins, place + lengths + 3 * edits + 2)
            for i, at, a, b in zip(number.tolist(), place.tolist(), lo.tolist(), hi.tolist()):
                for doc in range(a, b):
                    spots[doc, pieces.items[i]].add(at - bases[doc])
        for (doc, item), places in spots.items():
            self._verify(texts[doc], *item, places, best[doc])
        for item_id, item in self.short:
            for text, held in zip(texts, best):
                at = (b" " + text + b" ").find(b" " + item + b" ")
                if at >= 0:
                    held[item_id] = 0, len(item), at + len(item)
        return [[{"item_id": i, "distance": d, "similarity": 1 - d / n, "end": e} for i, (d, n, e) in sorted(held.items())]
                for held in best]

    def _verify(self, text: bytes, item_id: int, item: bytes, places: set[int], best: dict) -> None:
        allowed, done = self.allowed(item), None
        for place in sorted(places):
            if done is not None and place - done <= allowed:
                continue  # the region looked at last covers this place
            lo = max(place - allowed - 1, 0)
            self._compare(text, item_id, item, lo, max(place + len(item) + 3 * allowed + 2, 0), best)
            done = place

    def _compare(self, text: bytes, item_id: int, item: bytes, lo: int, hi: int, best: dict) -> None:
        """Keep the nearest place, the first of equal ones."""
        if min(hi, len(text)) - lo < len(item) - self.allowed(item):
            return
        distance, end = edit_distance_within(item, text[lo:hi])
        known = best.get(item_id)
        if distance <= self.allowed(item) and (known is None or (distance / len(item), lo + end) < (known[0] / known[1], known[2])):
            best[item_id] = distance, len(item), lo + end


def in_groups(texts: list[bytes]):
    """Normalised texts in groups of about ``BYTES_AT_ONCE``, in order."""
    held, size = [], 0
    for text in texts:
        held.append(normalised(text))
        size += len(held[-1])
        if size >= BYTES_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def item_blocks(items: DataFrame) -> list[Broadcast]:
    """The items, broadcast in blocks of at most ``ITEMS_AT_ONCE`` items and about ``ITEM_BYTES_AT_ONCE`` bytes; the driver
    holds one block at a time.

    Null and empty items match nothing; items with a null id are left out."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text") \
        .orderBy("item_id", "text").toLocalIterator()
    blocks, held, size, context = [], [], 0, items.sparkSession.sparkContext
    for row in rows:
        held.append((row["item_id"], normalised(row["text"].encode())))
        size += len(held[-1][1])
        if len(held) == ITEMS_AT_ONCE or size >= ITEM_BYTES_AT_ONCE:
            blocks.append(context.broadcast(held))
            held, size = [], 0
    return [*blocks, context.broadcast(held)] if held or not blocks else blocks


_BUILT: dict[tuple, Items] = {}


def built(block: Broadcast, key: tuple, similarity: float) -> Items:
    """The search structure of a block, made once a process; the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Items(block.value, similarity)
    return _BUILT[key]


MATCH = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64()),
                            ("end", pa.int32())]))


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``(doc_id, item_id, distance, similarity, end)``: the items that stand in a document with a similarity
    of at least ``similarity`` (1 minus edit distance over item length, in bytes of the normalised texts);
    ``end`` is where the place ends in the normalised text.

    Null and empty texts hold nothing. Repeated rows give repeated results."""
    kind, out = dict(docs.dtypes)["doc_id"], None
    for block in item_blocks(items):
        key = uuid4().hex, similarity

        def work(batches, block=block, key=key):
            held = built(block, key, similarity)
            for batch in batches:
                found = [m for some in in_groups(text_bytes(batch.column(1))) for m in held.found(some)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, MATCH)], ["doc_id", "found"])
        part = map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, found array<struct<item_id long, distance int,"
                                                  " similarity double, end int>>", work) \
            .select("doc_id", F.explode("found").alias("m")).select("doc_id", "m.*")
        out = part if out is None else out.union(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows that hold no item, all columns as they are, without a shuffle."""
    at = docs.columns.index("text")
    for block in item_blocks(items):
        key = uuid4().hex, similarity

        def work(batches, block=block, key=key):
            held = built(block, key, similarity)
            for batch in batches:
                keep = [not m for some in in_groups(text_bytes(batch.column(at))) for m in held.found(some)]
                yield batch.filter(pa.array(keep, pa.bool_()))
        docs = docs.mapInArrow(work, docs.schema)
    return docs
