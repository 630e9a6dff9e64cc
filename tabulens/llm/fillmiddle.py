"""Fill-in-middle forms of whole texts, cut at seeded ranks by an indexable skip list.

A text is a sequence of units: a word with the white space before it, or white space at the end.  Its
skip list has one node at every unit boundary; each link of a lane carries its width in units, in code
points and in bytes.  A cut rank is reached by walking the highest lane as long as the summed unit
widths stay within the rank, then going one lane down; the other sums are then the place of the
cut.  Which nodes rise to a lane is drawn from a hash of their number, so that a list is the same in
every run.  The lists of many texts lie side by side in flat arrays and all ranks descend together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulens.llm.common import slices, text_bytes

# The marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

CUT_SHARE = 50
SUFFIX_FIRST_SHARE = 80
SEED = 42
RISE = 2  # bits of the hash that decide about each further lane: one node in four rises
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def unit_starts(text: np.ndarray) -> np.ndarray:
    """Byte places where units begin; a unit ends where a word does."""
    if not len(text):
        return np.zeros(0, np.int64)
    white = WHITE[text]
    ends = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    return np.concatenate([[0], ends])


class SkipLists:
    """Indexable skip lists over the units of several texts.

    Nodes are numbered through all texts; each text has one node more than units, the first of which stands on
    every lane.  ``lanes`` holds, from the lowest to the highest, the place of each member in the lane below and
    its link to the next member as widths ``(units, code points, bytes)``; a link beyond a text is closed."""

    def __init__(self, texts: list[bytes]):
        starts, widths, self.counts = [], [], []
        for text in texts:
            raw = np.frombuffer(text, np.uint8)
            at = unit_starts(raw)
            points = np.add.reduceat((raw & 0xC0) != 0x80, at, dtype=np.int64) if len(at) else at
            octets = np.diff(np.append(at, len(raw)))
            widths.append(np.stack([np.ones(len(at), np.int64), points, octets], 1))
            widths.append(np.zeros((1, 3), np.int64))
            self.counts.append(len(at))
        self.counts = np.array(self.counts, np.int64)
        nodes = int(self.counts.sum()) + len(texts)
        last = np.cumsum(self.counts + 1) - 1
        head = last - self.counts
        width = np.concatenate(widths) if widths else np.zeros((0, 3), np.int64)
        open_ = np.ones(nodes, bool)
        open_[last] = False
        height = self._heights(nodes)
        height[head] = 64
        self.lanes = [(np.arange(nodes), width, open_)]
        self.heads = head
        member, level = np.arange(nodes), 1
        while (height[member] >= level).sum() > len(texts):
            below = np.flatnonzero(height[member] >= level)
            text_of = np.searchsorted(last, member[below])
            self.heads = np.searchsorted(member[below], head)
            follows = np.append(text_of[1:] == text_of[:-1], False)
            self.lanes.append((below, np.add.reduceat(self.lanes[-1][1], below, axis=0), follows))
            member, level = member[below], level + 1

    @staticmethod
    def _heights(nodes: int) -> np.ndarray:
        """How many lanes each node rises: the zero bits at the end of a hash of its number."""
        mixed = (np.arange(1, nodes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)
        lowest = mixed & (~mixed + np.uint64(1))
        return np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) // RISE

    def find(self, texts: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points and bytes before the given rank (0 to the count of units) of each named text."""
        at = self.heads[texts]
        done = np.zeros((len(texts), 3), np.int64)
        for below, width, follows in reversed(self.lanes):
            walking = np.arange(len(texts))
            while len(walking):
                here = at[walking]
                step = width[here]
                go = follows[here] & (done[walking, 0] + step[:, 0] <= ranks[walking])
                walking, step = walking[go], step[go]
                done[walking] += step
                at[walking] += 1
            at = below[at]
        return done[:, 1], done[:, 2]


def _seeds(doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the sha256 of ``42:`` and the id, as numbers; a null id adds nothing."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def transform(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` of every row; ``n`` counts units.

    ``form`` is ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each
    part behind its mark.  Null text counts as empty, and empty texts and those that hold a mark are plain.  Cuts and
    form follow from the id alone (a null id is like an empty one), so repeated rows give repeated results; an empty
    table gives an empty one and other columns are not read."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches):
        for batch in batches:
            for part in slices(batch, 1):
                yield _cut(part)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *_seeds(F.col("doc_id")))
    return rows.mapInArrow(work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _cut(part: pa.RecordBatch) -> pa.RecordBatch:
    texts = text_bytes(part.column(1))
    h1, h2, h3, h4 = (part.column(i).to_numpy() for i in range(2, 6))
    lists = SkipLists(texts)
    n = lists.counts
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    marked = np.array([any(m in t for m in marks) for t in texts], bool)
    plain = (n == 0) | marked | (h3 % 100 >= CUT_SHARE)
    form = np.where(plain, "plain", np.where(h4 % 100 < SUFFIX_FIRST_SHARE, "spm", "psm"))
    cut = np.flatnonzero(~plain)
    first, second = h1 % (n + 1), h2 % (n + 1)
    points_a, bytes_a = lists.find(cut, np.minimum(first, second)[cut])
    points_b, bytes_b = lists.find(cut, np.maximum(first, second)[cut])
    output = list(texts)
    p, s, m = marks
    for i, a, b in zip(cut.tolist(), bytes_a.tolist(), bytes_b.tolist()):
        prefix, middle, suffix = texts[i][:a], texts[i][a:b], texts[i][b:]
        output[i] = b"".join([p, prefix, s, suffix, m, middle] if form[i] == "psm" else [s, suffix, p, prefix, m, middle])
    chars = np.zeros((2, len(n)), np.int64)
    chars[0, cut], chars[1, cut] = points_a, points_b - points_a
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(chars[0], mask=plain),
         pa.array(chars[1], mask=plain), pa.array(output, pa.binary()).cast(pa.string())],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from.  The marks stand once each in a cut output, so their places tell the parts."""
    def between(opens: str, closes: str | None) -> Column:
        start = F.locate(opens, output) + F.lit(len(opens))
        return F.substring(output, start, (F.locate(closes, output) if closes else F.lit(2**31 - 1)) - start)
    middle = between(MIDDLE, None)
    return F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))) \
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))) \
        .otherwise(output)


def oracle() -> str:
    """The digests of the query in DuckDB SQL."""
    unit = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
    group = "CAST('0x' || substr(h, {}, 8) AS BIGINT) AS h{}"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), units AS (
  SELECT doc_id, t, regexp_extract_all(t, '{unit}') AS u, {", ".join(group.format(8 * i + 1, i + 1) for i in range(4))}
  FROM texts
), cuts AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
    greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}')
      OR h3 % 100 >= {CUT_SHARE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST_SHARE} THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s
  FROM cuts
)
SELECT doc_id, n, form,
  CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
    ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
