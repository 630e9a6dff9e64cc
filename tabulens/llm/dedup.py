"""Removal of repeated passages by hashing units of text.

A unit is a line, split further at sentence ends and where a capital follows a word without
sentence end (a passage pasted into running text starts there).  Sentences are gathered until a
unit has ``min_words`` words; a rest shorter than that joins the unit before it, so the same
passage has the same units wherever it stands.  Units are normalised, hashed to 128 bits and
grouped globally; the occurrence first in (doc_id, position) order stays, all others go, and their
offsets in the original text are returned."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabulens.llm.common import map_rows, stored

MIN_WORDS = 8
# white space before a capital or after a sentence end
_BREAK = re.compile(r"[ \t\xa0]+(?=[A-ZÀ-ÞΑ-ΫА-Я])|(?<=[.!?…])[ \t\xa0]+")
_END = frozenset(".!?…。！？")
_QUOTES = "\"'»”’)]"


def _line_units(line: str, base: int, min_words: int) -> list[tuple[int, int, int]]:
    """``(start, end, words)`` of the units of one line."""
    found, segment = [], 0  # ``segment``: where the units since the last capital break begin
    start = len(line) - len(line.lstrip())
    end = len(line.rstrip())
    at, count = start, 0

    def close(upto):
        if count < min_words and len(found) > segment:
            first, _, n = found.pop()
            found.append((first, base + upto, n + count))
        elif count:
            found.append((base + at, base + upto, count))

    last = start
    for m in _BREAK.finditer(line, start, end):
        before = m.start()
        sign = line[before - 1] if line[before - 1] not in _QUOTES or before < 2 else line[before - 2]
        if sign not in _END and sign.isupper():
            continue
        count += len(line[last:before].split())
        last = m.end()
        if sign not in _END:
            close(before)
            at, count, segment = last, 0, len(found)
        elif count >= min_words:
            close(before)
            at, count = last, 0
    count += len(line[last:end].split())
    close(end)
    return found


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int]]:
    """``(start, end, words)`` of every unit of a text, in order; offsets count characters."""
    found, base = [], 0
    for line in text.split("\n"):
        found += _line_units(line, base, min_words)
        base += len(line) + 1
    return found


def digest(unit: str) -> tuple[int, int]:
    """128 bits of a unit with A-Z lowered and white space runs made one space."""
    whole = xxhash.xxh3_128_digest(" ".join(unit.split()).lower().encode())
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def unit_digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, mark, pos, h1, h2)`` of every unit of at least ``min_words`` words; ``mark`` tells apart
    texts under one id."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches):
        for batch in batches:
            ids, marks, pos, h1, h2 = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                mark = text_mark(text)
                for i, (a, b, n) in enumerate(units(text, min_words)):
                    if n >= min_words:
                        x, y = digest(text[a:b])
                        ids.append(row)
                        marks.append(mark)
                        pos.append(i)
                        h1.append(x)
                        h2.append(y)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(marks, pa.int64()), pa.array(pos, pa.int32()),
                 pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "mark", "pos", "h1", "h2"])
    return map_rows(docs, ["doc_id", "text"], f"doc_id {kind}, mark long, pos int, h1 long, h2 long", work)


def text_mark(text: str) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(text.encode())).astype(np.int64))


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, mark, gone)``: the positions of the units that stand earlier elsewhere.

    Rows with a null id come after all others in rank."""
    found = unit_digests(docs, min_words)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "pos")
    # stored, so that the join has two plain shuffles and Spark can split a unit that stands in many texts
    first = stored(found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("h1", "h2", "first"))
    later = found.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def cut(text: str, gone: set[int], min_words: int) -> tuple[str, list[dict]]:
    """The text without the units in ``gone``, and their spans."""
    if not gone:
        return text, []
    spans = []
    for i, (a, b, n) in enumerate(units(text, min_words)):
        if i in gone:
            # neighbours that go together form one span, white space between them included
            if spans and i - 1 in gone and spans[-1]["last"] == i - 1:
                spans[-1] |= {"end": b, "last": i, "words": spans[-1]["words"] + n}
            else:
                spans.append({"start": a, "end": b, "last": i, "words": n})
    kept, at = [], 0
    for span in spans:
        kept.append(text[at:span["start"]])
        at = span["end"]
    kept.append(text[at:])
    return "".join(kept), [{k: s[k] for k in ("start", "end", "words")} for s in spans]


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with ``text`` rid of repeated units, and ``n_removed`` and
    ``removed`` (spans of the original text: start, end, words) in place of columns of these names.

    Null text stays null.  Rows with equal id and text count as one row and stay alike.
    An empty table gives no rows."""
    added = ["n_removed", "removed"]
    rest = [c for c in docs.columns if c not in added]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema.fields)
    return _cut_rows(docs.select(*rest), repeated_units(docs, min_words), rest, schema, min_words)


def _cut_rows(docs: DataFrame, gone: DataFrame, rest: list[str], schema: str, min_words: int) -> DataFrame:
    # names that no column of the documents has, whatever its letter case
    key = "gone" + "_" * max(map(len, rest))
    per_doc = gone.groupBy(F.col("doc_id").alias(f"{key}i")).agg(F.collect_list(F.struct("mark", "gone")).alias(key))
    joined = docs.join(per_doc, docs["doc_id"].eqNullSafe(per_doc[f"{key}i"]), "left").drop(f"{key}i")
    at = rest.index("text")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))

    def work(batches):
        for batch in batches:
            texts, removed = [], []
            for text, marks in zip(batch.column(at).to_pylist(), batch.column(len(rest)).to_pylist()):
                mark = text_mark(text or "") if marks else None
                hit = next((set(m["gone"]) for m in marks or () if m["mark"] == mark), set())
                new, spans = cut(text or "", hit, min_words)
                texts.append(None if text is None else new)
                removed.append(spans)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array([len(r) for r in removed], pa.int64()),
                 pa.array(removed, span)], [*rest, "n_removed", "removed"])
    return joined.mapInArrow(work, f"{schema}, n_removed long,"
                                   " removed array<struct<start int, end int, words int>>")
