"""Token ids as wavelet matrices, one Parquet file per shard.

A shard holds the ids of consecutive documents as 16 (or as many as the ids need) bit planes.  A
plane is the next lower bit of every id, after the ids have been sorted stably by the bits above.
With the number of ones before each block of 512 bits, ``rank`` and ``select`` answer three
questions on the compressed planes alone: which id stands at a place (``access``), how often an id
stands before a place (``count``), and where its n-th occurrence is (``locate``).  The files are
written and read by Spark, so they lie in any store that Spark reaches, and a lost task is simply
written again."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabulens.llm.bpe import SIGNS, Words, default_path, words
from tabulens.llm.common import small
from tabulens.plans.storage import shared_folder

BLOCK = 512
SHARD_TOKENS = 1 << 22
SHARD_CHARS = 24 << 20
ID_BITS = 16
CODED_BYTES = 8 << 20
# no word between two separators, and white space other than the space and the line end
ODD_SPACE = r"(^|[ \n])([ \n]|$)|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SHARD = "part int, shard int, n_docs long, n_tokens long, zeros array<long>, docs binary, planes array<binary>"
ARROW_SHARD = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                         ("zeros", pa.list_(pa.int64())), ("docs", pa.binary()), ("planes", pa.list_(pa.binary()))])

# bytes that are signs, ASCII letters, and the second bytes of letters from U+0080 on
SIGN, LETTER, SECOND_C2, SECOND_C3 = (np.isin(np.arange(256), [*some]) for some in (
    SIGNS, [b for b in range(128) if chr(b).isalpha()], *([c - lead + 0x80 for c in range(lead, lead + 64) if chr(c).isalpha()]
                                                          for lead in (0x80, 0xC0))))


class WaveletMatrix:
    """Bit planes with a rank directory; built from ids or from stored bytes."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.before = []
        for plane in planes:
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
            self.before.append(np.concatenate([[0], np.cumsum(ones)]))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = ID_BITS) -> WaveletMatrix:
        planes, zeros, cur = [], [], ids.astype(np.uint16) if bits <= 16 else ids
        for level in range(bits - 1, -1, -1):
            bit = (cur & cur.dtype.type(1 << level)) != 0
            packed = np.packbits(bit, bitorder="little")
            planes.append(np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)]))
            # compress takes a third of the time of a mask as index
            low = cur.compress(~bit)
            zeros.append(len(low))
            cur = np.concatenate([low, cur.compress(bit)])
        return cls(len(ids), planes, zeros)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def ids(self) -> np.ndarray:
        """All ids, by undoing the sorts from the lowest plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            bit, out = self._bits(level), np.empty(self.n, kind)
            out[np.flatnonzero(~bit)] = cur[:self.zeros[level]]
            out[np.flatnonzero(bit)] = cur[self.zeros[level]:] | kind(1 << (len(self.planes) - 1 - level))
            cur = out
        return cur

    def rank(self, level: int, place: int) -> int:
        """Ones of a plane before ``place``."""
        block, rest = divmod(place, BLOCK)
        start = block * BLOCK // 8
        tail = np.unpackbits(self.planes[level][start:start + BLOCK // 8], count=rest or None, bitorder="little")
        return int(self.before[level][block]) + (int(tail.sum()) if rest else 0)

    def select(self, level: int, bit: int, n: int) -> int:
        """Place of the ``n``-th (from 0) one or zero of a plane."""
        ones = self.before[level]
        seen = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(seen, n, "right")) - 1
        start = block * BLOCK // 8
        inside = np.unpackbits(self.planes[level][start:start + BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(inside == bit)[n - int(seen[block])])

    def access(self, place: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            ones = self.rank(level, place)
            bit = int(self.planes[level][place >> 3] >> (place & 7) & 1)
            value = value << 1 | bit
            place = self.zeros[level] + ones if bit else place - ones
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``stop`` lie in the last order."""
        lo, hi, top = 0, stop, len(self.planes) - 1
        for level in range(len(self.planes)):
            a, b = self.rank(level, lo), self.rank(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if value >> (top - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, value: int, stop: int | None = None) -> int:
        """Occurrences of an id before ``stop``."""
        lo, hi = self._range(value, self.n if stop is None else stop)
        return hi - lo

    def locate(self, value: int, nth: int) -> int:
        """Place of the ``nth`` (from 0) occurrence of an id, -1 if there are fewer."""
        lo, hi = self._range(value, self.n)
        place = lo + nth
        if nth < 0 or place >= hi:
            return -1
        top = len(self.planes) - 1
        for level in range(top, -1, -1):
            bit = value >> (top - level) & 1
            place = self.select(level, bit, place - self.zeros[level] * bit)
        return place


def chunks(text: str, first: Words, later: Words, line: Words) -> bytes:
    """Packed ids of a text. It is taken apart before each single space or line end, where the
    tokenizer always breaks; a text with other or with neighbouring white space is encoded whole."""
    if " ".join(text.split()) != text.replace("\n", " "):
        return np.array(first.tokenizer.encode(text, add_special_tokens=False).ids, first.kind).tobytes()
    packed, table = [], first
    for part in text.encode().split(b"\n"):
        head, *rest = part.split(b" ")
        packed.append(table[head])
        packed += map(later.__getitem__, rest)
        table = line
    return b"".join(packed)


def _letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters up to U+00FF."""
    found = LETTER[raw]
    for lead, follow in ((0xC2, SECOND_C2), (0xC3, SECOND_C3)):
        at = np.flatnonzero(raw[:-1] == lead)
        at = at[follow[raw[at + 1]]]
        found[at] = found[at + 1] = True
    return found


def _tails(raw: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Where the signs at the ends of words begin that stand behind a Latin letter; runs of more than 8 signs and words with
    a "<", which may name a special token, are left out."""
    starts, letter = np.flatnonzero(opens), _letters(raw)
    at = np.append(starts, len(raw))[1:] - 1
    whole = np.ones(len(starts), bool)
    whole[np.searchsorted(starts, np.flatnonzero(raw == ord("<")), "right") - 1] = False
    at, found = at[whole & SIGN[raw[at]]], []
    for _ in range(8):
        behind = at[~opens[at]]
        found.append(behind[letter[behind - 1]])
        at = behind[SIGN[raw[behind - 1]]] - 1
    return np.concatenate(found)


def _latin_words(words: list[bytes]) -> np.ndarray:
    """Which words, without the space or line end before them, are letters up to U+00FF alone."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(sizes)
    others = ~_letters(raw)
    first = (ends - sizes)[sizes > 1]
    others[first[(raw[first] == 32) | (raw[first] == 10)]] = False
    upto = np.concatenate([[0], np.cumsum(others)])
    return (upto[ends] == upto[ends - sizes]) & (sizes > 0)


def coded(texts: pa.Array, known: Words, tables: list[Words], kind: str = "<u4") -> list[bytes]:
    """Packed ids of each text. All texts are cut at once, before each space or line end and between a Latin letter and
    the signs at the end of its word, and each different part is looked up once; texts with other or with neighbouring
    white space go through ``chunks``."""
    odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
    plain = texts.filter(pa.array(~odd)).cast(pa.binary())
    sizes = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(plain.to_pylist()), np.uint8)
    ends = np.cumsum(sizes)
    opens = (raw == 32) | (raw == 10)
    opens[ends - sizes] = True
    opens[_tails(raw, opens)] = True
    starts = np.flatnonzero(opens)
    cuts = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, cuts, pa.py_buffer(raw)]).dictionary_encode()
    different = words.dictionary.to_pylist()
    known.learn(different, _latin_words(different))
    packed = [known[w] for w in different]
    width = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    begin = np.cumsum(width) - width
    which = words.indices.to_numpy(zero_copy_only=False)
    count = width[which]
    upto = np.concatenate([[0], np.cumsum(count)])
    ids = np.frombuffer(b"".join(packed), kind)[np.repeat(begin[which] - upto[:-1], count) + np.arange(upto[-1])]
    at = upto[np.searchsorted(starts, np.concatenate([[0], ends]))].tolist()
    done = (ids[a:b].tobytes() for a, b in zip(at, at[1:]))
    return [chunks(texts[i].as_py(), *tables) if x else next(done) for i, x in enumerate(odd.tolist())]


def encode_shards(docs: DataFrame, path: str | None = None, end_id: int = 2) -> DataFrame:
    """The rows of the token files, one per shard, in ascending ``doc_id`` order.

    ``docs`` holds ids, lengths and null marks of the documents of the shard, ``planes`` its bit
    planes. Null text counts as empty and has the end id alone; null ids come first; repeated rows
    each have a place. A shard ends with the document that fills it."""
    path = path or default_path("byte_bpe_50k.json")
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = F.asc_nulls_first("doc_id")
    ranged = rows.repartitionByRange(max(int(size // SHARD_CHARS), 1), place).sortWithinPartitions(place, "text") \
        .select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def work(batches):
        tables = [words(path, "<u4", p) for p in ("", " ", "\n")]
        end = np.array([end_id], "<u4").tobytes()
        ids, held, size, shard, part = [], [], 0, 0, 0
        for batch in small(batches, 2, CODED_BYTES):
            parts, doc_ids = (batch.column(i).to_pylist() for i in range(2))
            for part, doc_id, packed in zip(parts, doc_ids, coded(batch.column(2), tables[0], tables)):
                ids.append(doc_id)
                held.append(packed + end)
                size += len(held[-1])
                if size >= 4 * SHARD_TOKENS:
                    yield _shard_row(part, shard, ids, held)
                    ids, held, size, shard = [], [], 0, shard + 1
        if held:
            yield _shard_row(part, shard, ids, held)

    return ranged.mapInArrow(work, SHARD)


def _shard_row(part: int, shard: int, doc_ids: list, held: list[bytes]) -> pa.RecordBatch:
    tokens = np.frombuffer(b"".join(held), "<u4")
    matrix = WaveletMatrix.build(tokens, max(int(tokens.max()).bit_length(), ID_BITS))
    index = b"".join(np.array(x, kind).tobytes() for x, kind in (
        ([x or 0 for x in doc_ids], "<i8"), ([len(x) // 4 for x in held], "<i8"), ([x is None for x in doc_ids], "u1")))
    return pa.RecordBatch.from_pylist([{
        "part": part, "shard": shard, "n_docs": len(held), "n_tokens": matrix.n, "zeros": matrix.zeros, "docs": index,
        "planes": [p.tobytes() for p in matrix.planes]}], ARROW_SHARD)


def write_token_files(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2) -> str:
    """Write one compressed file per range of documents and return the folder."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    encode_shards(docs, path, end_id).write.option("compression", "zstd").parquet(folder)
    return folder


def read_shards(spark: SparkSession, folder: str, work, schema: str) -> DataFrame:
    """Apply ``work(part, shard, doc_ids, lengths, matrix) -> RecordBatch`` to every shard of the files."""
    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                n, index = row["n_docs"], row["docs"]
                absent = np.frombuffer(index, np.uint8, n, 16 * n).astype(bool)
                matrix = WaveletMatrix(row["n_tokens"], [np.frombuffer(p, np.uint8) for p in row["planes"]], row["zeros"])
                yield work(row["part"], row["shard"], pa.array(np.frombuffer(index, "<i8", n), pa.int64(), mask=absent),
                           np.frombuffer(index, "<i8", n, 8 * n), matrix)
    return spark.read.schema(SHARD).parquet(folder).mapInArrow(each, schema)


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the files."""
    import zlib

    def work(part, shard, doc_ids, lengths, matrix):
        raw = memoryview(matrix.ids().astype("<u4").tobytes())
        ends = np.cumsum(lengths)
        sums = [zlib.crc32(raw[4 * (b - n):4 * b]) for b, n in zip(ends.tolist(), lengths.tolist())]
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(doc_ids), pa.int32()), pa.array([shard] * len(doc_ids), pa.int32()), doc_ids,
             pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
            ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    read = read_shards(spark, folder, work,
                       "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = spark.read.schema(SHARD).parquet(folder).select("part", "shard", F.col("n_tokens").alias("n"))
    order = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    return read.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"),
                                                       "n_tokens", "ids_crc32")
