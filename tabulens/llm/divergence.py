"""How far the sources of each language differ in their words, by exact products of one-hot level matrices.

Tasks count terms per (language, source) and one shuffle adds them up.  For the distance of two sources,
the kept terms of a language are dealt to blocks of similar frequency.  In a block every source has
one indicator column for each of its count levels (no occurrence is a level too).  The product of two such
matrices, one transposed, holds all joint tables of their sources: how many terms have level a in one
and level b in the other.  Each cell is priced with the two levels' shares, and the prices are added
up per pair of sources, first within the block, then over all blocks.  Sources are blocked as well, so
a task holds a bounded number of terms and sources, whatever the size of a language.

Products are taken in single precision, where whole numbers up to 2^24 are exact; a cell holds at most the
terms of a block.  Shares and prices are whole numbers."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tabulens.llm.common import map_rows, stored, text_bytes

MIN_DOCS = 10
TOP_TERMS = 10
BLOCK_TERMS = 256
BLOCK_SOURCES = 16
TILE = 1024
HELD = 200_000
STRETCH = 1 << 20
SCALE = 1_000_000_000

# term signs stay, capitals become small, everything else ends a term
TERM_SIGNS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes):
    """The terms of a text, in lists of bounded length."""
    flat = text.translate(TERM_SIGNS)
    lo = 0
    while len(flat) - lo > STRETCH:
        hi = flat.find(b" ", lo + STRETCH)
        if hi < 0:
            break
        yield flat[lo:hi].split()
        lo = hi
    yield flat[lo:].split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents, and one row of the empty term per group."""
    def work(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            langs, sources = (batch.column(i).to_pylist() for i in (1, 2))
            for row, text in enumerate(text_bytes(batch.column(0))):
                n, in_docs = groups.setdefault((langs[row] or "", sources[row] or ""), (Counter(), Counter()))
                before, seen = len(n), set()
                for terms in terms_of(text):
                    n.update(terms)
                    seen.update(terms)
                in_docs.update(seen)
                held += len(n) - before
                if held >= HELD:
                    yield from _rows(groups)
                    groups, held = {}, 0
        yield from _rows(groups)

    partial = map_rows(docs, ["text", "lang", "source"], "lang string, source string, term string, n long, docs long", work)
    # dealt by (lang, term), which also serves the sums per term below
    return partial.repartition("lang", "term").groupBy("lang", "source", "term") \
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rows(groups: dict):
    for (lang, source), (n, in_docs) in groups.items():
        size = len(n) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
             pa.array([b"", *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()),
             pa.array([0, *map(in_docs.__getitem__, n)], pa.int64())], ["lang", "source", "term", "n", "docs"])


def _share(n: str, total: str) -> str:
    """SQL of a group's smoothed share of a term, in billionths; exact beyond 64 bits."""
    return f"1 + (CAST({n} + 2 AS DECIMAL(20, 0)) * {SCALE}) div greatest({total} + 2 * terms, 1)"


SIZE = "length(bin(lang_n))"
PRICE = "((p - q) * (p - q)) div (p + q)"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, block_terms: int = BLOCK_TERMS,
          block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every group of documents with the same language and source.

    ``pair`` rows: the distance to each other source of the language, all ranks.  ``term`` rows: the ``top`` kept
    terms that most exceed the language's share.  Null text, language and source count as empty; equal rows are
    documents of their own; a language without kept terms has distances of 0; an empty table gives no rows."""
    per_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).select(
        "lang", "source", "term", "n", F.sum("docs").over(per_term).alias("_docs"), F.sum("n").over(per_term).alias("lang_n"),
        (F.row_number().over(per_term.orderBy("source")) == 1).cast("long").alias("first"))
    kept = stored(counted.where((F.col("term") == "") | (F.col("_docs") >= min_docs)).drop("_docs"))
    # a term's size is the binary length of its count; sizes are dealt to blocks of about block_terms terms
    sizes = kept.where("first = 1 AND term != ''").selectExpr("lang", f"{SIZE} AS size").groupBy("lang", "size") \
        .agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(
            F.sum("n").alias("terms"), F.expr(f"map_from_entries(collect_list((size, ceil(n / {block_terms}D)))) AS blocks"))
    sources = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = sources.groupBy("lang").agg(F.sum("total").alias("lang_total"),
                                        F.expr(f"ceil(count(1) / {block_sources}D) AS parts"))
    groups = stored(sources.join(langs.join(sizes, "lang", "left"), "lang").selectExpr(
        "lang", "source", "total", "lang_total", "coalesce(terms, 0L) AS terms", "blocks", "parts",
        "pmod(xxhash64(source), parts) AS part"))
    value, item = F.desc("value"), F.asc("item")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(value, item)).alias("rank")

    cells = kept.where("term != ''").join(groups, ["lang", "source"])
    terms = cells.selectExpr("lang", "source", "term AS item", f"{_share('n', 'total')} AS p",
                             f"{_share('lang_n', 'lang_total')} AS q") \
        .where("p > q").selectExpr("lang", "source", "'term' AS part", "item", f"{PRICE} AS value") \
        .select("*", ranked).where(F.col("rank") <= top)
    pairs = _distances(cells, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").select("*", ranked)
    return pairs.unionByName(terms)


def _distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: the distance of every ordered pair of sources."""
    filled = cells.selectExpr("lang", f"{SIZE} AS size", f"pmod(xxhash64(term), blocks[{SIZE}]) AS block", "0L AS held", "part",
                              "parts", "source", "term", "n", f"{_share('n', 'total')} AS p", "first")
    held = filled.where("first = 1").groupBy("lang", "size", "block").agg(F.count(F.lit(1)).alias("in_block"))
    # one row per source opens each block: a source without any of its terms takes part with level 0; a language
    # without terms has one empty block
    opening = groups.join(held, "lang", "left").selectExpr(
        "lang", "coalesce(size, 0) AS size", "coalesce(block, 0L) AS block", "coalesce(in_block, 0L) AS held", "part", "parts",
        "source", "'' AS term", "0L AS n", f"{_share('0', 'total')} AS p")
    filled = filled.drop("first")
    # every block of sources meets every other one of its language
    rows = opening.unionByName(filled).selectExpr("*", "explode(sequence(0L, parts - 1)) AS other").selectExpr(
        "lang", "size", "block", "least(part, other) AS a", "greatest(part, other) AS b", "held", "part", "source", "term", "n", "p")
    priced = rows.groupBy("lang", "size", "block", "a", "b").applyInArrow(
        _priced, "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _priced(table: pa.Table) -> pa.Table:
    """Partial distances of the sources of one or two blocks over the terms of one block."""
    lang, a, b = (table.column(c)[0].as_py() for c in ("lang", "a", "b"))
    source, term = (table.column(c).combine_chunks().dictionary_encode() for c in ("source", "term"))
    names = source.dictionary.to_pylist()
    code = source.indices.to_numpy()
    spot = np.cumsum([t != "" for t in term.dictionary.to_pylist()])[term.indices.to_numpy()] - 1
    n, p, part = (table.column(c).to_numpy() for c in ("n", "p", "part"))
    part_of = np.zeros(len(names), np.int64)
    part_of[code] = part

    # a column per (source, level), in this order; level 0 of a source is the first of its columns
    order = np.lexsort((n, code))
    opens = np.concatenate([[True], (np.diff(code[order]) != 0) | (np.diff(n[order]) != 0)])
    column = np.empty(len(n), np.int64)
    column[order] = np.cumsum(opens) - 1
    owner, price = code[order][opens], p[order][opens]
    zero = np.searchsorted(owner, np.arange(len(names)))
    terms = int(spot.max()) + 1
    matrix = np.zeros((terms, len(owner)), np.float32)
    matrix[:, zero] = 1
    some = n > 0
    matrix[spot[some], zero[code[some]]] = 0
    matrix[spot[some], column[some]] = 1

    # terms of the block that none of these sources holds stand at level 0 in all of them
    base = price[zero]
    absent = int(pc.max(table.column("held")).as_py()) - terms
    total = absent * ((base[:, None] - base) ** 2 // (base[:, None] + base))
    left, right = (np.flatnonzero(part_of[owner] == x) for x in (a, b))
    for i in range(0, len(left), TILE):
        rows = left[i:i + TILE]
        for j in range(0, len(right), TILE):
            columns = right[j:j + TILE]
            joint = matrix[:, rows].T @ matrix[:, columns]
            x, y = np.nonzero(joint)
            p, q = price[rows[x]], price[columns[y]]
            np.add.at(total, (owner[rows[x]], owner[columns[y]]), joint[x, y].astype(np.int64) * ((p - q) * (p - q) // (p + q)))
    g, h = np.nonzero((part_of[:, None] == a) & (part_of[None, :] == b) & ~np.eye(len(names), dtype=bool))
    cells = total[g, h]
    if a != b:
        g, h, cells = np.concatenate([g, h]), np.concatenate([h, g]), np.tile(cells, 2)
    return pa.table({"lang": pa.array([lang] * len(g), pa.string()), "source": pa.array([names[i] for i in g], pa.string()),
                     "item": pa.array([names[i] for i in h], pa.string()), "value": pa.array(cells, pa.int64())})


def oracle() -> str:
    """The whole report in DuckDB SQL, term by term for every pair of sources."""
    capitals, small = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = f"1 + ({SCALE} * ({{}} + 2)) // ({{}} + 2 * terms)"
    price = "((p - q) * (p - q)) // (p + q)"
    rank = "CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{capitals}', '{small}') AS t FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), langs AS (
  SELECT lang, CAST(count(term) AS BIGINT) AS terms, CAST(coalesce(sum(lang_n), 0) AS BIGINT) AS lang_total
  FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), groups AS (
  SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), grid AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {share.format("coalesce(n, 0)", "total")} AS p,
    {share.format("lang_n", "lang_total")} AS q
  FROM groups JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
), prices AS (
  SELECT x.lang, x.source, x.item, {price} AS v
  FROM (SELECT x.lang, x.source, y.source AS item, x.p AS p, y.p AS q
        FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source) x
), pairs AS (
  SELECT x.lang, x.source, y.source AS item, CAST(coalesce(any_value(s.v), 0) AS BIGINT) AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN (SELECT lang, source, item, sum(v) AS v FROM prices GROUP BY lang, source, item) s
    ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  GROUP BY x.lang, x.source, y.source
), tops AS (
  SELECT lang, source, 'term' AS part, item, value, {rank}
  FROM (SELECT lang, source, term AS item, CAST({price} AS BIGINT) AS value FROM grid WHERE n > 0 AND p > q)
)
SELECT lang, source, 'pair' AS part, item, value, {rank} FROM pairs
UNION ALL SELECT * FROM tops WHERE rank <= {TOP_TERMS}"""
