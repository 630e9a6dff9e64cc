"""License notices by diagonal voting, in DataFrame functions alone.

Every word 3-gram of a text is hashed and joined to the hashes of the template 3-grams (a fixed
table, broadcast).  A match at word ``p`` of the text and ``q`` of a template votes for the diagonal
``p - q``.  A template whose votes fill one diagonal stands there word for word.  Diagonals at most
``SLACK`` apart are merged, so that a few inserted or missing words do not hide a notice; the share
of template 3-grams found there, each compared word by word, decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

GRAM = 3
SLACK = 2
SHARE = 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# fixed values: the exact phrases and their labels
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# wording of common notices; a label is added where most of a wording is found (up to 60 words each)
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
            " associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in"
                 " compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
              " general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided"
            " that the following conditions are met"),
]


def templates() -> list[tuple[int, str, list[str], bool]]:
    """``(number, label, words, exact)``."""
    both = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]
    return [(i, label, text.split(), exact) for i, (label, text, exact) in enumerate(both)]


def words_of(text: str = "text") -> Column:
    """Words of a text with A-Z lowered: runs of digits, letters and signs beyond ASCII. Null: none."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    trimmed = F.regexp_replace(lowered, f"^{SEPARATOR}|{SEPARATOR}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR))


def template_grams(spark: SparkSession) -> DataFrame:
    rows = [(i, q, words[q], words[q + 1], words[q + 2]) for i, _, words, _ in templates()
            for q in range(len(words) - GRAM + 1)]
    return spark.createDataFrame(rows, "template int, q int, t0 string, t1 string, t2 string") \
        .withColumn("hash", F.xxhash64("t0", "t1", "t2"))


def votes(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, template, diagonal, found)``: the template 3-grams on a diagonal as bits.

    Bits are merged by OR, so repeated rows vote once."""
    gram = F.arrays_zip(F.col("words").alias("w0"), F.expr("slice(words, 2, greatest(size(words), 1))").alias("w1"),
                        F.expr("slice(words, 3, greatest(size(words), 1))").alias("w2"))
    grams = docs.select("doc_id", "mark", F.posexplode(gram).alias("p", "g")) \
        .select("doc_id", "mark", "p", "g.w0", "g.w1", "g.w2").withColumn("hash", F.xxhash64("w0", "w1", "w2"))
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession)), "hash").where("w0 = t0 AND w1 = t1 AND w2 = t2")
    return hits.groupBy("doc_id", "mark", "template", (F.col("p") - F.col("q")).alias("diagonal")) \
        .agg(F.expr("bit_or(shiftleft(1L, q))").alias("found"))


def _case(values: dict[int, object]) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for i, value in values.items():
        out = out.when(F.col("template") == i, F.lit(value))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``n_base`` counts the places of the exact phrases, ``labels`` adds those of merged diagonals, and
    ``score`` is the largest share of a template found.  Null and empty texts have no words, empty
    labels and score 0; repeated rows get equal results; null ids are kept."""
    listed = templates()
    label, grams = _case({i: name for i, name, *_ in listed}), _case({i: len(w) - GRAM + 1 for i, _, w, _ in listed})
    exact = F.col("template") < len(PHRASES)
    marked = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), words_of().alias("words"))
    found = votes(marked).withColumn("label", label).withColumn("grams", grams)

    along = Window.partitionBy("doc_id", "mark", "template").orderBy("diagonal")
    near = F.col("diagonal") - F.lag("diagonal").over(along) <= SLACK
    merged = found.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("run", F.sum("new").over(along)) \
        .groupBy("doc_id", "mark", "template", "run", "label", "grams") \
        .agg(F.expr("bit_or(found)").alias("whole"),
             F.count_if(exact & (F.bit_count("found") == F.col("grams"))).alias("places"),
             F.min(F.when(exact & (F.bit_count("found") == F.col("grams")), F.col("diagonal"))).alias("first"),
             F.max(F.when(exact & (F.bit_count("found") == F.col("grams")), F.col("diagonal"))).alias("last"))
    share = F.bit_count("whole") / F.col("grams")
    named = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")
    per_doc = merged.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.sum("places").alias("n_base"), F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"), named(F.col("places") > 0).alias("base_labels"),
        named((F.col("places") > 0) | ~exact & (share >= SHARE)).alias("labels"), F.max(share).alias("score"))
    rows = marked.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"))
    empty = F.lit("")
    return rows.join(per_doc, rows["doc_id"].eqNullSafe(per_doc["_id"]) & (rows["mark"] == per_doc["_mark"]), "left") \
        .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
                F.coalesce("base_labels", empty).alias("base_labels"), F.coalesce("labels", empty).alias("labels"),
                F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same result in DuckDB, with the words themselves in place of hashes."""
    quoted = lambda x: "'" + x + "'"
    grams = ", ".join(f"({i}, {quoted(label)}, {str(exact).lower()}, {len(w) - GRAM + 1}, {q}, {quoted(w[q])},"
                      f" {quoted(w[q + 1])}, {quoted(w[q + 2])})"
                      for i, label, w, exact in templates() for q in range(len(w) - GRAM + 1))
    return rf"""
WITH t(template, label, exact, grams, q, t0, t1, t2) AS (VALUES {grams}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 2)) AS p FROM d),
votes AS (SELECT doc_id, template, label, exact, grams, p - q AS diagonal, bit_or(1::BIGINT << q) AS found
  FROM (SELECT doc_id, p, w[p + 1] AS w0, w[p + 2] AS w1, w[p + 3] AS w2 FROM p)
  JOIN t ON w0 = t0 AND w1 = t1 AND w2 = t2 GROUP BY ALL),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {SLACK}
    THEN 0 ELSE 1 END AS fresh FROM votes)),
merged AS (SELECT doc_id, template, label, exact, run, bit_count(bit_or(found)) / grams AS share,
    count(*) FILTER (exact AND bit_count(found) = grams) AS places,
    min(diagonal) FILTER (exact AND bit_count(found) = grams) AS first,
    max(diagonal) FILTER (exact AND bit_count(found) = grams) AS last
  FROM runs GROUP BY doc_id, template, label, exact, run, grams),
per_doc AS (SELECT doc_id, sum(places) AS n_base, min(first) AS first_word, max(last) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (places > 0 OR NOT exact AND share >= {SHARE}) AS labels,
    max(share) AS score FROM merged GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN per_doc USING (doc_id)"""
