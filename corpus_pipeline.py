"""The document pipeline: each stage reads what the one before it kept.

``run`` writes every stage as Parquet in the shared folder and reads it back, so a lost executor
repeats one stage at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulens.llm import bpe, decontam, dedup, nearcopies, toxicity
from tabulens.llm.common import batches_of, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    with batches_of(spark):
        model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (similarity 0.8 of five-word shingles) the document with the smallest id stays."""
    return nearcopies.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document, or earlier in the same one, are cut out."""
    return dedup.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, with the text they decode to."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

# nearest neighbours, fingerprints, edit distances and token ids are no SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of the documents that all stages kept."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
