"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulens.llm import (bpe, decontam, dedup, divergence, fillmiddle, graph, language, licenses, ngrams, pieces, simhash,
                          tokenfile, toxicity)
from tabulens.llm.common import fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(parts: int, value: int):
    """Whether a row is in the fold kept from learning; a row without an id is not."""
    return F.coalesce(fold("doc_id", parts) == value, F.lit(False)).alias("held_out")


def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngrams.score(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", _held_out(5, 0), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = tokenfile.write_token_files(_table(spark, sf_dir, "documents"))
    return tokenfile.documents_of(spark, folder)


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def language_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs)).select("doc_id", _held_out(4, 2), "lang_pred", "score")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return graph.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fillmiddle.transform(_table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fillmiddle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.encode(_table(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.expr("bigint(octet_length(ids) / 4)").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_lm_score": lm_score,
    "op2_toxicity_neighbours": toxicity_neighbours,
    "op3_license_scan": license_scan,
    "op4_substring_dedup": substring_dedup,
    "op5_bpe_codec": bpe_codec,
    "op6_token_files": token_files,
    "op7_language_field": language_field,
    "op8_benchmark_decontamination": benchmark_decontamination,
    "op9_simhash_near_dedup": simhash_near_dedup,
    "op10_vector_graph": vector_graph,
    "op11_source_divergence": source_divergence,
    "op12_fill_in_middle": fill_in_middle,
    "op13_sentencepiece_codec": sentencepiece_codec,
}
ORACLES = {"op3_license_scan": licenses.oracle(), "op11_source_divergence": divergence.oracle(),
           "op12_fill_in_middle": fillmiddle.oracle()}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
