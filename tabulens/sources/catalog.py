"""The catalog of stored datasets: an append-only table with raw and processed entries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SCHEMA = "dataset_id string, parent_id string, is_processed boolean, path string, rows long, columns int," \
         " stored_at timestamp, summary string"


def store(df: DataFrame, folder: str, catalog: str, parent_id: str | None = None, summary: str | None = None,
          fmt: str = "parquet") -> str:
    """Write a frame to a fresh folder and add its catalog row; returns the new dataset id."""
    spark = df.sparkSession
    dataset_id = uuid.uuid4().hex
    path = f"{folder.rstrip('/')}/{dataset_id}"
    writer = df.write.mode("errorifexists")
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).format(fmt).save(path)
    stored = spark.read.schema(df.schema).option("header", True).format(fmt).load(path)
    entry = stored.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(parent_id).cast("string").alias("parent_id"),
        F.lit(parent_id is not None).alias("is_processed"), F.lit(path).alias("path"), "rows",
        F.lit(len(df.columns)).alias("columns"), F.current_timestamp().alias("stored_at"),
        F.lit(summary).cast("string").alias("summary"))
    entry.write.mode("append").parquet(catalog)
    return dataset_id


def read_catalog(spark: SparkSession, catalog: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(catalog)


def raw_datasets(entries: DataFrame) -> DataFrame:
    """Raw datasets, newest first."""
    return entries.where(~F.coalesce("is_processed", F.lit(False))).orderBy(F.desc("stored_at"), "dataset_id")


def latest_processed(entries: DataFrame) -> DataFrame:
    """The newest processed dataset of every parent."""
    newest = Window.partitionBy("parent_id").orderBy(F.desc("stored_at"), F.desc("dataset_id"))
    return entries.where(F.col("is_processed")).withColumn("_rank", F.row_number().over(newest)) \
        .where("_rank = 1").drop("_rank")


def with_latest_processed(entries: DataFrame) -> DataFrame:
    """Raw datasets with their newest processed child, if any."""
    child = latest_processed(entries).select(F.col("parent_id").alias("dataset_id"),
                                             F.col("dataset_id").alias("processed_id"),
                                             F.col("stored_at").alias("processed_at"))
    return entries.where(~F.coalesce("is_processed", F.lit(False))).join(child, "dataset_id", "left")
