"""Materialising an intermediate frame in shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    Where none is set, a single process takes a temporary folder per application; a cluster must name a
    folder that all its machines reach."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if not folder:
        folder = _local_folders.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="tabulens-")
        _local_folders[context.applicationId] = folder
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write the frame once as Parquet in the shared folder and read it back.

    Later passes read only the columns they need, and lost executors recompute nothing before it."""
    path = f"{shared_folder(df.sparkSession)}/tabulens-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, partitions: int) -> DataFrame:
    """The frame over all cores, if it comes in fewer than half as many partitions; as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * partitions < cores else df
