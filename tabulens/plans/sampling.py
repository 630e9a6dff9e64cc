"""Deterministic samples of a fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabulens.functions.coerce import col
from tabulens.plans.storage import materialize

SEED = 42
SLICE_BITS = 12


def hash_sample(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The ``size`` rows with the smallest seeded hash of their key; all rows of a smaller frame.

    A histogram of the hash tells up to which value rows can qualify, so only about ``size`` rows
    reach the final ordering, whatever the size of the table."""
    bin_of = F.shiftright("_hash", 52)
    hashed = df.withColumn("_hash", F.xxhash64(F.lit(SEED), *[col(k) for k in keys]))
    bins = hashed.groupBy(bin_of.alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = bins.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).where(F.col("_before") < size) \
        .agg(F.max("_bin"))
    return hashed.where(bin_of <= needed.scalar()).orderBy("_hash", *[col(k) for k in keys]).limit(size).drop("_hash")


def _hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("_hash", F.xxhash64(F.lit(SEED), *[col(k) for k in keys]))


def stratified_sample(df: DataFrame, stratum: str, keys: list[str], size: int) -> DataFrame:
    """For every value of ``stratum`` the ``size`` rows with the smallest seeded hash, kept in ``_hash``.

    A histogram of the hash per stratum tells up to which slice its rows can qualify; only these meet in one place, so
    a stratum with a third of all rows costs no more than any other.  Samples of parts of a table are merged
    by ``merge_samples``."""
    hashed, slice_of = _hashed(df, keys), F.shiftright("_hash", 64 - SLICE_BITS)
    counts = hashed.groupBy(col(stratum).alias("_of"), slice_of.alias("_slice")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_of").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # stored, so that Spark knows its size and does not shuffle the table by stratum to join a row per stratum
    last = materialize(counts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).where(F.col("_before") < size)
                       .groupBy("_of").agg(F.max("_slice").alias("_last")))
    near = hashed.join(last, col(stratum).eqNullSafe(F.col("_of"))).where(slice_of <= F.col("_last")).drop("_of", "_last")
    return _smallest(near, stratum, keys, size)


def _smallest(hashed: DataFrame, stratum: str, keys: list[str], size: int) -> DataFrame:
    order = Window.partitionBy(col(stratum)).orderBy("_hash", *[col(k) for k in keys])
    return hashed.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= size).drop("_place")


def merge_samples(samples: DataFrame, stratum: str, keys: list[str], size: int) -> DataFrame:
    """The sample of a whole table from the united samples of its parts, made with the same size or a larger one."""
    return _smallest(samples, stratum, keys, size)
