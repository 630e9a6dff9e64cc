"""Connected components of a link table, by alternating large and small stars.

Every step is a grouping with map-side minima and an equi-join that Spark can split at a hot node;
no neighbour list is ever gathered.  Each round is written to the shared folder, which cuts the
lineage and survives lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulens.llm.common import stored


def _minimum(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _round(links: DataFrame) -> DataFrame:
    """One large star and one small star over links ``(u, v)`` with ``u > v``."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = _minimum(both).select("u", F.least("u", "m").alias("m"))
    large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .where("u <> v").distinct()
    small = large.join(_minimum(large), "u")
    return small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .union(small.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every linked node but the roots; ``root`` is the smallest node reachable.

    ``links`` has two comparable columns of any direction; loops, repeats and nulls are ignored.
    An empty table gives an empty result."""
    a, b = links.columns
    cur = stored(links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == mark:
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark, cur = now, stored(_round(cur))
