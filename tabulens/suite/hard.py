"""Values that are easy to get wrong: infinities, keys beyond 2^53, columns without spread."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import cleaning, correlation, outliers, quality, stats
from tabulens.plans import sketches
from tabulens.suite.common import DIRTY, dirty, table

BIG = 2 ** 53


def corr_infinite(spark, sf):
    found = correlation.correlation_pairs(dirty(spark, sf), ["price", "amount"])
    return found.select("variable_a", "variable_b", F.round("correlation", 6).alias("correlation"), "sample_size")


CORR_INFINITE = f"""WITH {DIRTY} SELECT 'price' AS variable_a, 'amount' AS variable_b, round(corr(price, amount), 6) AS correlation,
  count(*) AS sample_size FROM dirty WHERE price IS NOT NULL AND amount IS NOT NULL AND NOT isinf(amount)"""


def fill_big_keys(spark, sf):
    k = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") + BIG)
    df = table(spark, sf, "orders").select("o_orderkey", k.alias("k"))
    return cleaning.fill_numbers(df, "zero").select("o_orderkey", "k")


FILL_BIG_KEYS = f"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey + {BIG} END AS k FROM orders"


def cap_zero_mad(spark, sf):
    v = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).otherwise(1.0)
    return outliers.remediate(table(spark, sf, "orders").select("o_orderkey", v.alias("v")), "cap", ["v"], "modified_zscore")


CAP_ZERO_MAD = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE 1.0 END AS v FROM orders"

def big_keys(spark, sf):
    """Keys beyond 2^53: ``few`` has two that are one double, ``most`` has one in 96 % of its rows."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select((k % 2 + BIG).alias("few"), F.when(k % 25 == 0, k + BIG).otherwise(BIG + 1).alias("most"),
                                             F.lit(BIG + 1).alias("one"))


def modes_big_keys(spark, sf):
    return stats.numeric_modes(big_keys(spark, sf), ["few", "most", "one"]).select("column_name", "distinct_count", "mode_text")


BIG_KEYS = f"""WITH b AS (SELECT o_orderkey % 2 + {BIG} AS few, CASE WHEN o_orderkey % 25 = 0 THEN o_orderkey + {BIG} ELSE {BIG + 1} END AS most,
  {BIG + 1} AS one FROM orders), long AS (SELECT 'few' AS column_name, few AS v FROM b UNION ALL SELECT 'most', most FROM b
  UNION ALL SELECT 'one', one FROM b), c AS (SELECT column_name, v, count(*) AS n FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS k, count(*) OVER (PARTITION BY column_name) AS d,
  CAST(sum(n) OVER (PARTITION BY column_name) AS BIGINT) AS total FROM c)"""
MODES_BIG_KEYS = f"{BIG_KEYS} SELECT column_name, d AS distinct_count, CAST(v AS VARCHAR) AS mode_text FROM r WHERE k = 1"


def constant_big_keys(spark, sf):
    df = big_keys(spark, sf)
    issues = quality.column_issues(df, [quality.constant_rules, quality.near_constant_rules]).select(
        "column_name", "issue_type", "affected_rows")
    return stats.moment_summary(df, df.columns).select("column_name", "is_constant").join(issues, "column_name", "left")


CONSTANT_BIG_KEYS = f"""{BIG_KEYS} SELECT column_name, d = 1 AS is_constant,
  CASE WHEN d = 1 THEN 'constant_column' WHEN n / total::DOUBLE >= 0.95 THEN 'near_constant_column' END AS issue_type,
  CASE WHEN d = 1 THEN total WHEN n / total::DOUBLE >= 0.95 THEN n END AS affected_rows FROM r WHERE k = 1"""


def frequent_values(spark, sf):
    return sketches.frequent_values(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber", "l_tax", "l_partkey"], 0.05)


FREQUENT = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY {c}"
    f" HAVING count(*) >= 0.05 * (SELECT count(*) FROM lineitem)" for c in ("l_returnflag", "l_linenumber", "l_tax", "l_partkey"))

QUERIES = {
    "modes_big_keys": (modes_big_keys, MODES_BIG_KEYS),
    "constant_big_keys": (constant_big_keys, CONSTANT_BIG_KEYS),
    "frequent_values": (frequent_values, FREQUENT),
    "corr_infinite": (corr_infinite, CORR_INFINITE),
    "fill_big_keys": (fill_big_keys, FILL_BIG_KEYS),
    "cap_zero_mad": (cap_zero_mad, CAP_ZERO_MAD),
}
