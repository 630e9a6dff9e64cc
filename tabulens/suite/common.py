"""Table loading, the dirty view, and SQL fragments shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Round every double column; ``special`` gives other digits by name."""
    return df.select(*[F.round(F.col(f.name), special.get(f.name, digits)).alias(f.name)
                       if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema])


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` with defects placed by the order key; one row in forty comes twice."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    every = lambda n: k % n == 0
    total = F.col("o_totalprice")
    once = o.select(
        k.alias("order_key"),
        F.when(~every(7), total).alias("price"),
        F.when(every(97), F.lit(-999.0)).when(every(101), -total).when(every(103), F.lit(float("inf")))
        .when(every(89), total * 100).otherwise(total).alias("amount"),
        F.when(every(11), F.lit("N/A")).when(every(5), F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit(" ")))
        .otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(every(3), F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.when(~(every(2) | every(3)), F.concat(F.lit("note "), (k % 10).cast("string"))).alias("note"),
        F.concat(F.lit("$"), F.floor(total).cast("string")).alias("price_txt"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_txt"),
        F.lit("X").alias("const_col"),
        F.when(every(50), F.lit("rare")).otherwise(F.lit("common")).alias("near_const"),
        F.col("o_orderdate").cast("timestamp").alias("ordered_at"))
    return once.unionByName(once.where(F.col("order_key") % 40 == 0))


DIRTY = """
once AS (
  SELECT o_orderkey AS order_key,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 97 = 0 THEN -999.0 WHEN o_orderkey % 101 = 0 THEN -o_totalprice
         WHEN o_orderkey % 103 = 0 THEN CAST('Infinity' AS DOUBLE)
         WHEN o_orderkey % 89 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS amount,
    CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' WHEN o_orderkey % 5 = 0 THEN '  ' || o_orderstatus || ' '
         ELSE o_orderstatus END AS status,
    CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 THEN NULL
         ELSE 'note ' || CAST(o_orderkey % 10 AS VARCHAR) END AS note,
    '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price_txt,
    strftime(o_orderdate, '%Y-%m-%d') AS date_txt,
    'X' AS const_col,
    CASE WHEN o_orderkey % 50 = 0 THEN 'rare' ELSE 'common' END AS near_const,
    o_orderdate AS ordered_at
  FROM orders),
dirty AS (SELECT * FROM once UNION ALL SELECT * FROM once WHERE order_key % 40 = 0)
"""

DIRTY_COLUMNS = ["order_key", "price", "amount", "status", "priority", "note", "price_txt", "date_txt", "const_col",
                 "near_const", "ordered_at"]
DIRTY_TEXT = ["status", "priority", "note", "price_txt", "date_txt", "const_col", "near_const"]


def long_sql(source: str, columns: list[str], value: str = "v", cast: str = "") -> str:
    """``SELECT column_name, value`` over several columns, missing values left out."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {f'CAST({c} AS {cast})' if cast else c} AS {value} FROM {source}"
        f" WHERE {c} IS NOT NULL" for c in columns)


def pct_sql(part: str, whole: str, digits: int = 2) -> str:
    return f"round(CAST({part} AS DOUBLE) / {whole} * 100, {digits})"


STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
TITLE = ("array_to_string(list_transform(str_split(lower({0}), ''), lambda x, i: CASE WHEN i = 1 OR NOT "
         "regexp_matches(str_split(lower({0}), '')[i - 1], '[a-z]') THEN upper(x) ELSE x END), '')")


def ts_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
