"""Queries of the profiling and typing family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import profile
from tabulens.suite.common import (DIRTY, DIRTY_COLUMNS, dirty, long_sql, pct_sql, rounded, table)

MISSING = "(" + " + ".join(f"CAST({c} IS NULL AS BIGINT)" for c in DIRTY_COLUMNS) + ")"
ALL_TEXT = " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM dirty"
    for i, c in enumerate(DIRTY_COLUMNS))


def dataset_metrics(spark, sf):
    return profile.dataset_metrics(dirty(spark, sf)).drop("estimated_bytes", "size_label")


DATASET_METRICS = f"""WITH {DIRTY}, m AS (SELECT count(*) AS total_rows, CAST(sum({MISSING}) AS BIGINT) AS missing_cells,
  count(*) FILTER ({MISSING} > 0) AS rows_with_missing FROM dirty),
d AS (SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(DIRTY_COLUMNS)}))
SELECT total_rows, missing_cells, rows_with_missing, CAST({len(DIRTY_COLUMNS)} AS BIGINT) AS total_columns,
  total_rows * {len(DIRTY_COLUMNS)} AS total_cells,
  {pct_sql('missing_cells', f'(total_rows * {len(DIRTY_COLUMNS)})')} AS missing_cells_percentage,
  {pct_sql('rows_with_missing', 'total_rows')} AS rows_with_missing_percentage, duplicate_rows,
  {pct_sql('duplicate_rows', 'total_rows')} AS duplicate_rows_percentage FROM m, d"""


def size_estimate(spark, sf):
    return profile.missing_metrics(table(spark, sf, "documents")).select("total_rows", "estimated_bytes", "size_label")


SIZE = """WITH s AS (SELECT count(*) AS n, CAST(sum(16 + coalesce(octet_length(encode(text)), 0)
  + coalesce(octet_length(encode(lang)), 0) + coalesce(octet_length(encode(source)), 0)) AS BIGINT) AS b FROM documents)
SELECT n AS total_rows, b AS estimated_bytes, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B'
  WHEN b < 1048576 THEN CAST(round(b / 1024.0, 2) AS VARCHAR) || ' KB'
  ELSE CAST(round(b / 1048576.0::DOUBLE, 3) AS VARCHAR) || ' MB' END AS size_label FROM s"""


def duplicate_rows(spark, sf):
    return profile.duplicate_rows(dirty(spark, sf))


DUPLICATES = f"""WITH {DIRTY}, g AS (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(DIRTY_COLUMNS)})
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  {pct_sql('sum(n - 1)', 'sum(n)')} AS duplicate_rows_percentage FROM g"""


def duplicate_text(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").select("text"))


DUPLICATE_TEXT = f"""WITH g AS (SELECT count(*) AS n FROM documents GROUP BY text)
SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
  {pct_sql('sum(n - 1)', 'sum(n)')} AS duplicate_rows_percentage FROM g"""


def column_profile(spark, sf):
    return profile.column_profile(dirty(spark, sf)).drop("dtype", "semantic_type", "role")


COLUMN_PROFILE = f"""WITH {DIRTY}, long AS ({ALL_TEXT}),
f AS (SELECT CAST(position AS INTEGER) AS position, column_name, count(*) AS n, count(v) AS k, count(DISTINCT v) AS d
  FROM long GROUP BY ALL)
SELECT position, column_name, k AS non_null_count, {pct_sql('k', 'n')} AS non_null_percentage, n - k AS missing_count,
  {pct_sql('(n - k)', 'n')} AS missing_percentage, d AS unique_count, {pct_sql('d', 'n')} AS unique_percentage,
  k - d AS duplicate_count, {pct_sql('(k - d)', 'k')} AS duplicate_percentage, d <= 1 AS is_constant, d = n AS is_unique
FROM f"""


def column_schema(spark, sf):
    return profile.column_schema(dirty(spark, sf).drop("price", "amount", "ordered_at")).select(
        "column_name", "dtype", "missing_count", "unique_count", F.array_join("sample_values", "|").alias("samples"))


SCHEMA_COLUMNS = [c for c in DIRTY_COLUMNS if c not in ("price", "amount", "ordered_at")]
COLUMN_SCHEMA = f"""WITH {DIRTY}, long AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM dirty" for c in SCHEMA_COLUMNS)}),
s AS (SELECT column_name, string_agg(v, '|' ORDER BY v) AS samples FROM (SELECT column_name, v,
  row_number() OVER (PARTITION BY column_name ORDER BY v) AS k FROM (SELECT DISTINCT column_name, v FROM long
  WHERE v IS NOT NULL)) WHERE k <= 3 GROUP BY column_name)
SELECT column_name, CASE WHEN column_name = 'order_key' THEN 'bigint' ELSE 'string' END AS dtype,
  count(*) - count(v) AS missing_count, count(DISTINCT v) AS unique_count, any_value(samples) AS samples
FROM long JOIN s USING (column_name) GROUP BY column_name"""


def sample_values(spark, sf):
    return profile.sample_values(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


SAMPLE_VALUES = f"""WITH long AS ({long_sql('orders', ['o_orderkey', 'o_orderstatus', 'o_orderpriority'], 'value', 'VARCHAR')}),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY value) AS INTEGER) AS position
  FROM (SELECT DISTINCT * FROM long))
SELECT column_name, position, value FROM r WHERE position <= 5"""


def numeric_profile(spark, sf):
    return rounded(profile.numeric_profile(dirty(spark, sf), ["price"]))


NUMERIC_PROFILE = f"""WITH {DIRTY} SELECT 'price' AS column_name, round(avg(price), 4) AS mean,
  round(quantile_cont(price, 0.5), 4) AS median, round(stddev_samp(price), 4) AS std, round(min(price), 4) AS min,
  round(max(price), 4) AS max, round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.75), 4) AS q3,
  round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 4) AS iqr, round(skewness(price), 4) AS skewness,
  count(*) FILTER (price = 0) AS zeros_count, {pct_sql('count(*) FILTER (price = 0)', 'count(price)')} AS zeros_percentage
FROM dirty"""


def category_profile(spark, sf):
    return profile.category_profile(dirty(spark, sf), ["status", "priority", "note"])


CATEGORY_PROFILE = f"""WITH {DIRTY}, long AS ({long_sql('dirty', ['status', 'priority', 'note'])}),
c AS (SELECT column_name, v, count(*) AS n FROM long GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY column_name) AS k, sum(n) OVER (PARTITION BY column_name) AS total,
  CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS INTEGER) AS rank FROM c)
SELECT column_name, k AS num_categories, rank, v AS category, n AS count, {pct_sql('n', 'total')} AS percentage
FROM r WHERE rank <= 10"""


def boolean_profile(spark, sf):
    return profile.boolean_profile(table(spark, sf, "labels"), ["quality", "toxic"])


BOOLEAN_PROFILE = f"""WITH long AS ({long_sql('labels', ['quality', 'toxic'])})
SELECT column_name, count(*) FILTER (v = 1) AS true_count, count(*) FILTER (v <> 1) AS false_count,
  {pct_sql('count(*) FILTER (v = 1)', 'count(*)')} AS true_percentage,
  {pct_sql('count(*) FILTER (v <> 1)', 'count(*)')} AS false_percentage FROM long GROUP BY column_name"""


def text_profile(spark, sf):
    return profile.text_profile(table(spark, sf, "documents"), ["text", "source"])


TEXT_PROFILE = """WITH long AS (SELECT 'text' AS column_name, text AS v FROM documents UNION ALL SELECT 'source', source FROM documents)
SELECT column_name, round(avg(length(v)), 1) AS avg_length, CAST(min(length(v)) AS INTEGER) AS min_length,
  CAST(max(length(v)) AS INTEGER) AS max_length FROM long GROUP BY column_name"""


def quality_score(spark, sf):
    return profile.quality_score(dirty(spark, sf))


# the numeric class of the view: order_key, price, amount and price_txt
QUALITY_SCORE = f"""WITH {DIRTY}, m AS (SELECT round(CAST(sum({MISSING}) AS DOUBLE) / (count(*) * {len(DIRTY_COLUMNS)}) * 100, 2) AS miss FROM dirty),
d AS (SELECT {pct_sql('sum(n - 1)', 'sum(n)')} AS dup FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(DIRTY_COLUMNS)})),
c AS (SELECT count(*) FILTER (k = 0) AS empties, count(*) FILTER (d <= 1) AS constants
  FROM (SELECT column_name, count(v) AS k, count(DISTINCT v) AS d FROM ({ALL_TEXT}) GROUP BY column_name)),
n AS (SELECT CAST(regexp_replace(price_txt, '[$]', '') AS DOUBLE) AS t, CAST(order_key AS DOUBLE) AS k, price AS p FROM dirty),
s AS (SELECT CAST(abs(skewness(t)) > 3 AS INTEGER) + CAST(abs(skewness(k)) > 3 AS INTEGER) + CAST(abs(skewness(p)) > 3 AS INTEGER) AS skewed FROM n),
p AS (SELECT *, CAST(miss <= 15 AS INTEGER) + CAST(dup <= 5 AS INTEGER) + CAST(empties = 0 AS INTEGER)
  + CAST(constants = 0 AS INTEGER) + CAST(skewed = 0 AS INTEGER) AS passed FROM m, d, c, s),
h AS (SELECT *, round(100 - miss, 2) AS comp, round(100 - dup, 2) AS uniq,
  round((100 - miss) * 0.5::DOUBLE + (100 - dup) * 0.3::DOUBLE + passed / 5.0::DOUBLE * 100 * 0.2::DOUBLE, 1) AS score FROM p)
SELECT score AS health_score, CASE WHEN score >= 95 THEN 'A+' WHEN score >= 85 THEN 'A' WHEN score >= 75 THEN 'B'
  WHEN score >= 60 THEN 'C' WHEN score >= 45 THEN 'D' ELSE 'F' END AS health_grade, comp AS completeness_score,
  uniq AS uniqueness_score, CASE WHEN score >= 95 THEN 'Excellent Quality' WHEN score >= 85 THEN 'High Quality'
  WHEN score >= 75 THEN 'Good Quality' WHEN score >= 60 THEN 'Moderate Quality' WHEN score >= 45 THEN 'Poor Quality'
  ELSE 'Critical Issues' END AS quality_status, passed AS passed_checks, 5 AS total_checks FROM h"""


def columns_of_class(spark, sf):
    return profile.columns_of_class(dirty(spark, sf), "categorical").select("column_name", "unique_count")


COLUMNS_OF_CLASS = f"""WITH {DIRTY}, long AS ({long_sql('dirty', ['status', 'priority', 'note', 'const_col', 'near_const'])})
SELECT column_name, count(DISTINCT v) AS unique_count FROM long GROUP BY column_name HAVING count(DISTINCT v) <= 50"""


def approximate_distinct(spark, sf):
    return profile.approximate_distinct(table(spark, sf, "lineitem"))


def preview_page(spark, sf):
    return profile.preview_page(table(spark, sf, "customer"), ["c_custkey"], 3, 25).select(
        "c_custkey", "c_name", "c_acctbal")


def preview_info(spark, sf):
    return profile.preview_info(table(spark, sf, "customer"), 3, 25)


QUERIES = {
    "dataset_metrics": (dataset_metrics, DATASET_METRICS),
    "size_estimate": (size_estimate, SIZE),
    "duplicate_rows": (duplicate_rows, DUPLICATES),
    "duplicate_text": (duplicate_text, DUPLICATE_TEXT),
    "column_profile": (column_profile, COLUMN_PROFILE),
    "column_schema": (column_schema, COLUMN_SCHEMA),
    "sample_values": (sample_values, SAMPLE_VALUES),
    "numeric_profile": (numeric_profile, NUMERIC_PROFILE),
    "category_profile": (category_profile, CATEGORY_PROFILE),
    "boolean_profile": (boolean_profile, BOOLEAN_PROFILE),
    "text_profile": (text_profile, TEXT_PROFILE),
    "quality_score": (quality_score, QUALITY_SCORE),
    "columns_of_class": (columns_of_class, COLUMNS_OF_CLASS),
    "approximate_distinct": (approximate_distinct, None),
    "preview_page": (preview_page, "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50"),
    "preview_info": (preview_info, """SELECT CAST(3 AS BIGINT) AS page, CAST(25 AS BIGINT) AS page_size, count(*) AS total_rows,
  CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 25.0) AS has_next, true AS has_prev FROM customer"""),
}
