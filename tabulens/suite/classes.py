"""SQL that applies the typing rules to whole tables, and the queries checked with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabulens.operators import profile, types
from tabulens.plans import sketches
from tabulens.suite.common import DIRTY, STRIP, dirty, pct_sql, rounded, table, ts_text

# column, Spark type
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
              " o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
                " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
                " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "dirty": "order_key bigint, price double, amount double, status string, priority string, note string, price_txt string,"
             " date_txt string, const_col string, near_const string, ordered_at timestamp"}
STORAGE = {"bigint": "integer", "int": "integer", "double": "float", "string": "text", "timestamp_ntz": "datetime",
           "timestamp": "datetime"}
DATE_FORMATS = ["%Y-%m-%d", "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y",
                "%m-%d-%Y", "%d-%m-%Y", "%b %d, %Y", "%d %b %Y", "%B %d, %Y", "%d %B %Y"]
NUMBER_SQL = ("regexp_matches(regexp_replace({}, '[$,€£%\\s]', '', 'g'),"
              " '^[+-]?(([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$')")


def columns_of(name: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in TABLES[name].split(", ")]


def features_sql(tables: list[str]) -> str:
    """CTEs up to ``features``: one row per column of the given tables."""
    parts = []
    for t in tables:
        for i, (c, dtype) in enumerate(columns_of(t)):
            storage, low = STORAGE[dtype], f"lower({STRIP.format(c)})"
            text = storage == "text"
            words = " OR ".join(f"coalesce(bool_and({low} IN ({', '.join(map(repr, w))})), false)" for w in types.BOOLEAN_WORDS)
            role_words = " OR ".join(f"coalesce(bool_and({low} IN ({', '.join(map(repr, w))})), false)"
                                     for w in types.ROLE_BOOLEAN_WORDS)
            dates = f"try_strptime({STRIP.format(c)}, {DATE_FORMATS}) IS NOT NULL"
            measures = {
                "zero_one": f"coalesce(bool_and({c} IN (0, 1)), false)" if storage in ("integer", "float") else "false",
                "words": words if text else "false", "role_words": role_words if text else "false",
                "separated": f"coalesce(bool_or(regexp_matches({c}, '[-/:\\s,]')), false)" if text else "false",
                "date_share": f"avg(CAST({dates} AS DOUBLE)) FILTER ({c} IS NOT NULL)" if text else "CAST(NULL AS DOUBLE)",
                "number_share": f"avg(CAST({NUMBER_SQL.format(c)} AS DOUBLE))" if text else "CAST(NULL AS DOUBLE)",
                "mean_length": f"avg(length({c}))" if text else "CAST(NULL AS DOUBLE)"}
            parts.append(f"SELECT '{t}' AS table_name, {i} AS position, '{c}' AS column_name, '{dtype}' AS dtype,"
                         f" '{storage}' AS storage, count(*) AS n_rows, count({c}) AS n_valid, count(DISTINCT {c}) AS n_distinct, "
                         + ", ".join(f"{sql} AS {m}" for m, sql in measures.items()) + f" FROM {t}")
    named = lambda names: f"regexp_matches(lower(column_name), '{'|'.join(names)}')"
    is_number = "storage IN ('integer', 'float')"
    is_id = lambda names: f"({named(names)} OR lower(column_name) = 'id')"
    date = "(storage = 'text' AND separated AND date_share >= 0.8)"
    return f"""{DIRTY}, measured AS ({' UNION ALL '.join(parts)}),
shares AS (SELECT *, n_distinct / nullif(n_valid, 0)::DOUBLE AS ratio, n_distinct / greatest(n_rows, 1)::DOUBLE AS row_ratio
  FROM measured),
features AS (SELECT *, CASE WHEN n_valid = 0 THEN 'Other' WHEN ({is_number} AND zero_one) OR words THEN 'Boolean'
    WHEN storage = 'datetime' OR {date} THEN 'Datetime'
    WHEN storage = 'integer' AND n_distinct <= 5 AND n_valid >= 30 AND {named(types.RATING_NAMES)} THEN 'Categorical'
    WHEN {is_number} OR (storage = 'text' AND number_share >= 0.9) THEN 'Numerical'
    WHEN {is_id(types.ID_NAMES)} AND (ratio >= 0.5 OR n_distinct >= 10) THEN 'Other'
    WHEN n_distinct = n_valid AND n_valid >= 15 THEN 'Other'
    WHEN storage = 'text' AND mean_length > 60 AND ratio > 0.4 THEN 'Other'
    WHEN n_distinct <= 50 OR ratio <= 0.30 THEN 'Categorical' ELSE 'Other' END AS semantic_type,
  CASE WHEN n_valid = 0 THEN NULL WHEN storage = 'datetime' OR {date} THEN 'datetime'
    WHEN ({is_number} AND zero_one AND {named(types.BOOLEAN_NAMES)}) OR role_words THEN 'boolean'
    WHEN {is_id(types.ROLE_ID_NAMES)} AND NOT {is_number} THEN 'identifier'
    WHEN NOT {is_number} AND n_distinct > 50 AND row_ratio >= 0.85 THEN 'identifier'
    WHEN {is_number} AND {is_id(types.ROLE_ID_NAMES)} AND row_ratio >= 0.95 THEN 'identifier'
    WHEN {is_number} AND n_distinct > 1 THEN 'numerical' WHEN {is_number} THEN NULL
    WHEN n_distinct <= 60 OR row_ratio <= 0.5 THEN 'categorical' ELSE 'identifier' END AS role FROM shares)"""


def _over_tables(spark, sf, operator) -> DataFrame:
    frames = [operator(dirty(spark, sf) if t == "dirty" else table(spark, sf, t)).withColumn("table_name", F.lit(t))
              for t in TABLES]
    return reduce(DataFrame.unionByName, frames)


def semantic_types(spark, sf):
    return _over_tables(spark, sf, types.semantic_types)


SEMANTIC_TYPES = f"WITH {features_sql([*TABLES])} SELECT table_name, column_name, dtype, semantic_type FROM features"


def column_roles(spark, sf):
    return _over_tables(spark, sf, types.column_roles)


COLUMN_ROLES = f"WITH {features_sql([*TABLES])} SELECT table_name, column_name, dtype, role FROM features"


def class_counts(spark, sf):
    return types.class_counts(table(spark, sf, "orders"))


CLASS_COUNTS = f"""WITH {features_sql(['orders'])}, classes AS (SELECT unnest({types.CLASSES}) AS semantic_type)
SELECT semantic_type, count(column_name) AS column_count FROM classes LEFT JOIN features USING (semantic_type) GROUP BY semantic_type"""


def ingestion_summary(spark, sf):
    return profile.ingestion_summary(table(spark, sf, "orders")).select(
        "column_name", "dtype", "semantic_type", "non_null_count", "missing_count", "unique_count")


INGESTION = f"""WITH {features_sql(['orders'])} SELECT column_name, dtype, semantic_type, n_valid AS non_null_count,
  n_rows - n_valid AS missing_count, n_distinct AS unique_count FROM features"""


def profile_table(spark, sf):
    t = profile.profile_table(dirty(spark, sf))
    return rounded(t.withColumn("min_date", ts_text("min_date")).withColumn("max_date", ts_text("max_date")))


_NUMBERS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {sql} AS v FROM dirty" for c, sql in (
        ("order_key", "CAST(order_key AS DOUBLE)"), ("price", "price"), ("amount", "amount"),
        ("price_txt", "CAST(regexp_replace(price_txt, '[$]', '') AS DOUBLE)")))
_LABELS = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM dirty WHERE {c} IS NOT NULL"
                             for c in ("status", "priority", "note", "const_col", "near_const"))
_TIMES = ("SELECT 'date_txt' AS column_name, strptime(date_txt, '%Y-%m-%d') AS v FROM dirty"
          " UNION ALL SELECT 'ordered_at', ordered_at FROM dirty")
PROFILE_TABLE = f"""WITH {features_sql(['dirty'])}, numbers AS ({_NUMBERS}), labels_ AS ({_LABELS}), times AS ({_TIMES}),
num AS (SELECT column_name, avg(v) AS mean, quantile_cont(v, 0.5) AS median, min(v) AS min, max(v) AS max,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, coalesce(bool_or(isinf(v)), false) AS endless,
  stddev_samp(CASE WHEN NOT isinf(v) THEN v END) AS std, skewness(CASE WHEN NOT isinf(v) THEN v END) AS skewness,
  count(*) FILTER (v = 0) AS zeros, count(v) AS n FROM numbers GROUP BY column_name),
counted AS (SELECT column_name, v, count(*) AS n FROM labels_ GROUP BY ALL),
cat AS (SELECT column_name, count(*) AS num_categories, min(v) FILTER (r = 1) AS top, max(n) AS mode_frequency, sum(n) AS total
  FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS r FROM counted) GROUP BY column_name),
span AS (SELECT column_name, min(v) AS low, max(v) AS high, date_diff('day', min(v), max(v)) AS days FROM times GROUP BY column_name)
SELECT column_name, CAST(position AS INTEGER) AS position, dtype, semantic_type, role, n_valid AS non_null_count,
  {pct_sql('n_valid', 'n_rows')} AS non_null_percentage, n_rows - n_valid AS missing_count,
  {pct_sql('(n_rows - n_valid)', 'n_rows')} AS missing_percentage, n_distinct AS unique_count,
  {pct_sql('n_distinct', 'n_rows')} AS unique_percentage, n_valid - n_distinct AS duplicate_count,
  {pct_sql('(n_valid - n_distinct)', 'n_valid')} AS duplicate_percentage, n_distinct <= 1 AS is_constant, n_distinct = n_rows AS is_unique,
  round(mean, 4) AS mean, round(median, 4) AS median, round(CASE WHEN endless THEN 0.0 ELSE std END, 4) AS std,
  round(min, 4) AS min, round(max, 4) AS max, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  round(CASE WHEN endless THEN 0.0 ELSE skewness END, 4) AS skewness, zeros AS zeros_count, {pct_sql('zeros', 'n')} AS zeros_percentage,
  num_categories, top AS most_frequent_category, mode_frequency, {pct_sql('mode_frequency', 'total')} AS mode_percentage,
  strftime(low, '%Y-%m-%d %H:%M:%S') AS min_date, strftime(high, '%Y-%m-%d %H:%M:%S') AS max_date, days AS date_range_days,
  format('{{:,}}', days) || ' days' || CASE WHEN days >= 365 THEN ' (~' || CAST(round(days / 365.25::DOUBLE, 1) AS VARCHAR) || ' years)'
    WHEN days >= 30 THEN ' (~' || CAST(round(days / 30.4::DOUBLE, 1) AS VARCHAR) || ' months)' ELSE '' END AS date_range_formatted
FROM features LEFT JOIN num USING (column_name) LEFT JOIN cat USING (column_name) LEFT JOIN span USING (column_name)"""


def distinct_bounds(spark, sf):
    """Sketches of two halves of a table, merged; whether the bounds hold the exact count."""
    lines = table(spark, sf, "lineitem")
    halves = [sketches.distinct_sketches(lines.where(F.col("l_linenumber") % 2 == k)) for k in (0, 1)]
    bounds = sketches.distinct_bounds(sketches.merge_sketches(reduce(DataFrame.unionByName, halves)))
    exact = types.exact_distinct(lines)
    return bounds.join(exact, "column_name").select(
        "column_name", "n_valid", "n_distinct", F.col("n_distinct").between(F.col("at_least"), F.col("at_most")).alias("inside"),
        (F.col("at_most") - F.col("at_least") <= F.greatest(F.lit(4), F.col("n_distinct") * 0.1)).alias("narrow"))


DISTINCT_BOUNDS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_valid, count(DISTINCT {c}) AS n_distinct, true AS inside, true AS narrow FROM lineitem"
    for c, _ in columns_of("lineitem"))

QUERIES = {
    "class_counts": (class_counts, CLASS_COUNTS),
    "semantic_types": (semantic_types, SEMANTIC_TYPES),
    "column_roles": (column_roles, COLUMN_ROLES),
    "profile_table": (profile_table, PROFILE_TABLE),
    "ingestion_summary": (ingestion_summary, INGESTION),
    "distinct_bounds": (distinct_bounds, DISTINCT_BOUNDS),
}
