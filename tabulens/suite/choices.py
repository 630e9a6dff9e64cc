"""Default column choices, warnings, recommendations and samples, each checked by rules written in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabulens.operators import chartdata, correlation, facts, outliers, quality, stats, types
from tabulens.plans import sampling
from tabulens.suite.classes import TABLES, features_sql
from tabulens.suite.common import DIRTY, dirty, pct_sql, table

FEATURES = f"WITH {features_sql([*TABLES])}"


def _named(spark, sf, choose) -> DataFrame:
    """Names that a rule chooses in every table."""
    rows = [(t, c) for t in TABLES for c in choose(dirty(spark, sf) if t == "dirty" else table(spark, sf, t))]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def correlation_columns(spark, sf):
    return _named(spark, sf, correlation.numeric_features)


CORRELATION_COLUMNS = f"""{FEATURES} SELECT table_name, column_name FROM features
WHERE storage IN ('integer', 'float') OR semantic_type = 'Numerical'"""


def outlier_columns(spark, sf):
    return _named(spark, sf, types.outlier_columns)


OUTLIER_COLUMNS = f"""{FEATURES} SELECT table_name, column_name FROM features
WHERE semantic_type <> 'Boolean' AND (storage IN ('integer', 'float') OR semantic_type = 'Numerical')"""


def column_split(spark, sf):
    def families(df):
        return [f"{kind}:{c}" for kind, names in zip(("numerical", "categorical", "datetime"), stats.split_by_class(df)) for c in names]
    return _named(spark, sf, families).select("table_name", F.split("column_name", ":")[0].alias("family"),
                                              F.split("column_name", ":")[1].alias("column_name"))


COLUMN_SPLIT = f"""{FEATURES} SELECT table_name, column_name, CASE
  WHEN semantic_type = 'Numerical' OR (semantic_type = 'Other' AND storage IN ('integer', 'float')) THEN 'numerical'
  WHEN semantic_type = 'Datetime' THEN 'datetime' ELSE 'categorical' END AS family FROM features"""


def default_correlations(spark, sf):
    """Correlations of the columns that are chosen where none are named."""
    found = correlation.correlation_pairs(table(spark, sf, "lineitem"))
    return found.select("variable_a", "variable_b", F.round("correlation", 6).alias("correlation"), "sample_size")


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DEFAULT_CORRELATIONS = " UNION ALL ".join(
    f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, round(corr({a}, {b}), 6) AS correlation, count(*) AS sample_size FROM lineitem"
    for i, a in enumerate(_LINE) for b in _LINE[i + 1:])


def _warned(spark, sf) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        v.alias("plain"), F.lit(5.0).alias("flat"), F.when(k < 7, v).alias("few"), F.when(k % 5 == 0, v).otherwise(1.0).alias("mostly_one"),
        (v * v * v).alias("tailed"), F.lit(None).cast("double").alias("none"))


def outlier_warnings(spark, sf):
    parts = [outliers.outlier_summary(_warned(spark, sf), ["plain", "flat", "few", "mostly_one", "tailed", "none"], m)
             for m in ("iqr", "zscore", "modified_zscore")]
    return reduce(DataFrame.unionByName, parts).select(
        "column_name", "method", F.array_join("warnings", ",").alias("warnings"))


OUTLIER_WARNINGS = """WITH w AS (SELECT o_totalprice AS plain, 5.0::DOUBLE AS flat, CASE WHEN o_orderkey < 7 THEN o_totalprice END AS few,
  CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice ELSE 1.0 END AS mostly_one, o_totalprice * o_totalprice * o_totalprice AS tailed,
  CAST(NULL AS DOUBLE) AS none FROM orders),
long AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS c, {c} AS v FROM w" for c in (
    "plain", "flat", "few", "mostly_one", "tailed", "none")) + """),
q AS (SELECT c, count(v) AS n, min(v) = max(v) AS flat, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, mad(v) AS spread,
  skewness(v) AS sk FROM long GROUP BY c), m AS (SELECT unnest(['iqr', 'zscore', 'modified_zscore']) AS method)
SELECT c AS column_name, method, CASE WHEN n = 0 THEN 'no_data' ELSE array_to_string(list_filter([
  CASE WHEN n < (CASE WHEN method = 'zscore' THEN 30 ELSE 10 END) THEN 'small_sample' END,
  CASE WHEN method <> 'modified_zscore' AND flat THEN 'zero_variance' END,
  CASE WHEN method = 'iqr' AND iqr = 0 AND NOT flat THEN 'zero_iqr' END,
  CASE WHEN method = 'modified_zscore' AND spread = 0 THEN 'zero_mad' END,
  CASE WHEN method = 'zscore' AND abs(sk) > 1 THEN 'high_skewness' END], lambda x: x IS NOT NULL), ',') END AS warnings FROM q, m"""


def recommendations(spark, sf):
    df = dirty(spark, sf)
    columns = ["price", "amount", "order_key"]
    issues = quality.column_issues(df, [quality.constant_rules, quality.whitespace_rules, quality.invalid_number_rules])
    found = facts.recommendations(issues, correlation.correlation_pairs(df, columns), outliers.outlier_totals(df, columns))
    return found.withColumn("value", F.round("value", 6))


def _fence(c: str) -> str:
    return f"""(SELECT count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) FROM dirty,
  (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM dirty))"""


RECOMMENDATIONS = f"""WITH {DIRTY}, pairs AS (SELECT 'price' AS a, 'amount' AS b, corr(price, amount) AS r FROM dirty WHERE NOT isinf(amount)
  UNION ALL SELECT 'price', 'order_key', corr(price, order_key) FROM dirty
  UNION ALL SELECT 'amount', 'order_key', corr(amount, order_key) FROM dirty WHERE NOT isinf(amount))
SELECT 'cleaning' AS area, 'drop_column' AS rule, 'const_col' AS column_a, CAST(NULL AS VARCHAR) AS column_b,
  CAST(count(*) AS DOUBLE) AS value FROM dirty
UNION ALL SELECT 'cleaning', 'strip', 'status', NULL, count(*) FILTER (status <> trim(status)) FROM dirty
UNION ALL SELECT 'cleaning', 'null_invalid', c, NULL, n FROM (
  {" UNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER (isinf({v})) + count(*) FILTER ({v} IN (-999, -9999, 9999, 99999)) + {neg} AS n FROM dirty"
                      for c, v, neg in (("price", "price", "count(*) FILTER (price < 0)"), ("amount", "amount", "count(*) FILTER (amount < 0)"),
                                        ("order_key", "CAST(order_key AS DOUBLE)", "0")))}) WHERE n > 0
UNION ALL (SELECT 'features', 'combine', a, b, round(r, 6) FROM pairs ORDER BY abs(r) DESC, a, b LIMIT 1)
UNION ALL SELECT 'features', 'decorrelate', a, b, round(r, 6) FROM pairs WHERE abs(r) >= 0.85
UNION ALL SELECT 'modeling', 'robust_loss', NULL, NULL, {_fence('price')} + {_fence('amount')} + {_fence('order_key')}"""


def _sample_check(sample: DataFrame, whole: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Sampled rows, those found in the table with all their values, and different keys, per group."""
    same = reduce(lambda a, b: a & b, [sample[c].eqNullSafe(whole[c]) for c in sample.columns])
    matched = sample.join(whole, same, "left_semi")
    return sample.groupBy(*by).agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct(*keys).alias("different")) \
        .join(matched.groupBy(*by).agg(F.count(F.lit(1)).alias("found")), by, "left").select(*by, "sampled", "different", "found")


def box_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"), F.lit("all").alias("which"))
    sample = chartdata.box_points(table(spark, sf, "orders"), "o_totalprice", ["o_orderkey"]).withColumn("which", F.lit("all"))
    return _sample_check(sample, orders, ["o_orderkey"], ["which"])


BOX_SAMPLE = f"""SELECT 'all' AS which, least(count(*), {chartdata.BOX_POINTS}) AS sampled, least(count(*), {chartdata.BOX_POINTS}) AS different,
  least(count(*), {chartdata.BOX_POINTS}) AS found FROM orders WHERE o_totalprice IS NOT NULL"""

def scatter_sample(spark, sf):
    """The sampled pairs of a scatter chart, of all colours: their number and those found in the table."""
    lines = table(spark, sf, "lineitem").select(*SAMPLE_KEYS, F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
                                                F.col("l_returnflag").alias("color"), F.lit("all").alias("which"))
    sample = chartdata.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", SAMPLE_KEYS, "l_returnflag")
    return _sample_check(sample.withColumn("which", F.lit("all")), lines, SAMPLE_KEYS, ["which"]).drop("different")


SCATTER_SAMPLE = f"""SELECT 'all' AS which, least(count(*), {chartdata.SCATTER_POINTS}) AS sampled, least(count(*), {chartdata.SCATTER_POINTS}) AS found
FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_returnflag IS NOT NULL"""

SAMPLE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def stratified_sample(spark, sf):
    """Samples of two halves of a table, merged, per return flag."""
    lines = table(spark, sf, "lineitem").select(*SAMPLE_KEYS, "l_returnflag", "l_quantity")
    halves = [sampling.stratified_sample(lines.where(F.col("l_orderkey") % 2 == k), "l_returnflag", SAMPLE_KEYS, 500) for k in (0, 1)]
    merged = sampling.merge_samples(halves[0].unionByName(halves[1]), "l_returnflag", SAMPLE_KEYS, 500)
    whole = sampling.stratified_sample(lines, "l_returnflag", SAMPLE_KEYS, 500)
    both = merged.select(*SAMPLE_KEYS, "l_returnflag").intersect(whole.select(*SAMPLE_KEYS, "l_returnflag"))
    return _sample_check(whole.drop("_hash"), lines, SAMPLE_KEYS, ["l_returnflag"]).join(
        both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("merged")), "l_returnflag")


STRATIFIED = """SELECT l_returnflag, least(n, 500) AS sampled, least(n, 500) AS different, least(n, 500) AS found, least(n, 500) AS merged
FROM (SELECT l_returnflag, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem) GROUP BY 1)"""

QUERIES = {
    "correlation_columns": (correlation_columns, CORRELATION_COLUMNS),
    "outlier_columns": (outlier_columns, OUTLIER_COLUMNS),
    "column_split": (column_split, COLUMN_SPLIT),
    "default_correlations": (default_correlations, DEFAULT_CORRELATIONS),
    "outlier_warnings": (outlier_warnings, OUTLIER_WARNINGS),
    "recommendations": (recommendations, RECOMMENDATIONS),
    "box_sample": (box_sample, BOX_SAMPLE),
    "scatter_sample": (scatter_sample, SCATTER_SAMPLE),
    "stratified_sample": (stratified_sample, STRATIFIED),
}
