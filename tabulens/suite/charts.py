"""Queries of the chart-data and report-fact families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import chartdata, facts
from tabulens.suite.aggregates import histogram_sql
from tabulens.suite.common import DIRTY, LINE_NUMBERS, dirty, long_sql, pct_sql, rounded, table


def histogram_bins(spark, sf):
    return rounded(chartdata.histogram_bins(table(spark, sf, "orders"), "o_totalprice", 20))


def histogram_marks(spark, sf):
    return rounded(chartdata.histogram_marks(dirty(spark, sf), "price"))


MARKS = f"""WITH {DIRTY} SELECT 'price' AS column_name, round(avg(price), 4) AS mean, round(quantile_cont(price, 0.5), 4) AS median,
  count(price) AS valid_count, count(*) - count(price) AS missing_count FROM dirty"""


def _five_sql(tab, c, extra=""):
    return f"""SELECT {extra}count({c}) AS n_values, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q1,
  round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q3, round(max({c}), 4) AS max FROM {tab}"""


def box5(spark, sf):
    return rounded(chartdata.multi_box(table(spark, sf, "lineitem"), LINE_NUMBERS))


BOX5 = f"WITH long AS ({long_sql('lineitem', LINE_NUMBERS)}) " + _five_sql("long", "v", "column_name, ") + " GROUP BY column_name"


def grouped_box(spark, sf):
    return rounded(chartdata.grouped_box(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


GROUPED_BOX = _five_sql("orders", "o_totalprice", 'o_orderpriority AS "group", ') + " GROUP BY o_orderpriority"


def _top_sql(tab, c, n):
    return f"""WITH c AS (SELECT {c} AS v, count(*) AS n FROM {tab} GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k, sum(n) OVER () AS t FROM c),
u AS (SELECT k, v, n, t FROM r WHERE k <= {n} UNION ALL SELECT {n + 1}, 'Other (Aggregated)', sum(n), any_value(t) FROM r WHERE k > {n} HAVING sum(n) > 0)
SELECT CAST(k AS INTEGER) AS rank, v AS category, CAST(n AS BIGINT) AS count, {pct_sql('n', 't', 1)} AS percentage FROM u"""


def top_other_bar(spark, sf):
    return chartdata.top_and_other(table(spark, sf, "part"), "p_brand", 15)


def category_share(spark, sf):
    return chartdata.category_share(table(spark, sf, "documents"), "source")


def grouped_bar_other(spark, sf):
    return rounded(chartdata.grouped_bar(table(spark, sf, "part"), "p_brand", "p_retailprice", "mean", 10), 6)


def _grouped_sql(tab, g, value, n):
    return f"""WITH g AS (SELECT CAST({g} AS VARCHAR) AS category, {value} AS value FROM {tab} GROUP BY {g}),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, category) AS k FROM g)
SELECT category, round(value, 6) AS value, false AS is_other FROM r WHERE k <= {n}
UNION ALL SELECT 'Other (Aggregated)', round(value, 6), true FROM (SELECT {value} AS value, count(*) AS n FROM {tab}
  WHERE CAST({g} AS VARCHAR) IN (SELECT category FROM r WHERE k > {n})) WHERE n > 0"""


def grouped_bar_median(spark, sf):
    return rounded(chartdata.grouped_bar(table(spark, sf, "lineitem"), "l_suppkey", "l_quantity", "median", 5), 6)


def line_daily(spark, sf):
    return rounded(chartdata.line_points(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "mean"), 6)


LINE_DAILY = "SELECT strftime(o_orderdate, '%Y-%m-%d') AS period, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1"


def time_category(spark, sf):
    return chartdata.time_category(table(spark, sf, "orders"), "o_orderdate", "o_orderpriority", 3)


TIME_CATEGORY = """WITH t AS (SELECT o_orderpriority AS v FROM orders GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 3),
r AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, CASE WHEN o_orderpriority IN (SELECT v FROM t) THEN o_orderpriority ELSE 'Other' END AS category FROM orders),
p AS (SELECT DISTINCT period FROM r), k AS (SELECT DISTINCT category FROM r), c AS (SELECT period, category, count(*) AS n FROM r GROUP BY ALL)
SELECT period, category, coalesce(n, 0) AS count FROM p CROSS JOIN k LEFT JOIN c USING (period, category)"""


def time_category_table(spark, sf):
    return chartdata.time_category_table(table(spark, sf, "orders"), "o_orderdate", "o_orderstatus")


TIME_CATEGORY_TABLE = """SELECT strftime(o_orderdate, '%Y-%m') AS period, count(*) FILTER (o_orderstatus = 'F') AS "F",
  count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1"""


def scatter_fit(spark, sf):
    return rounded(chartdata.scatter_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


SCATTER_FIT = """SELECT count(*) AS n, min(l_quantity) AS x_min, max(l_quantity) AS x_max, round(corr(l_extendedprice, l_quantity), 4) AS r,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem"""


def scatter_line(spark, sf):
    return rounded(chartdata.scatter_line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


SCATTER_LINE = """WITH f AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, regr_slope(l_extendedprice, l_quantity) AS b,
  regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT CAST(range AS INTEGER) AS i, round(lo + range * (hi - lo) / 49, 4) AS x,
  round(a + b * (lo + range * (hi - lo) / 49), 4) AS y FROM range(50), f"""


def scatter_points(spark, sf):
    return chartdata.scatter_points(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                                    ["l_orderkey", "l_linenumber", "l_partkey"], "l_returnflag")


def box_points(spark, sf):
    return chartdata.box_points(table(spark, sf, "orders"), "o_totalprice", ["o_orderkey"])


def pie_sum(spark, sf):
    return rounded(chartdata.pie_aggregate(table(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "sum"), 2)


PIE_SUM = "SELECT o_orderpriority AS category, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1"


def custom_line(spark, sf):
    return rounded(chartdata.custom_chart(table(spark, sf, "lineitem"), "line", "l_linenumber", "l_quantity", agg="median"), 6)


CUSTOM_LINE = "SELECT l_linenumber AS x, round(quantile_cont(l_quantity, 0.5), 6) AS value FROM lineitem GROUP BY 1"


def custom_bar(spark, sf):
    return rounded(chartdata.custom_chart(table(spark, sf, "orders"), "bar", "o_orderstatus", "o_totalprice", agg="max"), 6)


CUSTOM_BAR = "SELECT o_orderstatus AS category, round(max(o_totalprice), 2) AS value, false AS is_other FROM orders GROUP BY 1"


def heatmap_cells(spark, sf):
    return rounded(chartdata.heatmap_cells(table(spark, sf, "part"), ["p_size", "p_retailprice"]), 6)


HEATMAP = """SELECT 'p_size' AS variable_a, 'p_retailprice' AS variable_b, round(corr(p_size, p_retailprice), 6) AS correlation, count(*) AS sample_size FROM part
UNION ALL SELECT 'p_retailprice', 'p_size', round(corr(p_size, p_retailprice), 6), count(*) FROM part
UNION ALL SELECT 'p_size', 'p_size', 1.0, count(*) FROM part UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0, count(*) FROM part"""


def outlier_hist(spark, sf):
    return rounded(chartdata.outlier_histogram(table(spark, sf, "customer"), "c_acctbal", 0.0, 9000.0, 12).select(
        "bin", "count", "outliers"))


OUTLIER_HIST = f"""WITH h AS ({histogram_sql('customer', 'c_acctbal', 12)}),
r AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 12 AS w FROM customer),
o AS (SELECT CAST(least(floor((c_acctbal - lo) / w), 11) AS INTEGER) AS bin, count(*) AS n FROM customer, r
  WHERE c_acctbal < 0 OR c_acctbal > 9000 GROUP BY 1)
SELECT h.bin, h.count, coalesce(o.n, 0) AS outliers FROM h LEFT JOIN o USING (bin)"""

CHART_ROLES = {"numerical": ["o_totalprice"], "categorical": ["o_orderstatus", "o_orderpriority"],
               "datetime": ["o_orderdate"]}


def chart_rank(spark, sf):
    return chartdata.chart_ranking(table(spark, sf, "orders"), CHART_ROLES).withColumn(
        "columns_used", F.array_join("columns_used", ","))


CHART_RANK = """WITH n AS (SELECT skewness(o_totalprice) AS sk, quantile_cont(o_totalprice, 0.75) > quantile_cont(o_totalprice, 0.25) AS wide FROM orders),
cat AS (SELECT c, pos, count(*) AS k, max(n) / sum(n) AS top FROM (
  SELECT 'o_orderstatus' AS c, 1 AS pos, o_orderstatus AS v, count(*) AS n FROM orders GROUP BY ALL
  UNION ALL SELECT 'o_orderpriority', 2, o_orderpriority, count(*) FROM orders GROUP BY ALL) GROUP BY ALL),
sp AS (SELECT c, pos, stddev_samp(m) AS s FROM (SELECT 'o_orderstatus' AS c, 1 AS pos, o_orderstatus AS v, avg(o_totalprice) AS m FROM orders GROUP BY ALL
  UNION ALL SELECT 'o_orderpriority', 2, o_orderpriority, avg(o_totalprice) FROM orders GROUP BY ALL) GROUP BY ALL),
cand AS (
SELECT 'histogram' AS chart_type, 'Distributions' AS category, 'o_totalprice' AS columns_used, round(65 + least(25, abs(sk) * 10) + 10, 1)::DOUBLE AS score, 2 AS seq FROM n
UNION ALL SELECT 'box', 'Distributions', 'o_totalprice', 60 + CASE WHEN wide THEN 15 ELSE 0 END + 10, 3 FROM n
UNION ALL SELECT 'bar', 'Categorical', c, round(70 + CASE WHEN k BETWEEN 2 AND 10 THEN 15 ELSE 5 END - CASE WHEN top > 0.9 THEN top * 10 ELSE 0 END, 1), 10000 + pos * 2 FROM cat WHERE k BETWEEN 2 AND 30
UNION ALL SELECT 'pie', 'Categorical', c, 72 + CASE WHEN k BETWEEN 2 AND 6 THEN 15 ELSE 0 END, 10001 + pos * 2 FROM cat WHERE k BETWEEN 2 AND 8
UNION ALL SELECT 'line', 'Trends', 'o_orderdate,o_totalprice', 85, 2000000
UNION ALL SELECT 'bar', 'Categorical', c || ',o_totalprice', 75 + CASE WHEN s > 0 THEN 10 ELSE 0 END + CASE WHEN k BETWEEN 3 AND 10 THEN 5 ELSE 0 END, 3000001 + pos * 1000 FROM cat JOIN sp USING (c, pos) WHERE k BETWEEN 2 AND 20
UNION ALL SELECT 'bar', 'Trends', 'o_orderdate,' || c, 80, 4000000 + pos FROM cat WHERE k BETWEEN 2 AND 8),
r AS (SELECT *, row_number() OVER (PARTITION BY chart_type ORDER BY score DESC, seq) AS t, count(*) OVER () AS total FROM cand)
SELECT chart_type, category, columns_used, score, CASE WHEN score >= CASE WHEN seq BETWEEN 3000000 AND 3999999 THEN 82 ELSE 80 END THEN 'High' ELSE 'Medium' END AS priority,
  CAST(row_number() OVER (ORDER BY score DESC, seq) AS INTEGER) AS rank FROM r WHERE t <= 4 OR total <= 10 ORDER BY score DESC, seq LIMIT 10"""


def category_distributions(spark, sf):
    return facts.category_distributions(dirty(spark, sf), ["status", "priority", "near_const"])


DISTRIBUTIONS = f"""WITH {DIRTY}, c AS (SELECT column_name, v, count(*) AS n FROM ({long_sql('dirty', ['status', 'priority', 'near_const'])}) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS INTEGER) AS rank,
  sum(n) OVER (PARTITION BY column_name) AS t, count(*) OVER (PARTITION BY column_name) AS k FROM c)
SELECT column_name, k AS num_categories, rank, v AS category, n AS count, {pct_sql('n', 't')} AS percentage FROM r WHERE rank <= 5"""


def time_horizons(spark, sf):
    return facts.time_horizons(table(spark, sf, "events"), ["ts"])


HORIZONS = """SELECT 'ts' AS column_name, strftime(min(ts), '%Y-%m-%d') AS start_date, strftime(max(ts), '%Y-%m-%d') AS end_date,
  CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS total_days_span, count(ts) AS records_count FROM events"""


def report_facts(spark, sf):
    return facts.report_facts(dirty(spark, sf))


QUERIES = {
    "chart_histogram": (histogram_bins, histogram_sql("orders", "o_totalprice", 20)),
    "chart_histogram_marks": (histogram_marks, MARKS),
    "box5": (box5, BOX5),
    "grouped_box": (grouped_box, GROUPED_BOX),
    "top_other_bar": (top_other_bar, _top_sql("part", "p_brand", 15)),
    "category_share": (category_share, _top_sql("documents", "source", 10)),
    "grouped_bar_other": (grouped_bar_other, _grouped_sql("part", "p_brand", "avg(p_retailprice)", 10)),
    "grouped_bar_median": (grouped_bar_median, _grouped_sql("lineitem", "l_suppkey", "quantile_cont(l_quantity, 0.5)", 5)),
    "line_daily": (line_daily, LINE_DAILY),
    "time_category": (time_category, TIME_CATEGORY),
    "time_category_table": (time_category_table, TIME_CATEGORY_TABLE),
    "scatter_fit": (scatter_fit, SCATTER_FIT),
    "scatter_line": (scatter_line, SCATTER_LINE),
    "scatter_points": (scatter_points, None),
    "box_points": (box_points, None),
    "pie_sum": (pie_sum, PIE_SUM),
    "custom_line": (custom_line, CUSTOM_LINE),
    "custom_bar": (custom_bar, CUSTOM_BAR),
    "heatmap_cells": (heatmap_cells, HEATMAP),
    "outlier_hist": (outlier_hist, OUTLIER_HIST),
    "chart_rank": (chart_rank, CHART_RANK),
    "category_distributions": (category_distributions, DISTRIBUTIONS),
    "time_horizons": (time_horizons, HORIZONS),
    "report_facts": (report_facts, None),
}
