"""Queries of the question tools: rankings, scalars, time series, distributions, leads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import tools
from tabulens.suite.common import DIRTY, LINE_NUMBERS, dirty, pct_sql, rounded, table


def _rank(tab, group, metric, agg, descending=True, limit=10):
    return lambda spark, sf: rounded(tools.group_rank(table(spark, sf, tab), group, metric, agg, descending, limit))


def _rank_sql(tab, group, value, share, descending=True, limit=10):
    way = "DESC" if descending else "ASC"
    pct = "round(value / greatest(sum(value) OVER (), 0.00001) * 100, 2)" if share else "CAST(NULL AS DOUBLE)"
    return f"""WITH g AS (SELECT CAST({group} AS VARCHAR) AS "group", CAST({value} AS DOUBLE) AS value FROM {tab} GROUP BY {group}),
r AS (SELECT CAST(row_number() OVER (ORDER BY value {way}, "group") AS INTEGER) AS rank, "group", round(value, 4) AS value,
  round({pct}, 4) AS percentage_of_total, count(*) OVER () AS total_groups FROM g)
SELECT * FROM r WHERE rank <= {limit}"""


def group_rank_sum(spark, sf):
    return rounded(tools.group_rank(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice", "sum"), 2)


GROUP_RANK_SUM = _rank_sql("lineitem", "l_returnflag", "sum(l_extendedprice)", True).replace("round(value, 4)", "round(value, 2)")


def group_extremes(spark, sf):
    return rounded(tools.group_extremes(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice", "sum"), 2)


GROUP_EXTREMES = """WITH g AS (SELECT CAST(l_suppkey AS VARCHAR) AS "group", sum(l_extendedprice) AS value FROM lineitem GROUP BY l_suppkey),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, "group") AS a, row_number() OVER (ORDER BY value, "group" DESC) AS b FROM g)
SELECT 'top' AS position, "group", round(value, 2) AS value FROM r WHERE a = 1
UNION ALL SELECT 'bottom', "group", round(value, 2) FROM r WHERE b = 1"""


def agg_scalars(spark, sf):
    return rounded(tools.aggregate_scalars(table(spark, sf, "orders"), "o_totalprice", "average"), 4, sum=2)


AGG_SCALARS = """SELECT 'o_totalprice' AS column_name, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS sum,
  round(min(o_totalprice), 4) AS min, round(max(o_totalprice), 4) AS max, round(stddev_samp(o_totalprice), 4) AS std,
  count(*) AS count, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(avg(o_totalprice), 4) AS primary_value FROM orders"""


def dataset_summary(spark, sf):
    return tools.dataset_summary(table(spark, sf, "orders"))


DATASET_SUMMARY = """SELECT count(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns, CAST(0 AS BIGINT) AS missing_cells,
  CAST(0 AS DOUBLE) AS missing_cells_percentage, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows,
  CAST(0 AS DOUBLE) AS duplicate_rows_percentage FROM orders"""


def dataset_columns(spark, sf):
    return tools.dataset_columns(table(spark, sf, "orders")).select("column_name", "role", "missing_count", "unique_count")


DATASET_COLUMNS = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{r}' AS role, count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count FROM orders"
    for c, r in (("o_orderkey", "identifier"), ("o_custkey", "numerical"), ("o_orderstatus", "categorical"),
                 ("o_totalprice", "numerical"), ("o_orderdate", "datetime"), ("o_orderpriority", "categorical")))


def column_summary_number(spark, sf):
    return tools.column_summary(table(spark, sf, "orders"), "o_totalprice").select(
        "metric", F.round(F.col("value").cast("double"), 2).alias("value"))


COLUMN_NUMBER = "WITH s AS (SELECT avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median, " \
    "stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, " \
    "quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.75) AS q75, " \
    "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr, skewness(o_totalprice) AS skewness, " \
    "kurtosis(o_totalprice) AS kurtosis, sum(o_totalprice) AS sum FROM orders) " + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round({m}, 2) AS value FROM s"
        for m in ("mean", "median", "std", "min", "max", "q25", "q75", "iqr", "skewness", "kurtosis", "sum"))


def column_summary_category(spark, sf):
    return tools.column_summary(table(spark, sf, "orders"), "o_orderpriority")


COLUMN_CATEGORY = f"""WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k, sum(n) OVER () AS t FROM c)
SELECT 'top_' || k AS metric, v AS value, n AS count, {pct_sql('n', 't')} AS percentage FROM r WHERE k <= 5"""


def column_summary_date(spark, sf):
    return tools.column_summary(table(spark, sf, "events"), "ts").select("metric", "value")


COLUMN_DATE = """SELECT 'earliest_date' AS metric, strftime(min(ts), '%Y-%m-%d') AS value FROM events
UNION ALL SELECT 'latest_date', strftime(max(ts), '%Y-%m-%d') FROM events
UNION ALL SELECT 'total_days_span', CAST(CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS VARCHAR) FROM events"""


def correlation_top(spark, sf):
    return rounded(tools.correlation_top(table(spark, sf, "lineitem"), LINE_NUMBERS, 3).select(
        "variable_a", "variable_b", "correlation", "sample_size"), 6)


CORRELATION_TOP = "SELECT variable_a, variable_b, round(r, 6) AS correlation, n AS sample_size FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem"
    for i, a in enumerate(LINE_NUMBERS) for b in LINE_NUMBERS[i + 1:]) + ") ORDER BY abs(r) DESC, variable_a, variable_b LIMIT 3"


def outlier_overview(spark, sf):
    return rounded(tools.outlier_overview(table(spark, sf, "events"), ["value", "user_id"]).drop("status"), 6)


OUTLIER_OVERVIEW = " UNION ALL ".join(f"""SELECT '{c}' AS column_name, o AS outlier_count, {pct_sql('o', 'n')} AS outlier_percentage,
  round(lo, 6) AS lower_threshold, round(hi, 6) AS upper_threshold FROM (SELECT any_value(n) AS n, any_value(lo) AS lo,
  any_value(hi) AS hi, count(*) FILTER ({c} < lo OR {c} > hi) AS o FROM events, (SELECT n, a - 1.5 * (b - a) AS lo,
  b + 1.5 * (b - a) AS hi FROM (SELECT count({c}) AS n, quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM events)))
WHERE o > 0""" for c in ("value", "user_id"))


def outlier_samples(spark, sf):
    return rounded(tools.outlier_samples(table(spark, sf, "events"), "value"), 6)


OUTLIER_SAMPLES = """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events),
f AS (SELECT value, a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM events, q)
SELECT 'value' AS column_name, round(value, 6) AS value, CASE WHEN value < lo THEN 'below_lower' ELSE 'above_upper' END AS direction,
  round(abs(value - CASE WHEN value < lo THEN lo ELSE hi END), 6) AS deviation FROM f WHERE value < lo OR value > hi
ORDER BY abs(value - CASE WHEN value < lo THEN lo ELSE hi END) DESC, value LIMIT 6"""


def ts_year(spark, sf):
    return rounded(tools.time_series(table(spark, sf, "lineitem"), "l_shipdate", "l_extendedprice"), 2)


TS_YEAR = """SELECT strftime(l_shipdate, '%Y') AS period, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1"""


def ts_month(spark, sf):
    return rounded(tools.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", "mean"), 6)


TS_MONTH = "SELECT strftime(o_orderdate, '%Y-%m') AS period, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1"


def ts_day_full(spark, sf):
    return rounded(tools.time_series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "day", "sum"), 2)


TS_DAY = """WITH d AS (SELECT date_trunc('day', o_orderdate) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1),
s AS (SELECT unnest(generate_series((SELECT min(d) FROM d), (SELECT max(d) FROM d), INTERVAL 1 DAY)) AS d)
SELECT strftime(s.d, '%Y-%m-%d') AS period, round(coalesce(v, 0), 2) AS value FROM s LEFT JOIN d ON s.d = d.d"""


def ts_auto_events(spark, sf):
    return rounded(tools.time_series_head(table(spark, sf, "events"), "ts", "value"), 2)


TS_EVENTS = """WITH sp AS (SELECT floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS days FROM events),
b AS (SELECT CASE WHEN days > 730 THEN strftime(ts, '%Y') WHEN days > 60 THEN strftime(ts, '%Y-%m')
  ELSE strftime(ts, '%Y-%m-%d') END AS period, value FROM events, sp)
SELECT period, round(sum(value), 2) AS value FROM b GROUP BY period ORDER BY period LIMIT 36"""


def ts_growth(spark, sf):
    return rounded(tools.time_series_growth(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month", "sum"), 2)


TS_GROWTH = """WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1),
s AS (SELECT count(*) AS n, arg_min(v, period) AS f, arg_max(v, period) AS l, max(v) AS hi, min(v) AS lo FROM p),
g AS (SELECT *, CASE WHEN f = 0 THEN 0 ELSE round((l - f) / greatest(0.0001, abs(f)) * 100, 2) END AS growth FROM s)
SELECT n AS periods_count, f AS first_value, l AS last_value, (SELECT min(period) FROM p WHERE v = hi) AS peak_period,
  hi AS peak_value, (SELECT min(period) FROM p WHERE v = lo) AS trough_period, lo AS trough_value, growth AS growth_pct,
  CASE WHEN growth > 5 THEN 'Upward / Growth' WHEN growth < -5 THEN 'Downward / Decline' ELSE 'Stable / Sideways' END AS trend FROM g"""


def hist_bins(spark, sf):
    return rounded(tools.distribution_bins(table(spark, sf, "orders"), "o_totalprice", 10))


def histogram_sql(tab, c, bins, extra=""):
    return f"""WITH r AS (SELECT min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / {bins} AS w FROM {tab}),
g AS (SELECT {c} AS v, lo, w, CAST(least(floor(({c} - lo) / w), {bins - 1}) AS INTEGER) AS k FROM {tab}, r),
f AS (SELECT v, k + CASE WHEN v < lo + k * w THEN -1 WHEN k < {bins - 1} AND v >= lo + (k + 1) * w THEN 1 ELSE 0 END AS bin FROM g),
c AS (SELECT bin, count(*) AS n FROM f GROUP BY bin),
h AS (SELECT CAST(range AS INTEGER) AS bin, round(lo + range * w, 4) AS bin_start,
  round(CASE WHEN range = {bins - 1} THEN hi ELSE lo + (range + 1) * w END, 4) AS bin_end, coalesce(n, 0) AS count,
  {pct_sql('coalesce(n, 0)', '(SELECT sum(n) FROM c)')} AS percentage FROM range({bins}), r LEFT JOIN c ON c.bin = range)
SELECT *{extra} FROM h"""


HIST = histogram_sql("orders", "o_totalprice", 10, ", bin = (SELECT arg_min(bin, -count * 100 + bin) FROM h) AS is_dominant")


def hist_discrete(spark, sf):
    return rounded(tools.distribution_bins(table(spark, sf, "lineitem"), "l_discount", 8))


HIST_DISCRETE = histogram_sql("lineitem", "l_discount", 8, ", bin = (SELECT arg_min(bin, -count * 100 + bin) FROM h) AS is_dominant")


def dist_shape(spark, sf):
    return rounded(tools.distribution_shape(table(spark, sf, "events"), "value"))


DIST_SHAPE = """SELECT 'value' AS column_name, count(value) AS sample_size, round(avg(value), 4) AS mean,
  round(quantile_cont(value, 0.5), 4) AS median, round(stddev_samp(value), 4) AS std, round(skewness(value), 4) AS skewness,
  round(kurtosis(value), 4) AS kurtosis, CASE WHEN abs(skewness(value)) < 0.5 THEN 'Approximately Symmetric'
  WHEN skewness(value) > 0.5 THEN 'Right-skewed (Positively skewed - tail on high values)'
  ELSE 'Left-skewed (Negatively skewed - tail on low values)' END AS skewness_classification FROM events"""


def cat_dist(spark, sf):
    return tools.distribution_categories(table(spark, sf, "part"), "p_brand")


CAT_DIST = f"""WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, sum(n) OVER () AS t FROM c)
SELECT rank, v AS category, n AS count, {pct_sql('n', 't')} AS percentage FROM r WHERE rank <= 10"""

LEAD_ROLES = {"numerical": ["value", "user_id"], "categorical": ["event_type"], "datetime": ["ts"]}


def leads(spark, sf):
    return rounded(tools.leads(table(spark, sf, "events"), LEAD_ROLES))


LEADS = """WITH r AS (SELECT corr(value, user_id) AS r FROM events),
o AS (SELECT count(*) AS n FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
  WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))
SELECT 1 AS position, 'co_movement' AS topic, 'High' AS priority, 'value' AS subject, 'user_id' AS related,
  round(r, 4) AS measure FROM r WHERE r > 0
UNION ALL SELECT 2, 'outliers', 'High', 'value', NULL, CAST(n AS DOUBLE) FROM o WHERE n > 0
UNION ALL SELECT 3, 'segments', 'Medium', 'event_type', 'value', NULL
UNION ALL SELECT 4, 'season', 'Medium', 'ts', 'value', NULL"""


def group_count_dirty(spark, sf):
    return tools.group_rank(dirty(spark, sf), "note", None, "count", True, 3)


QUERIES = {
    "group_rank_sum": (group_rank_sum, GROUP_RANK_SUM),
    "group_rank_mean": (_rank("orders", "o_orderpriority", "o_totalprice", "average"),
                        _rank_sql("orders", "o_orderpriority", "avg(o_totalprice)", False)),
    "group_rank_median": (_rank("lineitem", "l_suppkey", "l_extendedprice", "median", False, 5),
                          _rank_sql("lineitem", "l_suppkey", "quantile_cont(l_extendedprice, 0.5)", False, False, 5)),
    "group_rank_count": (_rank("lineitem", "l_returnflag", None, "count"),
                         _rank_sql("lineitem", "l_returnflag", "count(*)", True)),
    "group_rank_std": (_rank("lineitem", "l_linestatus", "l_extendedprice", "std"),
                       _rank_sql("lineitem", "l_linestatus", "stddev_samp(l_extendedprice)", False)),
    "group_rank_min": (_rank("lineitem", "l_shipdate", "l_quantity", "minimum", False, 7),
                       _rank_sql("lineitem", "l_shipdate", "min(l_quantity)", False, False, 7)),
    "group_rank_max": (_rank("orders", "o_custkey", "o_totalprice", "max"),
                       _rank_sql("orders", "o_custkey", "max(o_totalprice)", False)),
    "group_extremes": (group_extremes, GROUP_EXTREMES),
    "group_rank_with_gaps": (group_count_dirty, f"WITH {DIRTY}, " + _rank_sql(
        "dirty WHERE note IS NOT NULL", "note", "count(*)", True, True, 3).removeprefix("WITH ")),
    "agg_scalars": (agg_scalars, AGG_SCALARS),
    "dataset_summary": (dataset_summary, DATASET_SUMMARY),
    "dataset_columns": (dataset_columns, DATASET_COLUMNS),
    "column_summary_number": (column_summary_number, COLUMN_NUMBER),
    "column_summary_category": (column_summary_category, COLUMN_CATEGORY),
    "column_summary_date": (column_summary_date, COLUMN_DATE),
    "correlation_top": (correlation_top, CORRELATION_TOP),
    "outlier_overview": (outlier_overview, OUTLIER_OVERVIEW),
    "outlier_samples": (outlier_samples, OUTLIER_SAMPLES),
    "ts_auto_year": (ts_year, TS_YEAR),
    "ts_month_mean": (ts_month, TS_MONTH),
    "ts_day_sum": (ts_day_full, TS_DAY),
    "ts_auto_events": (ts_auto_events, TS_EVENTS),
    "ts_growth": (ts_growth, TS_GROWTH),
    "hist_bins": (hist_bins, HIST),
    "hist_discrete": (hist_discrete, HIST_DISCRETE),
    "dist_shape": (dist_shape, DIST_SHAPE),
    "cat_dist": (cat_dist, CAT_DIST),
    "leads": (leads, LEADS),
}
