"""Queries of the statistics and correlation families."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tabulens.operators import correlation, stats
from tabulens.suite.common import DIRTY, LINE_NUMBERS, dirty, long_sql, pct_sql, rounded, table, ts_text

LONG = f"WITH long AS ({long_sql('lineitem', LINE_NUMBERS)})"


def line(spark, sf):
    return table(spark, sf, "lineitem")


def num_summary(spark, sf):
    s = stats.moment_summary(line(spark, sf), LINE_NUMBERS).select(
        "column_name", "valid_count", "missing_count", "mean", "min", "max", "range", "std", "variance", "sem",
        "cv_percentage", "zeros_count", "zeros_percentage")
    return rounded(s, 4, variance=2, sem=6)


NUM_SUMMARY = f"""{LONG}
SELECT column_name, count(*) AS valid_count, CAST(0 AS BIGINT) AS missing_count, round(avg(v), 4) AS mean,
  round(min(v), 4) AS min, round(max(v), 4) AS max, round(max(v) - min(v), 4) AS range,
  round(stddev_samp(v), 4) AS std, round(var_samp(v), 2) AS variance,
  round(stddev_samp(v) / sqrt(count(*)), 6) AS sem,
  round(round(stddev_samp(v) / abs(avg(v)) * 100, 2), 4) AS cv_percentage,
  count(*) FILTER (v = 0) AS zeros_count, {pct_sql('count(*) FILTER (v = 0)', 'count(*)')} AS zeros_percentage
FROM long GROUP BY column_name"""


def percentiles(spark, sf):
    return rounded(stats.percentiles(line(spark, sf), LINE_NUMBERS))


PERCENTILES = LONG + " SELECT column_name, count(*) AS n_values, " + ", ".join(
    f"round(quantile_cont(v, {p / 100}), 4) AS p{p}" for p in stats.PERCENTILES) + " FROM long GROUP BY column_name"


def percentiles_approx(spark, sf):
    return stats.approximate_percentiles(line(spark, sf), LINE_NUMBERS)


def modes(spark, sf):
    return stats.numeric_modes(line(spark, sf), LINE_NUMBERS).drop("mode_text")


MODES = f"""{LONG}, c AS (SELECT column_name, v, count(*) AS n FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS k,
        count(*) OVER (PARTITION BY column_name) AS distinct_count FROM c)
SELECT column_name, distinct_count, CASE WHEN n > 1 THEN v END AS mode_value FROM r WHERE k = 1"""


def g1_g2(spark, sf):
    return rounded(stats.moment_summary(line(spark, sf), LINE_NUMBERS).select("column_name", "skewness", "kurtosis"), 6)


def ci95(spark, sf):
    return rounded(stats.moment_summary(line(spark, sf), LINE_NUMBERS).select(
        "column_name", "margin_of_error", "ci_lower", "ci_upper"))


Z = 1.959963984540054
T_SERIES = (f"({Z} + {(Z**3 + Z) / 4} / v + {(5 * Z**5 + 16 * Z**3 + 3 * Z) / 96} / (v * v)"
            f" + {(3 * Z**7 + 19 * Z**5 + 17 * Z**3 - 15 * Z) / 384} / (v * v * v)"
            f" + {(79 * Z**9 + 776 * Z**7 + 1482 * Z**5 - 1920 * Z**3 - 945 * Z) / 92160} / (v * v * v * v))")
CI95 = f"""{LONG}, m AS (SELECT column_name, avg(v) AS mean, stddev_samp(v) / sqrt(count(*)) AS sem,
  CAST(count(*) - 1 AS DOUBLE) AS v FROM long GROUP BY column_name),
t AS (SELECT *, {T_SERIES} * sem AS margin FROM m)
SELECT column_name, round(margin, 4) AS margin_of_error, round(mean - margin, 4) AS ci_lower,
  round(mean + margin, 4) AS ci_upper FROM t"""


def normality_k2(spark, sf):
    s = stats.moment_summary(line(spark, sf), LINE_NUMBERS)
    return s.select("column_name", F.round("k2", 2).alias("k2"), F.round("normal_p", 6).alias("normal_p"), "is_normal")


K2_CTE = f"""{LONG}, b AS (SELECT column_name, CAST(count(*) AS DOUBLE) AS n, avg(v) AS mu FROM long GROUP BY column_name),
m AS (SELECT l.column_name, any_value(n) AS n, avg(pow(v - mu, 2)) AS m2, avg(pow(v - mu, 3)) AS m3,
  avg(pow(v - mu, 4)) AS m4 FROM long l JOIN b USING (column_name) GROUP BY l.column_name),
g AS (SELECT column_name, n, m3 / pow(m2, 1.5) AS g1, m4 / (m2 * m2) AS b2 FROM m),
s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,
  sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / (pow(n + 1, 2) * (n + 3) * (n + 5))) AS x,
  6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM g),
z AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs,
  6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS a FROM s),
k AS (SELECT *, 1 + x * sqrt(2 / (a - 4)) AS q FROM z),
omni AS (SELECT *, zs * zs + pow((1 - 2 / (9 * a) - sign(q) * cbrt((1 - 2 / a) / abs(q))) / sqrt(2 / (9 * a)), 2) AS k2
  FROM k)"""
NORMALITY = K2_CTE + """ SELECT column_name, round(k2, 2) AS k2, round(exp(-k2 / 2), 6) AS normal_p,
  exp(-k2 / 2) > 0.05 AS is_normal FROM omni"""


def shape_label(spark, sf):
    return stats.moment_summary(line(spark, sf), LINE_NUMBERS).select("column_name", "shape")


SHAPE = K2_CTE + """, f AS (SELECT column_name, skewness(v) AS sk, kurtosis(v) AS ku FROM long GROUP BY column_name)
SELECT column_name, CASE WHEN sk > 1.5 THEN 'Highly Skewed Right (Positive Tail)'
  WHEN sk < -1.5 THEN 'Highly Skewed Left (Negative Tail)' WHEN sk > 0.5 THEN 'Moderately Skewed Right'
  WHEN sk < -0.5 THEN 'Moderately Skewed Left' WHEN ku > 2 THEN 'Leptokurtic (Heavy Tails & Sharp Peak)'
  WHEN ku < -1 THEN 'Platykurtic (Light Tails & Flat Peak)'
  WHEN exp(-k2 / 2) > 0.05 THEN 'Approximately Normal (Gaussian)' ELSE 'Symmetric / Non-Gaussian' END AS shape
FROM omni JOIN f USING (column_name)"""


def fence_outliers(spark, sf):
    return rounded(stats.fence_outliers(table(spark, sf, "events"), ["value"]), 6)


FENCES = f"""WITH q AS (SELECT count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
c AS (SELECT count(*) AS o FROM events, b WHERE value < lo OR value > hi)
SELECT 'value' AS column_name, n AS valid_count, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, o AS outlier_count, {pct_sql('o', 'n')} AS outlier_percentage
FROM b, c"""


def numeric_table(spark, sf):
    s = stats.numeric_summary(line(spark, sf), LINE_NUMBERS).select(
        "column_name", "valid_count", "mean", "median", "mode", "std", "min", "max", "range", "q1", "q3", "iqr",
        "skewness", "kurtosis", "ci_lower", "ci_upper", "outlier_count")
    return rounded(s)


NUMERIC_TABLE = f"""{LONG}, c AS (SELECT column_name, v, count(*) AS n FROM long GROUP BY ALL),
mo AS (SELECT column_name, v AS mode FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS k
  FROM c) WHERE k = 1),
q AS (SELECT column_name, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3, skewness(v) AS sk,
  kurtosis(v) AS ku, CAST(count(*) - 1 AS DOUBLE) AS v FROM long GROUP BY column_name),
o AS (SELECT l.column_name, count(*) FILTER (l.v < q1 - 1.5 * (q3 - q1) OR l.v > q3 + 1.5 * (q3 - q1)) AS out
  FROM long l JOIN q USING (column_name) GROUP BY l.column_name),
t AS (SELECT *, {T_SERIES} * sd / sqrt(n) AS margin FROM q)
SELECT column_name, n AS valid_count, round(mean, 4) AS mean, round(q2, 4) AS median, round(mode, 4) AS mode,
  round(sd, 4) AS std, round(lo, 4) AS min, round(hi, 4) AS max, round(hi - lo, 4) AS range, round(q1, 4) AS q1,
  round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr, round(sk, 4) AS skewness, round(ku, 4) AS kurtosis,
  round(mean - margin, 4) AS ci_lower, round(mean + margin, 4) AS ci_upper, out AS outlier_count
FROM t JOIN mo USING (column_name) JOIN o USING (column_name)"""

CATS = ["o_orderstatus", "o_orderpriority"]


def cat_summary(spark, sf):
    return rounded(stats.category_summary(table(spark, sf, "orders"), CATS), 6)


CAT_LONG = f"WITH long AS ({long_sql('orders', CATS)}), c AS (SELECT column_name, v, count(*) AS n FROM long GROUP BY ALL)"
CAT_SUMMARY = f"""{CAT_LONG}, t AS (SELECT column_name, sum(n) AS total FROM c GROUP BY column_name),
r AS (SELECT c.*, total, n / total AS p, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS k
  FROM c JOIN t USING (column_name))
SELECT column_name, CAST(sum(n) AS BIGINT) AS total_count, CAST(sum(n) AS BIGINT) AS valid_count,
  CAST(0 AS BIGINT) AS missing_count, count(*) AS num_categories, max(v) FILTER (k = 1) AS most_frequent_category,
  max(n) AS mode_frequency, {pct_sql('max(n)', 'max(total)')} AS mode_percentage,
  round(-sum(p * log2(p + 1e-12)), 6) AS entropy, count(*) FILTER (p < 0.01) AS rare_categories_count
FROM r GROUP BY column_name"""


def cat_entropy(spark, sf):
    return rounded(stats.category_summary(table(spark, sf, "documents"), ["lang", "source"])
                   .select("column_name", "num_categories", "entropy"), 6)


CAT_ENTROPY = f"""WITH long AS ({long_sql('documents', ['lang', 'source'])}),
c AS (SELECT column_name, v, count(*) AS n FROM long GROUP BY ALL),
p AS (SELECT column_name, n / sum(n) OVER (PARTITION BY column_name) AS p FROM c)
SELECT column_name, count(*) AS num_categories, round(-sum(p * log2(p + 1e-12)), 6) AS entropy FROM p GROUP BY column_name"""


def rare_categories(spark, sf):
    return stats.category_summary(table(spark, sf, "part"), ["p_brand", "p_type", "p_size"]).select(
        "column_name", "num_categories", "rare_categories_count")


RARE = f"""WITH long AS ({long_sql('part', ['p_brand', 'p_type', 'p_size'], cast='VARCHAR')}),
c AS (SELECT column_name, v, count(*) AS n FROM long GROUP BY ALL),
p AS (SELECT column_name, n / sum(n) OVER (PARTITION BY column_name) AS p FROM c)
SELECT column_name, count(*) AS num_categories, count(*) FILTER (p < 0.01) AS rare_categories_count
FROM p GROUP BY column_name"""


def cat_top_cumulative(spark, sf):
    return stats.top_categories(table(spark, sf, "part"), ["p_brand", "p_type"])


CAT_TOP = f"""WITH long AS ({long_sql('part', ['p_brand', 'p_type'])}),
c AS (SELECT column_name, v, count(*) AS n FROM long GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY column_name) AS total,
  row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS rank FROM c),
p AS (SELECT *, {pct_sql('n', 'total')} AS percentage FROM r WHERE rank <= 10)
SELECT column_name, CAST(rank AS INTEGER) AS rank, v AS category, n AS count, percentage,
  least(100.0, round(sum(percentage) OVER (PARTITION BY column_name ORDER BY rank), 2)) AS cumulative_percentage FROM p"""


def dt_span(spark, sf):
    a = stats.datetime_spans(table(spark, sf, "orders"), ["o_orderdate"])
    b = stats.datetime_spans(table(spark, sf, "events"), ["ts"])
    return a.unionByName(b).select("column_name", "valid_count", ts_text("min_date").alias("min_date"),
                                   ts_text("max_date").alias("max_date"), "date_range_days", "date_range_formatted")


DT_SPAN = """WITH long AS (SELECT 'o_orderdate' AS column_name, o_orderdate AS v FROM orders
  UNION ALL SELECT 'ts', ts FROM events),
s AS (SELECT column_name, count(*) AS n, min(v) AS lo, max(v) AS hi,
  CAST(floor((epoch_us(max(v)) - epoch_us(min(v))) / 86400000000) AS BIGINT) AS days FROM long GROUP BY column_name)
SELECT column_name, n AS valid_count, strftime(lo, '%Y-%m-%d %H:%M:%S') AS min_date,
  strftime(hi, '%Y-%m-%d %H:%M:%S') AS max_date, days AS date_range_days,
  format('{:,}', days) || ' days' || CASE WHEN days >= 365 THEN ' (~' || CAST(round(days / 365.25, 1) AS VARCHAR) || ' years)'
    WHEN days >= 30 THEN ' (~' || CAST(round(days / 30.4, 1) AS VARCHAR) || ' months)' ELSE '' END AS date_range_formatted
FROM s"""


def dt_cadence(spark, sf):
    a = stats.datetime_cadence(table(spark, sf, "orders"), ["o_orderdate"])
    b = stats.datetime_cadence(table(spark, sf, "events"), ["ts"])
    return rounded(a.unionByName(b), 3)


DT_CADENCE = """WITH long AS (SELECT 'o_orderdate' AS column_name, o_orderdate AS v FROM orders
  UNION ALL SELECT 'ts', ts FROM events),
g AS (SELECT column_name, epoch_us(v) - lag(epoch_us(v)) OVER (PARTITION BY column_name ORDER BY v) AS gap FROM long),
m AS (SELECT column_name, quantile_cont(gap, 0.5) / 1e6 AS s FROM g GROUP BY column_name)
SELECT column_name, round(s, 3) AS median_gap_seconds, CASE WHEN s BETWEEN 3500 AND 3700 THEN 'Hourly'
  WHEN s BETWEEN 82800 AND 90000 THEN 'Daily' WHEN s BETWEEN 580000 AND 630000 THEN 'Weekly'
  WHEN s BETWEEN 2400000 AND 2700000 THEN 'Monthly' WHEN s >= 30000000 THEN 'Annual'
  ELSE 'Irregular / Mixed' END AS cadence FROM m"""


def dt_by(part, name, column):
    return lambda spark, sf: stats.records_by(table(spark, sf, name), column, part)


DT_BY_YEAR = """SELECT CAST(year(o_orderdate) AS INTEGER) AS position, CAST(year(o_orderdate) AS VARCHAR) AS year,
  count(*) AS records FROM orders GROUP BY ALL"""
DT_BY_MONTH = """SELECT CAST(month(o_orderdate) AS INTEGER) AS position, strftime(o_orderdate, '%b') AS month,
  count(*) AS records FROM orders GROUP BY ALL"""
DT_BY_WEEKDAY = """SELECT CAST(isodow(ts) - 1 AS INTEGER) AS position, strftime(ts, '%A') AS weekday, count(*) AS records
FROM events GROUP BY ALL"""


def observations(spark, sf):
    found = stats.observations(line(spark, sf), LINE_NUMBERS, ["l_returnflag", "l_linestatus"], ["l_shipdate"])
    return rounded(found.unionByName(stats.observations(table(spark, sf, "labels"), ["quality", "toxic"], ["doc_id"], [])), 4)


def _remarks_sql(source: str, numbers: list[str], groups: list[str], times: str = "") -> str:
    """The remarks on one table, rule by rule."""
    return f"""(WITH long AS ({long_sql(source, numbers)}),
q AS (SELECT column_name, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, skewness(v) AS sk, kurtosis(v) AS ku, min(v) = max(v) AS flat,
  quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS mid, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY column_name),
o AS (SELECT q.*, s.out, {pct_sql('s.out', 'n')} AS pct, round(sd / abs(mean) * 100, 2) AS cv FROM q JOIN (SELECT l.column_name,
  count(*) FILTER (l.v < q1 - 1.5 * (q3 - q1) OR l.v > q3 + 1.5 * (q3 - q1)) AS out FROM long l JOIN q USING (column_name)
  GROUP BY l.column_name) s USING (column_name)),
c AS (SELECT column_name, v, count(*) AS n FROM ({long_sql(source, groups, cast='VARCHAR')}) GROUP BY ALL),
cs AS (SELECT column_name, CAST(count(*) AS DOUBLE) AS k, {pct_sql('max(n)', 'sum(n)')} AS top, min(v) FILTER (r = 1) AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS r FROM c) GROUP BY column_name)
SELECT column_name, 'constant' AS rule, 'medium' AS severity, mean AS value, CAST(NULL AS DOUBLE) AS other, CAST(NULL AS VARCHAR) AS item
  FROM o WHERE flat
UNION ALL SELECT column_name, 'skewed', 'info', sk, mid, NULL FROM o WHERE NOT flat AND abs(sk) >= 1.5
UNION ALL SELECT column_name, 'heavy_tails', 'info', ku, NULL, NULL FROM o WHERE NOT flat AND ku > 3
UNION ALL SELECT column_name, 'outliers', CASE WHEN pct > 5 THEN 'warning' ELSE 'info' END, out, pct, NULL FROM o WHERE NOT flat AND out > 0 AND pct >= 2
UNION ALL SELECT column_name, 'dispersed', 'info', cv, NULL, NULL FROM o WHERE NOT flat AND cv > 100
UNION ALL SELECT column_name, 'imbalanced', 'warning', top, k, v FROM cs WHERE top >= 70 AND k > 1
UNION ALL SELECT column_name, 'many_categories', 'info', k, NULL, NULL FROM cs WHERE k > 50 {times})"""


_SHIPPED = """UNION ALL SELECT 'l_shipdate', 'time_span', 'info', days, gap, CASE WHEN gap BETWEEN 3500 AND 3700 THEN 'Hourly'
  WHEN gap BETWEEN 82800 AND 90000 THEN 'Daily' WHEN gap BETWEEN 580000 AND 630000 THEN 'Weekly'
  WHEN gap BETWEEN 2400000 AND 2700000 THEN 'Monthly' WHEN gap >= 30000000 THEN 'Annual' ELSE 'Irregular / Mixed' END
  FROM (SELECT date_diff('day', min(t), max(t)) AS days, quantile_cont(epoch_us(t) - epoch_us(p), 0.5) / 1e6 AS gap
        FROM (SELECT l_shipdate AS t, lag(l_shipdate) OVER (ORDER BY l_shipdate) AS p FROM lineitem))"""
OBSERVATIONS = f"""SELECT column_name, rule, severity, round(CAST(value AS DOUBLE), 4) AS value, round(CAST(other AS DOUBLE), 4) AS other, item
FROM {_remarks_sql('lineitem', LINE_NUMBERS, ['l_returnflag', 'l_linestatus'], _SHIPPED)}
UNION ALL SELECT column_name, rule, severity, round(CAST(value AS DOUBLE), 4), round(CAST(other AS DOUBLE), 4), item
FROM {_remarks_sql('labels', ['quality', 'toxic'], ['doc_id'])}"""


PAIRS = list(combinations(LINE_NUMBERS, 2))
CORR_CTE = "WITH p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem" for a, b in PAIRS) \
    + """), l AS (SELECT *, CASE WHEN abs(r) >= 0.8 THEN 'Very strong' WHEN abs(r) >= 0.6 THEN 'Strong'
  WHEN abs(r) >= 0.4 THEN 'Moderate' WHEN abs(r) >= 0.2 THEN 'Weak' ELSE 'Very weak' END AS strength,
  CASE WHEN r > 1e-4 THEN 'Positive' WHEN r < -1e-4 THEN 'Negative' ELSE 'Neutral' END AS direction FROM p)"""


def corr_pairs(spark, sf):
    return rounded(correlation.correlation_pairs(line(spark, sf), LINE_NUMBERS), 6)


CORR_PAIRS = CORR_CTE + """ SELECT variable_a, variable_b, round(r, 6) AS correlation, round(abs(r), 6) AS absolute_correlation,
  strength, direction, n AS sample_size FROM l"""


def corr_pairs_dirty(spark, sf):
    """Pairwise-complete: price has missing cells, the key has none."""
    df = dirty(spark, sf).select("order_key", "price", F.when(F.col("order_key") % 4 != 0, F.length("price_txt"))
                                 .alias("digits"))
    return rounded(correlation.correlation_pairs(df, ["order_key", "price", "digits"]).select(
        "variable_a", "variable_b", "correlation", "sample_size"), 6)


def corr_matrix_long(spark, sf):
    return rounded(correlation.matrix_cells(line(spark, sf), LINE_NUMBERS), 6)


CORR_MATRIX = CORR_CTE + """ SELECT variable_a, variable_b, round(r, 6) AS correlation, n AS sample_size FROM l
UNION ALL SELECT variable_b, variable_a, round(r, 6), n FROM l UNION ALL """ + " UNION ALL ".join(
    f"SELECT '{c}', '{c}', 1.0, count({c}) FROM lineitem" for c in LINE_NUMBERS)


def corr_matrix(spark, sf):
    return rounded(correlation.matrix_frame(line(spark, sf), LINE_NUMBERS), 6)


CORR_WIDE = " UNION ALL ".join("SELECT '{0}' AS variable_a, {1} FROM lineitem".format(a, ", ".join(
    f"1.0 AS {b}" if a == b else f"round(corr({a}, {b}), 6) AS {b}" for b in LINE_NUMBERS) + ", count(*) AS n")
    for a in LINE_NUMBERS)
CORR_WIDE = f"SELECT variable_a, {', '.join(LINE_NUMBERS)} FROM ({CORR_WIDE})"


def corr_strength_counts(spark, sf):
    return correlation.strength_counts(line(spark, sf), LINE_NUMBERS)


CORR_STRENGTH = CORR_CTE + " SELECT strength, count(*) AS pairs FROM l GROUP BY strength"


def key_pairs(spark, sf):
    return rounded(correlation.key_pairs(line(spark, sf), LINE_NUMBERS, 2), 6)


KEY_PAIRS = CORR_CTE + """, s AS (SELECT *, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign FROM l WHERE r <> 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY sign ORDER BY abs(r) DESC, variable_a, variable_b) AS INTEGER) AS rank FROM s)
SELECT sign, rank, variable_a, variable_b, round(r, 6) AS correlation, strength, n AS sample_size FROM k WHERE rank <= 2"""


def collinear(spark, sf):
    joined = line(spark, sf).withColumn("gross", F.col("l_extendedprice") * (1 + F.col("l_tax")))
    return rounded(correlation.collinear_pairs(joined, ["l_extendedprice", "gross", "l_quantity"]), 6)


COLLINEAR = """WITH d AS (SELECT l_extendedprice, l_extendedprice * (1 + l_tax) AS gross, l_quantity FROM lineitem),
p AS (SELECT 'l_extendedprice' AS variable_a, 'gross' AS variable_b, corr(l_extendedprice, gross) AS r, count(*) AS n FROM d
UNION ALL SELECT 'l_extendedprice', 'l_quantity', corr(l_extendedprice, l_quantity), count(*) FROM d
UNION ALL SELECT 'gross', 'l_quantity', corr(gross, l_quantity), count(*) FROM d)
SELECT variable_a, variable_b, round(r, 6) AS correlation, n AS sample_size FROM p WHERE abs(r) >= 0.85"""


def pair_correlation(spark, sf):
    return rounded(correlation.pair_correlation(line(spark, sf), "l_quantity", "l_extendedprice"), 6)


PAIR = """WITH p AS (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n FROM lineitem)
SELECT 'l_quantity' AS variable_a, 'l_extendedprice' AS variable_b, round(r, 6) AS correlation,
  CASE WHEN abs(r) >= 0.8 THEN 'Very Strong' WHEN abs(r) >= 0.6 THEN 'Strong' WHEN abs(r) >= 0.4 THEN 'Moderate'
    WHEN abs(r) >= 0.2 THEN 'Weak' ELSE 'Negligible / Very Weak' END AS strength,
  CASE WHEN r >= 0 THEN 'Positive' ELSE 'Negative' END AS direction, n AS sample_size FROM p WHERE n >= 3"""


DIRTY_PAIRS_SQL = f"""WITH {DIRTY}, d AS (SELECT CAST(order_key AS DOUBLE) AS order_key, price,
  CASE WHEN order_key % 4 <> 0 THEN CAST(length(price_txt) AS DOUBLE) END AS digits FROM dirty),
p AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS variable_a, '{b}' AS variable_b, corr({a}, {b}) AS r, regr_count({a}, {b}) AS n FROM d"
    for a, b in combinations(["order_key", "price", "digits"], 2)) + """)
SELECT variable_a, variable_b, round(r, 6) AS correlation, CAST(n AS BIGINT) AS sample_size FROM p"""

QUERIES = {
    "num_summary": (num_summary, NUM_SUMMARY),
    "percentiles": (percentiles, PERCENTILES),
    "percentiles_approx": (percentiles_approx, None),
    "numeric_modes": (modes, MODES),
    "g1_g2": (g1_g2, LONG + " SELECT column_name, round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis"
                            " FROM long GROUP BY column_name"),
    "ci95": (ci95, CI95),
    "normality_k2": (normality_k2, NORMALITY),
    "shape_label": (shape_label, SHAPE),
    "fence_outliers": (fence_outliers, FENCES),
    "numeric_table": (numeric_table, NUMERIC_TABLE),
    "cat_summary": (cat_summary, CAT_SUMMARY),
    "cat_entropy": (cat_entropy, CAT_ENTROPY),
    "rare_categories": (rare_categories, RARE),
    "cat_top_cumulative": (cat_top_cumulative, CAT_TOP),
    "dt_span": (dt_span, DT_SPAN),
    "dt_cadence": (dt_cadence, DT_CADENCE),
    "dt_by_year": (dt_by("year", "orders", "o_orderdate"), DT_BY_YEAR),
    "dt_by_month": (dt_by("month", "orders", "o_orderdate"), DT_BY_MONTH),
    "dt_by_weekday": (dt_by("weekday", "events", "ts"), DT_BY_WEEKDAY),
    "observations": (observations, OBSERVATIONS),
    "corr_pairs": (corr_pairs, CORR_PAIRS),
    "corr_pairs_with_gaps": (corr_pairs_dirty, DIRTY_PAIRS_SQL),
    "corr_matrix_long": (corr_matrix_long, CORR_MATRIX),
    "corr_matrix": (corr_matrix, CORR_WIDE),
    "corr_strength_counts": (corr_strength_counts, CORR_STRENGTH),
    "key_pairs": (key_pairs, KEY_PAIRS),
    "collinear": (collinear, COLLINEAR),
    "pair_correlation": (pair_correlation, PAIR),
}
