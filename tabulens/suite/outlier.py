"""Queries of the outlier family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import outliers
from tabulens.suite.common import DIRTY, dirty, pct_sql, rounded, table

# the error rules as they apply to a column named "amount"
AMOUNT_ERROR = """(round_even(amount, 0) IN (-999, -9999, -99, -1, 999, 9999, 99999, 999999)
  OR isinf(amount) OR amount < 0)"""
IQR = f"""WITH {DIRTY}, q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM dirty),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q),
f AS (SELECT dirty.*, lo, hi, (amount < lo OR amount > hi) AS is_out, {AMOUNT_ERROR} AS is_err FROM dirty, b)"""

SUMMARY_COLUMNS = ["column_name", "method", "total_observations", "valid_observations", "outlier_count",
                   "outlier_percentage", "lower_threshold", "upper_threshold", "confirmed_error_count",
                   "potential_outlier_count", "status"]


def _summary(df, columns, method):
    return rounded(outliers.outlier_summary(df, columns, method).select(*SUMMARY_COLUMNS), 6)


def outliers_iqr(spark, sf):
    return _summary(dirty(spark, sf), ["amount"], "iqr")


OUTLIERS_IQR = IQR + f""", s AS (SELECT count(*) AS n, count(amount) AS k, count(*) FILTER (is_out) AS o,
  count(*) FILTER (is_out AND is_err) AS e, any_value(lo) AS lo, any_value(hi) AS hi FROM f)
SELECT 'amount' AS column_name, 'iqr' AS method, n AS total_observations, k AS valid_observations, o AS outlier_count,
  {pct_sql('o', 'k')} AS outlier_percentage, round(lo, 6) AS lower_threshold, round(hi, 6) AS upper_threshold,
  e AS confirmed_error_count, o - e AS potential_outlier_count, CASE WHEN o = 0 THEN 'Clean'
  WHEN e > 0 THEN 'Data Errors Detected' WHEN {pct_sql('o', 'k')} > 5 THEN 'High Outliers' ELSE 'Moderate Outliers' END AS status
FROM s"""


def outliers_z(spark, sf):
    return _summary(table(spark, sf, "customer"), ["c_acctbal"], "zscore").unionByName(
        _summary(table(spark, sf, "events"), ["value"], "zscore"))


def _sentinels(c):
    return f"round_even({c}, 0) IN (-999, -9999, -99, -1, 999, 9999, 99999, 999999)"


def _z_sql(tab, c):
    return f"""SELECT '{c}' AS column_name, 'zscore' AS method, n AS total_observations, n AS valid_observations,
  o AS outlier_count, {pct_sql('o', 'n')} AS outlier_percentage, round(m - 3 * sd, 6) AS lower_threshold,
  round(m + 3 * sd, 6) AS upper_threshold, e AS confirmed_error_count, o - e AS potential_outlier_count,
  CASE WHEN o = 0 THEN 'Clean' WHEN e > 0 THEN 'Data Errors Detected' WHEN {pct_sql('o', 'n')} > 5 THEN 'High Outliers'
    ELSE 'Moderate Outliers' END AS status
FROM (SELECT any_value(n) AS n, any_value(m) AS m, any_value(sd) AS sd, count(*) FILTER (abs((x - m) / sd) > 3) AS o,
  count(*) FILTER (abs((x - m) / sd) > 3 AND {_sentinels('x')}) AS e
  FROM (SELECT {c} AS x FROM {tab}), (SELECT count({c}) AS n, avg({c}) AS m, stddev_samp({c}) AS sd FROM {tab}))"""


OUTLIERS_Z = _z_sql("customer", "c_acctbal") + " UNION ALL " + _z_sql("events", "value")


def outliers_mad(spark, sf):
    return _summary(table(spark, sf, "events"), ["value"], "modified_zscore")


MAD_CTE = """WITH m AS (SELECT count(value) AS n, quantile_cont(value, 0.5) AS med FROM events),
d AS (SELECT any_value(n) AS n, any_value(med) AS med, quantile_cont(abs(value - med), 0.5) AS mad FROM events, m),
f AS (SELECT event_id, value, n, med, mad, med - 3.5 * mad / 0.6745 AS lo, med + 3.5 * mad / 0.6745 AS hi,
  0.6745 * abs(value - med) / mad AS z FROM events, d)"""
OUTLIERS_MAD = MAD_CTE + f""", s AS (SELECT any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi,
  count(*) FILTER (z > 3.5) AS o, count(*) FILTER (z > 3.5 AND {_sentinels('value')}) AS e FROM f)
SELECT 'value' AS column_name, 'modified_zscore' AS method, n AS total_observations, n AS valid_observations,
  o AS outlier_count, {pct_sql('o', 'n')} AS outlier_percentage, round(lo, 6) AS lower_threshold,
  round(hi, 6) AS upper_threshold, e AS confirmed_error_count, o - e AS potential_outlier_count,
  CASE WHEN o = 0 THEN 'Clean' WHEN e > 0 THEN 'Data Errors Detected' ELSE 'Moderate Outliers' END AS status FROM s"""


def records_iqr(spark, sf):
    return rounded(outliers.outlier_records(dirty(spark, sf), ["amount"], "iqr", id_cols=["order_key"]).drop("score"), 6)


RECORDS_IQR = IQR + """ SELECT order_key, 'amount' AS column_name, round(amount, 6) AS value, round(lo, 6) AS lower_threshold,
  round(hi, 6) AS upper_threshold, CASE WHEN amount < lo THEN 'below_lower' ELSE 'above_upper' END AS direction,
  round(abs(amount - CASE WHEN amount < lo THEN lo ELSE hi END), 6) AS deviation, is_err AS is_data_error,
  CASE WHEN is_err THEN 'Confirmed Data Error' ELSE 'Potential Outlier' END AS classification FROM f WHERE is_out"""


def records_mad(spark, sf):
    return rounded(outliers.outlier_records(table(spark, sf, "events"), ["value"], "modified_zscore",
                                            id_cols=["event_id"]).select("event_id", "value", "score", "direction"), 6)


RECORDS_MAD = MAD_CTE + """ SELECT event_id, round(value, 6) AS value, round(z, 6) AS score,
  CASE WHEN value < lo THEN 'below_lower' ELSE 'above_upper' END AS direction FROM f WHERE z > 3.5"""


def error_labels(spark, sf):
    return outliers.outlier_records(dirty(spark, sf), ["amount", "price"], "iqr").groupBy(
        "column_name", "classification").agg(F.count(F.lit(1)).alias("values"))


ERROR_LABELS = IQR + """, p AS (SELECT price, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM dirty,
  (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM dirty)),
u AS (SELECT 'amount' AS column_name, is_err FROM f WHERE is_out UNION ALL
  SELECT 'price', round_even(price, 0) IN (-999, -9999, -99, -1, 999, 9999, 99999, 999999) OR price < 0 FROM p WHERE price < lo OR price > hi)
SELECT column_name, CASE WHEN is_err THEN 'Confirmed Data Error' ELSE 'Potential Outlier' END AS classification,
  count(*) AS values FROM u GROUP BY ALL"""


def affected_rows(spark, sf):
    return outliers.outlier_totals(dirty(spark, sf), ["amount", "price", "order_key"], "iqr")


AFFECTED = IQR + f""", q2 AS (SELECT quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3,
  quantile_cont(order_key, 0.25) AS k1, quantile_cont(order_key, 0.75) AS k3 FROM dirty),
g AS (SELECT is_out AS a, is_err AS ae, coalesce(price < p1 - 1.5 * (p3 - p1) OR price > p3 + 1.5 * (p3 - p1), false) AS p,
  coalesce(round_even(price, 0) IN (-999, -9999, -99, -1, 999, 9999, 99999, 999999) OR price < 0, false) AS pe,
  order_key < k1 - 1.5 * (k3 - k1) OR order_key > k3 + 1.5 * (k3 - k1) AS k FROM f, q2),
s AS (SELECT count(*) AS n, count(*) FILTER (a OR p OR k) AS touched,
  count(*) FILTER (a) + count(*) FILTER (p) + count(*) FILTER (k) AS o,
  count(*) FILTER (a AND ae) + count(*) FILTER (p AND pe) AS e,
  CAST(CAST(bool_or(a) AS INTEGER) + CAST(bool_or(p) AS INTEGER) + CAST(bool_or(k) AS INTEGER) AS BIGINT) AS cols FROM g)
SELECT n AS total_rows, touched AS affected_rows_count, o AS total_outlier_instances, e AS total_confirmed_errors,
  cols AS columns_with_outliers, o - e AS total_potential_outliers, {pct_sql('touched', 'n')} AS affected_rows_percentage FROM s"""


def _remediated(action):
    return lambda spark, sf: rounded(outliers.remediate(dirty(spark, sf), action, ["amount"]).select(
        "order_key", "amount"), 2)


REMOVE = IQR + " SELECT order_key, round(amount, 2) AS amount FROM f WHERE NOT is_out"
ERRORS_ONLY = IQR + " SELECT order_key, round(amount, 2) AS amount FROM f WHERE NOT (is_out AND is_err)"
CAP = IQR + " SELECT order_key, round(greatest(least(amount, round(hi, 4)), round(lo, 4)), 2) AS amount FROM f"


def remediation_counts(spark, sf):
    frames = [outliers.remediation_summary(dirty(spark, sf), a, ["amount"]) for a in ("remove", "remove_errors_only", "cap")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


REMEDIATION = IQR + """, s AS (SELECT count(*) AS n, count(*) FILTER (is_out) AS o, count(*) FILTER (is_out AND is_err) AS e FROM f)
SELECT 'remove' AS action, n AS rows_before, o AS rows_dropped, CAST(0 AS BIGINT) AS values_capped, n - o AS rows_after FROM s
UNION ALL SELECT 'remove_errors_only', n, e, 0, n - e FROM s UNION ALL SELECT 'cap', n, CAST(0 AS BIGINT), o, n FROM s"""


def critical_columns(spark, sf):
    return rounded(outliers.critical_columns(dirty(spark, sf), ["amount", "price"], 0.5), 6)


CRITICAL = IQR + f""", s AS (SELECT count(amount) AS k, count(*) FILTER (is_out) AS o, any_value(lo) AS lo, any_value(hi) AS hi FROM f),
p AS (SELECT price, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM dirty,
  (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM dirty)),
ps AS (SELECT count(price) AS k, count(*) FILTER (price < lo OR price > hi) AS o, any_value(lo) AS lo, any_value(hi) AS hi FROM p),
u AS (SELECT 'amount' AS column_name, * FROM s UNION ALL SELECT 'price', * FROM ps)
SELECT column_name, o AS outlier_count, {pct_sql('o', 'k')} AS outlier_percentage, round(lo, 6) AS lower_threshold,
  round(hi, 6) AS upper_threshold FROM u WHERE {pct_sql('o', 'k')} >= 0.5"""

QUERIES = {
    "outliers_iqr": (outliers_iqr, OUTLIERS_IQR),
    "outliers_zscore": (outliers_z, OUTLIERS_Z),
    "outliers_mad": (outliers_mad, OUTLIERS_MAD),
    "outlier_records_iqr": (records_iqr, RECORDS_IQR),
    "outlier_records_mad": (records_mad, RECORDS_MAD),
    "error_labels": (error_labels, ERROR_LABELS),
    "affected_rows": (affected_rows, AFFECTED),
    "remediate_remove": (_remediated("remove"), REMOVE),
    "remediate_errors_only": (_remediated("remove_errors_only"), ERRORS_ONLY),
    "remediate_cap": (_remediated("cap"), CAP),
    "remediation_counts": (remediation_counts, REMEDIATION),
    "critical_columns": (critical_columns, CRITICAL),
}
