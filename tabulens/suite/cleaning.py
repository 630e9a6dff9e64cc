"""Queries of the quality audit and the cleaning steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulens.operators import cleaning, quality
from tabulens.suite.common import (DIRTY, DIRTY_COLUMNS, DIRTY_TEXT, STRIP, TITLE, dirty, long_sql, pct_sql, rounded,
                                   ts_text)

WORDS = "('', 'na', 'n/a', 'null', 'none', 'nan', 'nil', '?', '-', '--', 'undefined', '#n/a', '#na')"
ISSUE = ["column_name", "issue_type", "affected_rows", "percentage_affected", "severity"]
LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v, {str(c in DIRTY_TEXT).lower()} AS is_text FROM dirty"
    for c in DIRTY_COLUMNS)
COUNTS = f"""WITH {DIRTY}, long AS ({LONG}), n AS (SELECT count(*) AS total FROM dirty),
c AS (SELECT column_name, any_value(is_text) AS is_text, v, count(*) AS n FROM long WHERE v IS NOT NULL GROUP BY column_name, v),
k AS (SELECT column_name, any_value(is_text) AS is_text, CAST(sum(n) AS BIGINT) AS valid, count(*) AS d, max(n) AS top FROM c GROUP BY column_name)"""
FIELDS = "column_name, issue_type, affected_rows, percentage_affected, severity"


def _issues(make):
    return lambda spark, sf: make(dirty(spark, sf)).select(*ISSUE)


def _rules(*rules):
    return _issues(lambda df: quality.column_issues(df, list(rules)))


MISSING = f""", m AS (SELECT column_name, total - count(v) + count(*) FILTER (is_text AND lower(trim(v)) IN {WORDS}) AS missing,
  any_value(total) AS total FROM long, n GROUP BY column_name, total),
p AS (SELECT *, {pct_sql('missing', 'total')} AS pct FROM m)
SELECT column_name, CASE WHEN pct > 40 THEN 'high_missing_percentage' ELSE 'missing_values' END AS issue_type,
  missing AS affected_rows, pct AS percentage_affected, CASE WHEN pct > 40 THEN 'Critical' WHEN pct >= 20 THEN 'High'
  WHEN pct >= 5 THEN 'Medium' ELSE 'Low' END AS severity FROM p WHERE missing > 0"""
DUPLICATE = f"""SELECT '(Entire Dataset)' AS column_name, 'duplicate_rows' AS issue_type, x AS affected_rows,
  {pct_sql('x', 't')} AS percentage_affected, CASE WHEN {pct_sql('x', 't')} >= 5 THEN 'High'
  WHEN {pct_sql('x', 't')} >= 1 THEN 'Medium' ELSE 'Low' END AS severity
FROM (SELECT CAST(sum(n - 1) AS BIGINT) AS x, sum(n) AS t FROM (SELECT count(*) AS n FROM dirty GROUP BY {', '.join(DIRTY_COLUMNS)})) WHERE x > 0"""
CONSTANT = """SELECT column_name, 'constant_column' AS issue_type, total AS affected_rows, CAST(100.0 AS DOUBLE) AS percentage_affected,
  'High' AS severity FROM k, n WHERE d = 1"""
NEAR = f"""SELECT column_name, 'near_constant_column' AS issue_type, top AS affected_rows,
  {pct_sql('top', 'valid')} AS percentage_affected, 'Low' AS severity FROM k WHERE d > 1 AND {pct_sql('top', 'valid')} >= 95"""
WHITESPACE = f"""SELECT column_name, 'leading_trailing_whitespace' AS issue_type, CAST(sum(c.n) AS BIGINT) AS affected_rows,
  {pct_sql('sum(c.n)', 'any_value(total)')} AS percentage_affected, 'Low' AS severity
FROM c JOIN k USING (column_name), n WHERE c.is_text AND d > 1 AND {STRIP.format('v')} <> v GROUP BY column_name"""
CATEGORY = f"""SELECT column_name, 'inconsistent_categorical' AS issue_type, CAST(sum(rows - top) AS BIGINT) AS affected_rows,
  {pct_sql('sum(rows - top)', 'any_value(total)')} AS percentage_affected, 'Medium' AS severity
FROM (SELECT column_name, lower({STRIP.format('v')}) AS f, sum(n) AS rows, max(n) AS top, count(DISTINCT {STRIP.format('v')}) AS forms
  FROM c WHERE is_text GROUP BY ALL) g JOIN k USING (column_name), n
WHERE forms > 1 AND f <> '' AND d > 1 GROUP BY column_name HAVING sum(rows - g.top) > 0""".replace("rows - top", "rows - g.top")
NUMBER = "try_cast(regexp_replace(v, '[$,€£¥₹%\\s]', '', 'g') AS DOUBLE)"
SHARES = f""", sh AS (SELECT column_name, CAST(sum(n) AS BIGINT) AS valid, count(*) AS d, coalesce(sum(n) FILTER ({NUMBER} IS NOT NULL), 0) AS nums,
  coalesce(sum(n) FILTER (regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_strptime(v, '%Y-%m-%d') IS NOT NULL), 0) AS dates,
  bool_or(regexp_matches(v, '[-/]\\d{{2,4}}')) AS date_like, bool_or(regexp_matches(v, '[-/:\\s,]')) AS separated
  FROM c WHERE is_text GROUP BY column_name)"""
NUMERIC_TEXT = f"""SELECT column_name, 'potential_numeric_as_string' AS issue_type, CAST(nums AS BIGINT) AS affected_rows,
  {pct_sql('nums', 'total')} AS percentage_affected, 'High' AS severity FROM sh, n
WHERE d > 1 AND valid >= 5 AND NOT date_like AND nums / valid >= 0.8"""
DATE_TEXT = f"""SELECT column_name, 'potential_datetime_as_string' AS issue_type, CAST(dates AS BIGINT) AS affected_rows,
  {pct_sql('dates', 'total')} AS percentage_affected, 'Medium' AS severity FROM sh, n
WHERE d > 1 AND valid >= 5 AND separated AND dates / valid >= 0.8"""
MIXED = """SELECT column_name, 'inconsistent_data_types' AS issue_type, total AS affected_rows, CAST(100.0 AS DOUBLE) AS percentage_affected,
  'Medium' AS severity FROM sh, n WHERE d > 1 AND valid >= 10 AND nums > 0 AND nums < valid"""


def _invalid(c, positive):
    negative = f" + count(*) FILTER ({c} < 0)" if positive else ""
    return f"SELECT '{c}' AS column_name, count(*) FILTER (isinf({c})) + count(*) FILTER ({c} IN (-999, -9999, 9999, 99999))" \
           f"{negative} AS x, count(*) AS t FROM dirty"


INVALID = f"""SELECT column_name, 'invalid_numerical_values' AS issue_type, x AS affected_rows, {pct_sql('x', 't')} AS percentage_affected,
  'High' AS severity FROM ({_invalid('price', True)} UNION ALL {_invalid('amount', True)} UNION ALL {_invalid('order_key', False).replace("isinf(order_key)", "false")}) WHERE x > 0"""


def _extreme(c):
    ok = f"{c} IS NOT NULL AND NOT isinf(CAST({c} AS DOUBLE))"
    return f"""SELECT '{c}' AS column_name, (SELECT count(*) FROM dirty, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b
  FROM dirty WHERE {ok}) WHERE {ok} AND ({c} < a - 3 * (b - a) OR {c} > b + 3 * (b - a))) AS x, (SELECT count(*) FROM dirty) AS t"""


EXTREME = f"""SELECT column_name, 'extreme_outliers' AS issue_type, x AS affected_rows, {pct_sql('x', 't')} AS percentage_affected,
  'Low' AS severity FROM ({_extreme('price')} UNION ALL {_extreme('amount')} UNION ALL {_extreme('order_key')}) WHERE x > 0"""
AUDIT = COUNTS + SHARES + MISSING.split("\nSELECT")[0] + f""", every AS (SELECT {MISSING.split('SELECT', 3)[3].strip()}
UNION ALL {DUPLICATE} UNION ALL {CONSTANT} UNION ALL {NEAR} UNION ALL {WHITESPACE} UNION ALL {CATEGORY}
UNION ALL {NUMERIC_TEXT} UNION ALL {DATE_TEXT} UNION ALL {MIXED} UNION ALL {INVALID} UNION ALL {EXTREME})"""


def severity_counts(spark, sf):
    return quality.severity_counts(quality.audit(dirty(spark, sf)))


SEVERITY = AUDIT + """ SELECT severity, count(issue_type) AS issue_count FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low')) s(severity)
LEFT JOIN every USING (severity) GROUP BY severity"""


def cleaning_preview(spark, sf):
    return quality.cleaning_preview(dirty(spark, sf)).groupBy("column_name", "category").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("original_value").alias("first_original"),
        F.min("cleaned_value").alias("first_cleaned"))


# Python prints the median with two decimals at most
PREVIEW = COUNTS + f""", ws AS (SELECT * FROM (SELECT column_name, v AS o, {STRIP.format('v')} AS cl, row_number() OVER
  (PARTITION BY column_name ORDER BY v) AS r FROM c WHERE is_text AND {STRIP.format('v')} <> v)),
nt AS (SELECT * FROM (SELECT v AS o, row_number() OVER (ORDER BY v) AS r FROM c WHERE column_name = 'price_txt')),
st AS (SELECT column_name, {STRIP.format('v')} AS s, sum(n) AS n FROM c WHERE is_text GROUP BY ALL),
sp AS (SELECT *, lower(s) AS f, count(*) OVER (PARTITION BY column_name, lower(s)) AS forms,
  first_value(s) OVER (PARTITION BY column_name, lower(s) ORDER BY n DESC, s) AS best FROM st),
va AS (SELECT column_name, s AS o, {TITLE.format('best')} AS cl, f FROM sp WHERE forms > 1),
vr AS (SELECT *, dense_rank() OVER (PARTITION BY column_name ORDER BY f) AS r FROM va WHERE o <> cl),
md AS (SELECT CAST(format('{{:.2f}}', quantile_cont(price, 0.5)) AS DOUBLE) AS m FROM dirty),
st2 AS (SELECT v AS m FROM c WHERE column_name = 'status' ORDER BY n DESC, v LIMIT 1),
every AS (SELECT column_name, 'whitespace' AS category, o, cl FROM ws
UNION ALL SELECT column_name, 'spelling', o, cl FROM vr
UNION ALL SELECT 'price_txt', 'number', o, replace(o, '$', '') || '.0' FROM nt
UNION ALL SELECT 'price', 'missing', 'missing', CAST(m AS VARCHAR) FROM md
UNION ALL SELECT 'status', 'missing', 'missing', m FROM st2
UNION ALL SELECT 'amount', 'invalid', o, 'median' FROM (VALUES ('code'), ('infinity')) t(o)
UNION ALL SELECT 'order_key', 'invalid', 'code', 'median'
  WHERE EXISTS (SELECT 1 FROM dirty WHERE order_key IN (-999, -9999, 9999, 99999)))
SELECT column_name, category, count(*) AS pairs, min(o) AS first_original, min(cl) AS first_cleaned FROM every GROUP BY ALL"""


def whitespace_examples(spark, sf):
    return quality.whitespace_examples(dirty(spark, sf))


def strip_whitespace(spark, sf):
    return cleaning.strip_whitespace(dirty(spark, sf)).select("order_key", "status", "priority")


def standardize_categories(spark, sf):
    return cleaning.standardize_categories(dirty(spark, sf))[0].select("order_key", "status", "priority")


CANON = f"""cn AS (SELECT priority AS v, count(*) AS n FROM dirty GROUP BY priority),
cb AS (SELECT v, first_value(v) OVER (PARTITION BY lower(v) ORDER BY n DESC, v) AS best,
  count(*) OVER (PARTITION BY lower(v)) AS forms FROM cn),
cm AS (SELECT v, CASE WHEN forms > 1 THEN {TITLE.format('best')} ELSE v END AS t FROM cb)"""
CATEGORIES = f"WITH {DIRTY}, {CANON} SELECT order_key, status, t AS priority FROM dirty JOIN cm ON priority = v"


def convert_numbers(spark, sf):
    return cleaning.convert_numbers(dirty(spark, sf)).select("order_key", "price_txt")


def convert_dates(spark, sf):
    return cleaning.convert_dates(dirty(spark, sf)).select("order_key", ts_text("date_txt").alias("date_txt"))


def null_invalid_numbers(spark, sf):
    return rounded(cleaning.null_invalid_numbers(dirty(spark, sf)).select("order_key", "price", "amount"), 2)


VALID_AMOUNT = "CASE WHEN isinf(amount) OR amount IN (-999, -9999, 9999, 99999) OR amount < 0 THEN NULL ELSE amount END"
VALID_KEY = "CASE WHEN order_key NOT IN (-999, -9999, 9999, 99999) THEN order_key END"
NULL_INVALID = f"""WITH {DIRTY} SELECT {VALID_KEY} AS order_key, CASE WHEN price IN (9999, 99999) THEN NULL ELSE round(price, 2) END AS price,
  round({VALID_AMOUNT}, 2) AS amount FROM dirty"""


def drop_constants(spark, sf):
    df = dirty(spark, sf).select("order_key", "status", "const_col", "near_const")
    return cleaning.drop_columns(df, cleaning.constant_columns(df))


def drop_sparse(spark, sf):
    df = dirty(spark, sf).select("order_key", "price", "note", "near_const")
    return rounded(cleaning.drop_columns(df, cleaning.sparse_columns(df)), 2)


def dedupe(spark, sf):
    return rounded(dirty(spark, sf).select("order_key", "price", "status").dropDuplicates(), 2)


def _fill_numbers(strategy):
    return lambda spark, sf: rounded(cleaning.fill_numbers(dirty(spark, sf).select("order_key", "price"), strategy), 2)


def _fill_others(strategy):
    return lambda spark, sf: cleaning.fill_others(dirty(spark, sf).select("order_key", "note"), strategy)


NOTE_MODE = "(SELECT note FROM dirty WHERE note IS NOT NULL GROUP BY note ORDER BY count(*) DESC, note LIMIT 1)"


def cap_extremes(spark, sf):
    df = dirty(spark, sf).select("order_key", "amount")
    return rounded(cleaning.cap_extremes(df).select(F.col("order_key").cast("long").alias("order_key"), "amount"), 2)


CAP = f"""WITH {DIRTY}, d AS (SELECT order_key, amount FROM dirty),
q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM d)
SELECT order_key, round(greatest(least(amount, b + 3 * (b - a)), a - 3 * (b - a)), 2) AS amount FROM d, q"""


def _cleaned(df):
    return rounded(df.withColumn("date_txt", ts_text("date_txt")).withColumn("ordered_at", ts_text("ordered_at"))
                   .withColumn("order_key", F.col("order_key").cast("double")), 2)


def clean_default(spark, sf):
    return _cleaned(cleaning.clean(dirty(spark, sf)).data)


STEPS = f"""st AS (SELECT CAST({VALID_KEY} AS DOUBLE) AS order_key, CASE WHEN price IN (9999, 99999) THEN NULL ELSE price END AS price,
  {VALID_AMOUNT} AS amount, {STRIP.format('status')} AS status, t AS priority, note,
  CAST(replace(price_txt, '$', '') AS DOUBLE) AS price_raw, date_txt || ' 00:00:00' AS date_txt, const_col, near_const,
  strftime(ordered_at, '%Y-%m-%d %H:%M:%S') AS ordered_at FROM dirty JOIN cm ON priority = v),
sv AS (SELECT * EXCLUDE (price_raw), CASE WHEN price_raw IN (9999, 99999) THEN NULL ELSE price_raw END AS price_txt FROM st),
de AS (SELECT DISTINCT * FROM sv),
md AS (SELECT quantile_cont(order_key, 0.5) AS mk, quantile_cont(price, 0.5) AS mp, quantile_cont(amount, 0.5) AS ma, quantile_cont(price_txt, 0.5) AS mt FROM de),
mo AS (SELECT note AS mn FROM de WHERE note IS NOT NULL GROUP BY note ORDER BY count(*) DESC, note LIMIT 1)"""
CLEAN_DEFAULT = f"""WITH {DIRTY}, {CANON}, {STEPS}
SELECT round(coalesce(order_key, mk), 2) AS order_key, round(coalesce(price, mp), 2) AS price,
  round(coalesce(amount, ma), 2) AS amount, status, priority,
  coalesce(note, mn) AS note, round(coalesce(price_txt, mt), 2) AS price_txt, date_txt, const_col, near_const, ordered_at
FROM de, md, mo"""


def clean_all_options(spark, sf):
    return _cleaned(cleaning.clean(dirty(spark, sf), {"drop_constant_columns": True, "drop_high_missing_columns": True,
                                                      "cap_outliers": True, "fill_numeric_missing": "mean"}).data)


CLEAN_ALL = f"""WITH {DIRTY}, {CANON}, {STEPS.split('md AS')[0].rstrip().rstrip(',')},
me AS (SELECT avg(order_key) AS mk, avg(price) AS mp, avg(amount) AS ma, avg(price_txt) AS mt FROM de),
fi AS (SELECT round(coalesce(order_key, mk), 2) AS order_key, coalesce(price, mp) AS price, coalesce(amount, ma) AS amount, status, priority,
  coalesce(price_txt, mt) AS price_txt, date_txt, near_const, ordered_at FROM de, me),
q AS (SELECT quantile_cont(price, 0.25) AS p1, quantile_cont(price, 0.75) AS p3, quantile_cont(amount, 0.25) AS a1,
  quantile_cont(amount, 0.75) AS a3, quantile_cont(price_txt, 0.25) AS t1, quantile_cont(price_txt, 0.75) AS t3 FROM fi)
SELECT order_key, round(greatest(least(price, p3 + 3 * (p3 - p1)), p1 - 3 * (p3 - p1)), 2) AS price,
  round(greatest(least(amount, a3 + 3 * (a3 - a1)), a1 - 3 * (a3 - a1)), 2) AS amount, status, priority,
  round(greatest(least(price_txt, t3 + 3 * (t3 - t1)), t1 - 3 * (t3 - t1)), 2) AS price_txt, date_txt, near_const, ordered_at
FROM fi, q"""


def clean_summary(spark, sf):
    return cleaning.clean(dirty(spark, sf)).summary.drop("columns_dropped")


CLEAN_SUMMARY = f"""WITH {DIRTY}, {CANON}, {STEPS},
a AS (SELECT count(*) AS n, count(*) FILTER ({STRIP.format('status')} <> status) AS padded,
  count(*) FILTER (t <> priority) AS cased, count(*) FILTER (amount IS NOT NULL AND ({VALID_AMOUNT}) IS NULL) AS bad,
  count(*) FILTER (price IN (9999, 99999)) + count(*) FILTER (({VALID_KEY}) IS NULL) AS badp, count(*) FILTER (replace(price_txt, '$', '') IN ('9999', '99999')) AS badt
  FROM dirty JOIN cm ON priority = v),
b AS (SELECT count(*) AS n, count(*) FILTER (price IS NULL) + count(*) FILTER (amount IS NULL) + count(*) FILTER (note IS NULL)
  + count(*) FILTER (price_txt IS NULL) + count(*) FILTER (order_key IS NULL) AS holes FROM de)
SELECT a.n AS rows_before, b.n AS rows_after, CAST(11 AS BIGINT) AS columns_before, CAST(11 AS BIGINT) AS columns_after,
  a.n - b.n AS duplicates_removed, holes AS missing_values_handled, CAST(2 AS BIGINT) AS columns_converted,
  padded + cased + bad + badp + badt AS values_standardized, CAST(0 AS BIGINT) AS outliers_capped FROM a, b"""


def clean_log(spark, sf):
    return cleaning.clean(dirty(spark, sf)).log


_LOGGED = [("status", "strip_whitespace", "padded"), ("priority", "standardize_categories", "cased"),
           ("price_txt", "convert_numbers", "n"), ("date_txt", "convert_dates", "n"),
           ("order_key", "null_invalid_numbers", "bad_key"), ("price", "null_invalid_numbers", "bad_price"),
           ("amount", "null_invalid_numbers", "bad_amount"), ("price_txt", "null_invalid_numbers", "bad_txt")]
_FILLED = [("order_key", "fill_numbers"), ("price", "fill_numbers"), ("amount", "fill_numbers"), ("price_txt", "fill_numbers"),
           ("note", "fill_others")]
CLEAN_LOG = f"""WITH {DIRTY}, {CANON}, {STEPS},
a AS (SELECT count(*) AS n, count(*) FILTER ({STRIP.format('status')} <> status) AS padded, count(*) FILTER (t <> priority) AS cased,
  count(*) FILTER (({VALID_KEY}) IS NULL) AS bad_key, count(*) FILTER (price IN (9999, 99999)) AS bad_price,
  count(*) FILTER (amount IS NOT NULL AND ({VALID_AMOUNT}) IS NULL) AS bad_amount,
  count(*) FILTER (replace(price_txt, '$', '') IN ('9999', '99999')) AS bad_txt FROM dirty JOIN cm ON priority = v),
rows_ AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{step}' AS step, {n} AS affected FROM a" for c, step, n in _LOGGED)}
  UNION ALL {" UNION ALL ".join(f"SELECT '{c}', '{step}', count(*) FILTER ({c} IS NULL) FROM de" for c, step in _FILLED)})
SELECT * FROM rows_ WHERE affected > 0"""


QUERIES = {
    "issue_missing": (_rules(quality.missing_rules), COUNTS + MISSING),
    "issue_duplicates": (_issues(quality.duplicate_issues), f"WITH {DIRTY} " + DUPLICATE),
    "issue_constant": (_rules(quality.constant_rules), f"{COUNTS} {CONSTANT}"),
    "issue_near_constant": (_rules(quality.near_constant_rules), f"{COUNTS} {NEAR}"),
    "issue_whitespace": (_rules(quality.whitespace_rules), f"{COUNTS} {WHITESPACE}"),
    "issue_category_case": (_rules(quality.category_rules), f"{COUNTS} {CATEGORY}"),
    "issue_numeric_text": (_rules(quality.numeric_text_rules), f"{COUNTS}{SHARES} {NUMERIC_TEXT}"),
    "issue_date_text": (_rules(quality.date_text_rules), f"{COUNTS}{SHARES} {DATE_TEXT}"),
    "issue_mixed_types": (_rules(quality.mixed_type_rules), f"{COUNTS}{SHARES} {MIXED}"),
    "issue_invalid_numbers": (_rules(quality.invalid_number_rules), f"WITH {DIRTY} {INVALID}"),
    "issue_extreme_values": (_rules(quality.extreme_value_rules), f"WITH {DIRTY} {EXTREME}"),
    "audit": (_issues(quality.audit), f"{AUDIT} SELECT {FIELDS} FROM every"),
    "severity_counts": (severity_counts, SEVERITY),
    "cleaning_preview": (cleaning_preview, PREVIEW),
    "whitespace_examples": (whitespace_examples, f"""WITH {DIRTY}, e AS (SELECT column_name, v AS original_value, row_number() OVER
  (PARTITION BY column_name ORDER BY v) AS r FROM (SELECT DISTINCT * FROM ({long_sql('dirty', DIRTY_TEXT)})) WHERE {STRIP.format('v')} <> v)
SELECT column_name, original_value FROM e WHERE r <= 3"""),
    "step_whitespace": (strip_whitespace, f"WITH {DIRTY} SELECT order_key, {STRIP.format('status')} AS status, priority FROM dirty"),
    "step_categories": (standardize_categories, CATEGORIES),
    "step_numbers": (convert_numbers, f"WITH {DIRTY} SELECT order_key, CAST(replace(price_txt, '$', '') AS DOUBLE) AS price_txt FROM dirty"),
    "step_dates": (convert_dates, f"WITH {DIRTY} SELECT order_key, date_txt || ' 00:00:00' AS date_txt FROM dirty"),
    "step_invalid_numbers": (null_invalid_numbers, NULL_INVALID),
    "step_drop_constants": (drop_constants, f"WITH {DIRTY} SELECT order_key, status, near_const FROM dirty"),
    "step_drop_sparse": (drop_sparse, f"WITH {DIRTY} SELECT order_key, round(price, 2) AS price, near_const FROM dirty"),
    "step_dedupe": (dedupe, f"WITH {DIRTY} SELECT DISTINCT order_key, round(price, 2) AS price, status FROM dirty"),
    "step_fill_median": (_fill_numbers("median"), f"WITH {DIRTY} SELECT order_key, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM dirty)), 2) AS price FROM dirty"),
    "step_fill_mean": (_fill_numbers("mean"), f"WITH {DIRTY} SELECT order_key, round(coalesce(price, (SELECT avg(price) FROM dirty)), 2) AS price FROM dirty"),
    "step_fill_zero": (_fill_numbers("zero"), f"WITH {DIRTY} SELECT order_key, round(coalesce(price, 0), 2) AS price FROM dirty"),
    "step_fill_drop": (_fill_numbers("drop"), f"WITH {DIRTY} SELECT order_key, round(price, 2) AS price FROM dirty WHERE price IS NOT NULL"),
    "step_fill_mode": (_fill_others("mode"), f"WITH {DIRTY} SELECT order_key, coalesce(note, {NOTE_MODE}) AS note FROM dirty"),
    "step_fill_unknown": (_fill_others("unknown"), f"WITH {DIRTY} SELECT order_key, coalesce(note, 'Unknown') AS note FROM dirty"),
    "step_cap": (cap_extremes, CAP),
    "clean_default": (clean_default, CLEAN_DEFAULT),
    "clean_all_options": (clean_all_options, CLEAN_ALL),
    "clean_summary": (clean_summary, CLEAN_SUMMARY),
    "clean_log": (clean_log, CLEAN_LOG),
}
